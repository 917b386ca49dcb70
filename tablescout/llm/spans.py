"""Pattern matches with their places, as column expressions.

A pattern's matches come from ``regexp_extract_all`` and the text between them from ``split``;
lengths added up from left to right give the places in code points. Sums run in blocks, and blocks
of blocks, and texts are cut through chunks of bounded length, so the work on a text grows with its length and
its matches, however many there are. Patterns must not match the empty text. Write them without nested
backtracking (possessive groups), so that a very long text neither overflows the matcher's stack nor
takes quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def no_matches() -> Column:
    return F.array().cast(MATCH)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, and then looked up in constant time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Numbers of a block, and levels of blocks of blocks.
_BLOCK, _LEVELS = 64, 2
_NUMBERS = "array<int>"


def running(numbers: Column, add: Callable[[Column, Column], Column], zero: int) -> Column:
    """For every number what ``add``, which must be associative, makes of those before it."""
    return let(numbers, lambda x: _running(x, add, F.lit(zero), _LEVELS))


def _running(x: Column, add: Callable[[Column, Column], Column], zero: Column, level: int) -> Column:
    def walk(places: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(_NUMBERS).alias("out"))
        step = lambda s, i: F.struct(
            add(s["at"], F.get(x, i)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")
        )
        return F.aggregate(places, state, step, lambda s: s["out"])

    n, none = F.size(x), F.array().cast(_NUMBERS)
    if level == 0:
        return F.when(n > 0, walk(F.sequence(F.lit(0), n - 1), zero)).otherwise(none)
    places = lambda b: F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, n) - 1)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))).otherwise(none)
    totals = F.transform(blocks, lambda b: F.aggregate(places(b), zero, lambda a, i: add(a, F.get(x, i))))
    starts = let(totals, lambda t: _running(t, add, zero, level - 1))
    return let(starts, lambda s: F.flatten(F.transform(blocks, lambda b: walk(places(b), F.get(s, b)))))


def matches(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches ``start, end, text`` of a non-null text."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.filter(
        F.zip_with(
            F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1),
            lambda hit, before: F.struct(hit.alias("hit"), F.length(before).alias("gap"), F.length(hit).alias("size")),
        ),
        lambda p: p["hit"].isNotNull(),
    )

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda p: p["gap"] + p["size"]), lambda a, b: a + b, 0)
        return F.zip_with(
            found, before,
            lambda p, at: F.struct(
                (at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["hit"].alias("text")
            ),
        )

    return let(pairs, lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(no_matches()))


def outside(found: Column, others: Column) -> Column:
    """The matches that overlap none of the spans, by one pass from either side."""
    both = F.array_sort(F.concat(
        F.transform(others, lambda s: F.struct(
            s["start"].alias("start"), F.lit(0).alias("mine"), s["end"].alias("end"), F.lit("").alias("text")
        )),
        F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(1).alias("mine"), m["end"].alias("end"), m["text"].alias("text")
        )),
    ))

    def free(rows: Column) -> Column:
        # How far the spans before reach, and where the next one behind begins.
        reach = running(F.transform(rows, lambda r: F.when(r["mine"] == 0, r["end"]).otherwise(0)), F.greatest, 0)
        turned = F.transform(F.reverse(rows), lambda r: F.when(r["mine"] == 0, r["start"]).otherwise(2**31 - 1))
        following = F.reverse(running(turned, F.least, 2**31 - 1))
        marked = F.zip_with(
            rows, F.arrays_zip(reach.alias("reach"), following.alias("next")),
            lambda r, n: F.struct(
                r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"),
                ((r["mine"] == 1) & (n["reach"] <= r["start"]) & (n["next"] >= r["end"])).alias("keep"),
            ),
        )
        kept = F.filter(marked, lambda r: r["keep"])
        return F.transform(
            kept, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"))
        )

    return let(both, free)


#: Code points of a chunk, so that a place in a long text is found by its number.
_CHUNK = 256


def chunks(text: Column) -> Column:
    """Consecutive parts of a text, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, out of its chunks; bind these with ``let``."""
    first, last = (F.floor(x / _CHUNK).cast("int") for x in (start, end))
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    between = F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), part), "")).otherwise("")
    within = F.substring(part(first), F.pmod(start, F.lit(_CHUNK)) + 1, end - start)
    across = F.concat(
        F.substring(part(first), F.pmod(start, F.lit(_CHUNK)) + 1, F.lit(_CHUNK)), between,
        F.substring(part(last), F.lit(1), F.pmod(end, F.lit(_CHUNK))),
    )
    return F.when(end <= start, "").when(first == last, within).otherwise(across)


def spans(found: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches as spans of a kind; ``keep`` tests the matched text."""
    kept = found if keep is None else F.filter(found, lambda m: keep(m["text"]))
    return F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def count(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")


def written(all_spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(
        F.transform(
            all_spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(all_spans: Column) -> Column:
    return F.sha2(written(all_spans).cast("binary"), 256)


def replaced(text: Column, cover: Column, label: Callable[[Column], Column]) -> Column:
    """The text with each span of ``cover`` replaced; a span inside an earlier one is skipped.

    ``cover`` is sorted by start; a span that begins within the one before it extends the hole.
    """

    def pieces(parts: Column, n: Column) -> Column:
        reach = running(F.transform(cover, lambda s: s["end"]), F.greatest, 0)
        holes = F.zip_with(
            cover, reach,
            lambda s, at: F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), label(s))),
        )
        end = F.array_max(F.transform(cover, lambda s: s["end"]))
        return F.concat(F.array_join(holes, ""), cut(parts, end, n))

    whole = let(chunks(text), lambda parts: pieces(parts, F.length(text)))
    return F.when(F.size(cover) > 0, whole).otherwise(text)
