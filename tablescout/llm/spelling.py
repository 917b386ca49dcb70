"""Spelling variants: words that differ by one edit, found with K-d trees over letter counts.

A word is a vector of letter counts. One edit changes that vector by at most two in L1: a replaced
letter takes one count away and adds another, an inserted one only adds. So the words near a word have
its length, or one letter more or less, and lie within that distance; the order of letters decides.

Words are dealt into cells by their length and, in a crowded length, by a K-d tree over the counts
of a bounded sample, whose planes are ``count of a letter >= t``. Each word is at home in one cell and
visits the cells of its own length and of one letter more that its edits can reach: a cell is a
box, and a word's letters over the box and below it are bounded by what one edit can mend. Cells are
cut into blocks by letters, and the visitors of a cell into parts, so a task holds one block and one part.

A task builds a K-d tree over its block. Counts are written in unary, one bit for every plane, so a
node's box is the AND and the OR of its rows, and distances are bit counts. Range searches prune by
boxes and verify what is left on the letters themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import stored

#: Fixed value: what a word is made of. All of it lies in Latin-1, one byte a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Shortest word, least occurrences of a word, and how much more frequent a form must be.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Words whose letters the planes of the cells are fitted on, those with the least hashes.
FITTED = 65_536
#: Words per cell that the planes aim at; letters of a block and of a part of the visitors.
CELL_WORDS, BLOCK_LETTERS, PART_LETTERS = 16_384, 262_144, 1_048_576
#: Rows of a tree's leaf; letters compared at once; code points of a long text taken at a time;
#: words that a task counts before it passes them on; shuffle partitions, each then holds several tasks.
_LEAF, _COMPARED, _SLICE, _HELD, _MOST_TASKS = 32, 1 << 22, 1 << 20, 200_000, 50_000
_RUN = re.compile(RUN)
#: Bytes of Latin-1 with letters as they count, and all else as spaces.
_LETTER = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """The runs of a text in Latin-1 with small ASCII letters, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        cut = _RUN.match(text, end) if end < len(text) else None
        end = cut.end() if cut else end
        # What Latin-1 lacks becomes a question mark, and that a space.
        yield text[at:end].encode("latin-1", "replace").translate(_LETTER).split()
        at = end


def _counter(slips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                own: Counter = Counter()
                for some in _runs(text.as_py() or ""):
                    own.update(some)
                # A checksum goes on from the one of what stands before.
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in own.items():
                    if slips:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return run


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
) -> DataFrame:
    """``word, n``: the words of whole texts, in small ASCII letters, with all their occurrences.

    With ``slips`` every word of a document whose checksum that number divides loses one letter, the
    same in each run: known misspellings to measure with. Shorter and rarer words are left out. Null and
    empty texts have no words; a null id counts as an empty one; each row is a document of its own.
    """
    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = chosen.mapInArrow(_counter(slips), "word string, n long").where(F.length("word") >= letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def letter_rows(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


class Planes:
    """The K-d tree of one length over sample words: planes, and a leaf for each box between them."""

    def __init__(self, words: list[str], leaves: int):
        rows = letter_rows(words)
        seen = np.unique(rows)
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        counts = np.stack([(rows == c).sum(axis=1) for c in seen], axis=1)
        self._split(seen, counts, max(1, leaves))

    def _split(self, seen: np.ndarray, counts: np.ndarray, leaves: int) -> int:
        me = len(self.nodes)
        best = None
        if leaves > 1 and len(counts) > 1:
            middle = np.sort(counts, axis=0)[len(counts) // 2]
            for letter in range(len(seen)):
                for t in {int(middle[letter]), int(middle[letter]) + 1}:
                    over = int((counts[:, letter] >= t).sum())
                    if 0 < over < len(counts) and (best is None or abs(2 * over - len(counts)) < best[0]):
                        best = abs(2 * over - len(counts)), letter, t
        if best is None:
            self.nodes.append((-1, self.leaves, 0, 0))
            self.leaves += 1
            return me
        _, letter, t = best
        self.nodes.append((int(seen[letter]), t, 0, 0))
        over = counts[:, letter] >= t
        more = max(1, min(leaves - 1, round(leaves * over.mean())))
        below = self._split(seen, counts[~over], leaves - more)
        above = self._split(seen, counts[over], more)
        self.nodes[me] = (int(seen[letter]), t, below, above)
        return me

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int32)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            letter, t, below, above = self.nodes[node]
            if letter < 0:
                out[at] = t
            elif len(at):
                over = (rows[at] == letter).sum(axis=1) >= t
                stack += [(below, at[~over]), (above, at[over])]
        return out

    def reached(self, rows: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of the boxes that one edit can reach.

        ``spare`` is how many letters an edit may take away: one in a replacement, none where the other word
        only has a letter more. Either adds one letter at most.
        """
        found_row, found_leaf = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
        # What stands out of a box, letter by letter: a letter's later planes only move its bound.
        stack: list = [(0, np.arange(len(rows)), {}, {})]
        while stack:
            node, at, over, lack = stack.pop()
            letter, t, below, above = self.nodes[node]
            if not len(at):
                continue
            if letter < 0:
                found_row.append(at)
                found_leaf.append(np.full(len(at), t, dtype=np.int32))
                continue
            n = (rows[at] == letter).sum(axis=1)
            for child, bounds, need, most in (
                (below, over, np.maximum(n - (t - 1), 0), spare), (above, lack, np.maximum(t - n, 0), 1),
            ):
                # A child's bound for a letter is the tighter one, so it replaces the bound before.
                own = {**bounds, letter: need}
                ok = sum(own.values()) <= most
                keep = lambda d: {k: v[ok] for k, v in d.items()}
                stack.append((child, at[ok], *((keep(own), keep(lack)) if bounds is over else (keep(over), keep(own)))))
        return np.concatenate(found_row), np.concatenate(found_leaf)


def fit_planes(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> dict[int, Planes]:
    """Planes of the lengths that need more than one cell, fitted on at most ``FITTED`` words."""
    total = vocabulary.count()
    # A share by hash first, so that tasks do not each send the whole bound to the driver.
    mark, share = F.pmod(F.xxhash64("word"), F.lit(1_000_003)), min(1.0, 1.25 * FITTED / max(1, total))
    some = vocabulary.select("word").where(mark < int(share * 1_000_003) + 1)
    sample = [r["word"] for r in some.orderBy(F.xxhash64("word"), "word").limit(FITTED).collect()]
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    out = {}
    for length, words in by_length.items():
        leaves = round(len(words) / len(sample) * total / cell_words)
        if leaves > 1:
            out[length] = Planes(words, leaves)
    return out


_PLACED = "word string, n long, home boolean, length int, leaf int"


def _place(planes: dict[int, Planes]):
    """Each word once as a resident of its cell, and once for every cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            size = np.array([len(w) for w in words], dtype=np.int32)
            parts = []
            for length in np.unique(size).tolist():
                mine = np.flatnonzero(size == length)
                rows = letter_rows([words[i] for i in mine])
                none = np.zeros(len(mine), dtype=np.int32)
                at = np.arange(len(mine))
                same, longer = planes.get(length), planes.get(length + 1)
                parts.append((mine, length, same.leaf_of(rows) if same else none, True))
                for tree, to, spare in ((same, length, 1), (longer, length + 1, 0)):
                    row, leaf = tree.reached(rows, spare) if tree else (at, none)
                    parts.append((mine[row], to, leaf, False))
            if parts:
                at = pa.array(np.concatenate([p[0] for p in parts]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at), b.column(1).take(at),
                        pa.array(np.concatenate([np.full(len(p[0]), p[3]) for p in parts])),
                        pa.array(np.concatenate([np.full(len(p[0]), p[1], dtype=np.int32) for p in parts])),
                        pa.array(np.concatenate([p[2] for p in parts])),
                    ],
                    names=["word", "n", "home", "length", "leaf"],
                )

    return run


def unary(rows: np.ndarray, letters: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A bit for every ``count of a letter >= t``, as a boolean matrix."""
    bits = [(rows == c).sum(axis=1)[:, None] > np.arange(m)[None, :] for c, m in zip(letters, most)]
    out = np.concatenate(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 64)))


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


class LetterTree:
    """A K-d tree over the letter counts of words of one length."""

    def __init__(self, bits: np.ndarray):
        self.order = np.arange(len(bits))
        packed = _packed(bits)
        self.nodes: list = []
        todo = [(0, len(bits), -1, False)]
        while todo:
            begin, end, parent, right = todo.pop()
            at, me = self.order[begin:end], len(self.nodes)
            box = np.bitwise_and.reduce(packed[at], axis=0), np.bitwise_or.reduce(packed[at], axis=0)
            self.nodes.append([*box, begin, end, -1, -1])
            if parent >= 0:
                self.nodes[parent][5 if right else 4] = me
            if end - begin > _LEAF:
                # The plane that halves the rows best; without one all rows are anagrams.
                ones = bits[at].sum(axis=0)
                plane = int(np.argmin(np.abs(2 * ones - (end - begin))))
                if 0 < ones[plane] < end - begin:
                    side = bits[at, plane]
                    self.order[begin:end] = np.concatenate([at[~side], at[side]])
                    middle = end - int(ones[plane])
                    todo += [(begin, middle, me, False), (middle, end, me, True)]
        self.rows = packed[self.order]

    def within(self, asked: np.ndarray, spare: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(asked, row)`` with at most ``spare`` letters to take away and one to add."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, at = todo.pop()
            low, high, begin, end, below, above = self.nodes[node]
            q = asked[at]
            ok = np.bitwise_count(q & ~high).sum(axis=1) <= spare
            ok &= np.bitwise_count(low & ~q).sum(axis=1) <= 1
            at = at[ok]
            if not len(at):
                continue
            if below >= 0:
                todo += [(below, at), (above, at)]
                continue
            # Anagrams may make a leaf large; pieces keep the matrix small.
            for lo in range(begin, end, 4 * _LEAF):
                p = self.rows[lo : min(end, lo + 4 * _LEAF)]
                for first in range(0, len(at), 8192):
                    q = asked[at[first : first + 8192]]
                    away = np.zeros((len(q), len(p)), dtype=np.uint16)
                    for w in range(q.shape[1]):
                        away += np.bitwise_count(q[:, w, None] & ~p[None, :, w])
                    i, j = np.nonzero(away <= spare)
                    if len(i):
                        yield at[first + i], self.order[lo + j]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """True where a letter put into ``short`` gives ``long``: equal heads and equal tails cover it."""
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


class _Nearest:
    """For each of ``words``: how many of ``others`` are near, and the most frequent of these."""

    def __init__(self, words: list[str], others: list[str], n: np.ndarray):
        self.words, self.others, self.n = words, others, n
        self.near = np.zeros(len(words), dtype=np.int64)
        # Forms by falling occurrences, then in the order of code points.
        self.order = sorted(range(len(others)), key=lambda i: (-int(n[i]), others[i]))
        self.rank = np.empty(len(others), dtype=np.int64)
        self.rank[self.order] = np.arange(len(others))
        self.best = np.full(len(words), len(others), dtype=np.int64)

    def add(self, at: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.near, at, 1)
        np.minimum.at(self.best, at, self.rank[other])

    def rows(self) -> Iterator[tuple]:
        for k in np.flatnonzero(self.near).tolist():
            i = self.order[self.best[k]]
            yield self.words[k], int(self.near[k]), int(self.n[i]), self.others[i]


_NEAR = "word string, n_near long, near_n long, near string"


def _search(rows: pa.Table) -> pa.Table:
    """Group function over the residents of a block and a part of its visitors."""
    home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    size, length = np.array([len(w) for w in words]), rows.column("length")[0].as_py()
    mine, found = np.flatnonzero(home), []
    if len(mine):
        own = [words[i] for i in mine]
        own_rows = letter_rows(own)
        letters = np.unique(own_rows)
        most = np.stack([(own_rows == c).sum(axis=1) for c in letters], axis=1).max(axis=0)
        tree = LetterTree(unary(own_rows, letters, most))
        for of, spare in ((length, 1), (length - 1, 0)):
            at = np.flatnonzero(~home & (size == of))
            if not len(at):
                continue
            asked = [words[i] for i in at]
            asked_rows = letter_rows(asked)
            visitors = _Nearest(asked, own, n[mine])
            # A longer word visits no shorter one, so such a pair counts for both here.
            residents = None if spare else _Nearest(own, asked, n[at])
            packed = _packed(unary(asked_rows, letters, most))
            # Letters beyond any resident's count are to be taken away, whichever resident it is.
            outside = of - np.bitwise_count(packed).sum(axis=1).astype(np.int64)
            chunk = max(1, _COMPARED // (length + 1))
            for n_outside in range(spare + 1):
                some = np.flatnonzero(outside == n_outside)
                for i, j in tree.within(packed[some], spare - n_outside) if len(some) else ():
                    i = some[i]
                    for lo in range(0, len(i), chunk):
                        a, b = i[lo : lo + chunk], j[lo : lo + chunk]
                        check = one_replaced if spare else one_inserted
                        near = check(asked_rows[a], own_rows[b])
                        visitors.add(a[near], b[near])
                        if residents:
                            residents.add(b[near], a[near])
            found += list(visitors.rows()) + (list(residents.rows()) if residents else [])
    columns = list(zip(*found)) if found else [[], [], [], []]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n_near", "near_n", "near"])


def near_words(vocabulary: DataFrame, cell_words: int = CELL_WORDS, block_letters: int = BLOCK_LETTERS,
               part_letters: int = PART_LETTERS) -> DataFrame:
    """``word, n_near, near_n, near`` of the words ``word, n`` that have a near one.

    Words must be distinct. ``n_near`` counts all near words, ``near`` is the most frequent, of equals the
    least. Every pair is found, whatever the cells; they only bound the work of a task.
    """
    planes = fit_planes(vocabulary, cell_words)
    placed = stored(vocabulary.select("word", "n").mapInArrow(_place(planes), _PLACED), "words-placed")
    share = lambda home, bound: F.greatest(F.lit(1), F.ceil(F.count_if(home) * F.first("length") / bound)).cast("int")
    sizes = placed.groupBy("length", "leaf").agg(
        share(F.col("home"), block_letters).alias("blocks"), share(~F.col("home"), part_letters).alias("parts"),
        F.bool_or("home").alias("has"),
    ).where("has").drop("has")
    dealt = placed.join(sizes, ["length", "leaf"])
    # Residents of a block meet every part of the visitors, and a visitor every block.
    own = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("home"), own("blocks")).otherwise(every("blocks"))))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("home"), every("parts")).otherwise(own("parts"))))
    keys = ["length", "leaf", "block", "part"]
    # A task's rows are few and its work is not, so tasks are counted rather than left to sizes in bytes.
    tasks = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("parts")).alias("n")).first()["n"]
    dealt = dealt.select(*keys, "word", "n", "home").repartition(max(1, min(tasks or 1, _MOST_TASKS)), *keys)
    found = dealt.groupBy(*keys).applyInArrow(_search, _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form`` without cycles: each round doubles the steps taken."""
    up = stored(links.select("word", F.col("form").alias("root")), "words-up")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        open_ = up.join(on.select("root"), "root", "left_semi")
        if open_.isEmpty():
            return up
        up = stored(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "words-up")


def variants(vocabulary: DataFrame, times: int = TIMES, **bounds: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word, n``.

    A word's form is its most frequent near word, of equals the least, if that has at least ``times`` its
    occurrences; the root is where the forms end, the word itself without one. An empty table gives no rows.
    """
    vocabulary = stored(vocabulary.select("word", "n"), "words")
    near = near_words(vocabulary, **bounds)
    is_form = F.col("near_n") >= times * F.col("n")
    joined = stored(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "words-forms",
    )
    # Occurrences grow with every step, so there are no cycles.
    named = roots(joined.where("form IS NOT NULL"))
    return joined.join(named, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0) -> DataFrame:
    """The words of whole texts with their most frequent near word and their root.

    See ``word_counts`` for null, empty and repeated rows and ``variants`` for the columns. Columns other
    than the two named ones are not read.
    """
    return variants(word_counts(docs, id_col, text_col, slips))
