"""Personal data: identifier spans, and terms that give an identifier away.

Identifiers (email, ip, card, phone) are found by pattern and check. A word of the same text can
reveal an identifier when the two keep company across the corpus, so that taking out the identifier
alone does not help. How strongly a term t reveals an identifier e is their pointwise mutual information over
the information content of e::

    disclosure = ln(n(e, t) * N / (n(e) * n(t))) / ln(N / n(e))

with n the number of documents: 1 means that t occurs only where e does. A document holds a pair when
both stand anywhere in it. Pairs that cannot reach the support or the threshold are dropped by the
counts of e and t alone, before they are formed. Terms at or over the threshold are generalised
to a placeholder, terms that reveal all are removed. Only documents that mention e are touched.

Everything is a column expression or a join, nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm import spans as S
from tablescout.llm.common import fresh, stored

#: The patterns of the contract, with possessive groups and run starts so that a long
#: text takes linear time. A match may begin where the last one ended, hence the ``\G``.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: What an identifier and a revealing term become.
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "cut": ""}

#: Code points of context on either side of a mention, where terms are held to its surroundings.
CONTEXT = 200
#: Words of context on either side, likewise.
CONTEXT_WORDS = 8
#: Distinct texts that must show a pair before it counts.
MIN_SUPPORT = 3
#: Disclosure at which a term is generalised, and at which it is removed.
THRESHOLD, REMOVE_AT = 0.95, 0.9999
_TERM = r"\p{L}{3,}"


def _parts_at_most_255(hit: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(
        F.split(hit, r"\."), lambda p: part(p) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").cast("int"), F.lit(256)) <= 255)
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """14 to 19 digits that pass the Luhn check."""

    def passes(digits: Column) -> Column:
        # Digits from the right; every second one is doubled.
        each = F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    return F.exists(
        F.array(_digits(hit)),
        lambda d: F.when(F.length(d).between(14, 19), passes(d)).otherwise(F.lit(False)),
    )


def _phone_digits(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


def identifier_spans(text: Column) -> Column:
    """Sorted identifier spans of a text; a null text counts as empty.

    Cheap tests come first: a text without an at sign is never searched for emails, and so on.
    """
    t = F.coalesce(text, F.lit(""))
    kinds = (
        (F.contains(t, F.lit("@")), EMAIL, None),
        (t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP, _parts_at_most_255),
        (t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), CARD, _luhn),
        (F.contains(t, F.lit("+")), PHONE, _phone_digits),
    )
    found = [
        F.when(gate, S.spans(S.matches(t, pattern), kind, rank, keep)).otherwise(S.no_spans())
        for rank, (kind, (gate, pattern, keep)) in enumerate(zip(KINDS, kinds))
    ]
    return F.array_sort(F.concat(*found))


def _mentions(flagged: DataFrame) -> DataFrame:
    """A row per mention: ``key, entity, terms`` with the words around it."""
    at = F.explode("base").alias("s")
    text = F.col("text")
    rows = flagged.select("key", "text", "base", at)
    start, end = F.col("s.start"), F.col("s.end")
    left = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    right = F.substring(text, end + 1, F.lit(CONTEXT))
    # Words cut by the border of the context do not count.
    left = F.when(start > CONTEXT, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_TERM), F.lit(0))
    before, after = words(left), words(right)
    near = F.array_distinct(
        F.concat(F.slice(before, -F.least(F.size(before), F.lit(CONTEXT_WORDS)), CONTEXT_WORDS), F.slice(after, 1, CONTEXT_WORDS))
    )
    near = F.when(F.size(before) == 0, F.array_distinct(F.slice(after, 1, CONTEXT_WORDS))).otherwise(near)
    value = F.concat(F.col("s.kind"), F.lit(":"), F.lower(F.substring(text, start + 1, end - start)))
    return rows.select("key", value.alias("entity"), near.alias("terms"))


def _entities(text: Column, base: Column) -> Column:
    """Distinct identifiers of a text as ``kind:value``."""
    value = lambda parts, s: F.lower(S.cut(parts, s["start"], s["end"]))
    return S.let(
        S.chunks(text),
        lambda parts: F.array_distinct(F.transform(base, lambda s: F.concat(s["kind"], F.lit(":"), value(parts, s)))),
    )


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def disclosing_terms(
    docs: DataFrame,
    text_col: str = "text",
    min_support: int = MIN_SUPPORT,
    threshold: float = THRESHOLD,
    nearby: bool = False,
) -> DataFrame:
    """``key, term, disclosure``: per distinct text with identifiers, the terms that reveal one.

    ``key`` is the SHA-256 of the text. Support counts distinct texts, all other numbers count rows.
    With ``nearby`` a text holds a pair only where the term stands in the context of a mention.
    """
    text = F.col(text_col)
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = F.lit(float(total))
    flagged = (
        docs.select(text.alias("text"), identifier_spans(text).alias("base"))
        .where(F.size("base") > 0)
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text", "base")
    )
    each = stored(
        flagged.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text"), F.first("base").alias("base")),
        "pii-flagged",
    )
    mentioned = each.select("key", "rows", F.explode(_entities(F.col("text"), F.col("base"))).alias("entity"))
    # No pair has more support than its identifier; one that is in every document is told by nothing.
    entities = (
        mentioned.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count(F.lit(1)).alias("texts"))
        .where((F.col("texts") >= min_support) & (F.col("n_e") < n)).drop("texts")
    )
    mentioned = stored(mentioned.join(entities, "entity"), "pii-mentions")
    most = mentioned.agg(F.max("n_e").alias("n")).first()["n"]

    def within_reach(n_e: Column) -> Column:
        # As n(e, t) is at most n(e), a term of more documents than this stays under the threshold.
        return F.ln(n / F.col("n_t")) >= F.lit(float(threshold)) * F.ln(n / n_e) - 1e-9

    # Documents per term over the whole corpus: counts combine before the shuffle.
    in_corpus = (
        docs.where(text.isNotNull()).select(F.explode(_terms(text)).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
        .where((F.col("n_t") >= min_support) & within_reach(F.lit(float(most or 1))))
    )
    if nearby:
        words = _mentions(each).select("key", "entity", F.explode("terms").alias("term")).distinct()
        held = words.join(mentioned, ["key", "entity"]).join(in_corpus, "term")
    else:
        words = each.join(mentioned.select("key").distinct(), "key", "left_semi").select(
            "key", F.explode(_terms(F.col("text"))).alias("term")
        )
        held = words.join(in_corpus, "term").join(mentioned, "key")
    held = stored(
        held.where(within_reach(F.col("n_e"))).select("key", "rows", "entity", "n_e", "term", "n_t"), "pii-pairs"
    )
    revealing = (
        held.groupBy("entity", "term")
        .agg(
            F.sum("rows").alias("n_et"), F.count(F.lit(1)).alias("support"),
            F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"),
        )
        .where(F.col("support") >= min_support)
        .select(
            "entity", "term",
            (F.ln(F.col("n_et") * n / (F.col("n_e") * F.col("n_t"))) / F.ln(n / F.col("n_e"))).alias("disclosure"),
        )
        .where(F.col("disclosure") >= threshold)
    )
    return (
        held.select("key", "entity", "term").join(revealing, ["entity", "term"])
        .groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    )


def _term_spans(text: Column, base: Column, terms: Column, kind: str) -> Column:
    """Whole-word occurrences of the terms, outside the identifiers."""
    # Terms are runs of letters, so they need no escaping.
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    found = S.outside(S.matches(text, pattern), base)
    return F.when(F.size(terms) > 0, S.spans(found, kind, len(KINDS) + (kind == "cut"))).otherwise(S.no_spans())


def find_pii(
    docs: DataFrame,
    text_col: str = "text",
    min_support: int = MIN_SUPPORT,
    threshold: float = THRESHOLD,
    remove_at: float = REMOVE_AT,
    nearby: bool = False,
    base: str = "base_spans",
    spans: str = "spans",
) -> DataFrame:
    """The rows of ``docs`` with two array columns: identifier spans, and these with term spans.

    Spans are ``start, rank, end, kind`` in code points, end exclusive, sorted by start and then by
    kind: email, ip, card, phone, term (to be generalised), cut (to be removed). Null and empty
    texts have no spans, documents without identifiers get no term spans, equal rows get equal
    spans, an empty table gives no rows. The two names must be free in ``docs``.
    """
    key, found = fresh(docs, "_pii_key", "_pii_terms")
    text = F.col(text_col)
    terms = (
        disclosing_terms(docs, text_col, min_support, threshold, nearby)
        .groupBy(F.col("key").alias(key))
        .agg(F.collect_list(F.struct((F.col("disclosure") >= remove_at).alias("cut"), "term")).alias(found))
    )
    based = docs.withColumn(base, identifier_spans(text))
    # Clean rows take no part in the join and are not moved.
    clean = based.where(F.size(base) == 0).withColumn(spans, S.no_spans())
    dirty = based.where(F.size(base) > 0).withColumn(key, F.sha2(text.cast("binary"), 256)).join(terms, key, "left")

    def some(cut: bool) -> Column:
        own = F.filter(F.col(found), lambda t: t["cut"] == F.lit(cut))
        return F.array_sort(F.coalesce(F.transform(own, lambda t: t["term"]), F.array().cast("array<string>")))

    every = F.array_sort(
        F.concat(
            F.col(base),
            _term_spans(text, F.col(base), some(False), "term"),
            _term_spans(text, F.col(base), some(True), "cut"),
        )
    )
    dirty = dirty.withColumn(spans, every).select(*docs.columns, base, spans)
    return clean.select(*docs.columns, base, spans).unionByName(dirty)


def label(span: Column) -> Column:
    out = F.lit("")
    for kind, value in LABELS.items():
        out = F.when(span["kind"] == kind, F.lit(value)).otherwise(out)
    return out


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows with identifiers and revealing terms replaced in the text; all columns stay."""
    base, spans = fresh(docs, "_pii_base", "_pii_spans")
    found = find_pii(docs, text_col, base=base, spans=spans, **options)
    text = F.col(text_col)
    clean = F.when(F.size(spans) > 0, S.replaced(text, F.col(spans), label)).otherwise(text)
    return found.withColumn(text_col, clean).select(*docs.columns)
