r"""Personal data: patterns find it, co-occurrence over the corpus finds the terms that give it away.

DataFrame operations only. Positions of matches come from what the pattern splits a text into: the lengths
of pieces and matches add up to offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm._spark import cut, exact, load, without

KINDS = ["email", "ip", "card", "phone"]
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The patterns of the contract, but so that a run of characters is tried from its beginning only (or from the
#: end of the match before) and nothing that was taken is given back in vain: the matches are the same, the time
#: is linear and Java's matcher does not recurse.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A term is a run of letters. MASK stands for a span, OUTSIDE is a term that no span has a part of.
TERM, MASK = r"\p{L}{3,}", "\uffff"
OUTSIDE = rf"(?<![\p{{L}}{MASK}])\p{{L}}{{3,}}+(?!{MASK})"
SPAN = "struct<start:bigint,k:int,kind:string,end:bigint>"
#: Terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def running_sum(x: Column) -> Column:
    """Running sums of an array of longs. Blocks of 256 keep the cost of growing arrays linear in its length."""
    zero = F.lit(0).cast("long")
    chunks = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda b: F.slice(x, b * 256 + 1, F.lit(256)))).otherwise(
        F.array().cast("array<array<bigint>>")
    )
    inner = lambda c: F.aggregate(c, F.array().cast("array<bigint>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), zero) + v)))
    total = lambda c: F.aggregate(c, zero, lambda a, v: a + v)
    before = F.aggregate(chunks, F.array(zero), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + total(c))))
    return F.flatten(F.zip_with(chunks, before, lambda c, o: F.transform(inner(F.coalesce(c, F.array().cast("array<bigint>"))), lambda v: v + o)))


def located(text: str, pattern: str, when: Column, name: str, df: DataFrame) -> DataFrame:
    """``df`` with ``name``: array of (start, end, hit) of the pattern's matches, in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "_hits": F.when(when, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none),
            "_parts": F.when(when, F.split(text, pattern, -1)).otherwise(none),
        }
    )
    df = df.withColumn("_sizes", F.transform(F.arrays_zip(F.slice("_parts", F.lit(1), F.size("_hits")).alias("p"), F.col("_hits").alias("h")), lambda z: (F.length(z["p"]) + F.length(z["h"])).cast("long")))
    df = df.withColumn("_ends", running_sum(F.col("_sizes")))
    found = F.transform(F.arrays_zip(F.col("_ends").alias("e"), F.col("_hits").alias("h")), lambda z: F.struct((z["e"] - F.length(z["h"])).alias("start"), z["e"].alias("end"), z["h"].alias("hit")))
    return df.withColumn(name, found).drop("_hits", "_parts", "_sizes", "_ends")


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(14, 19), digits).otherwise(F.lit("0"))),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _named(k: int, kind: str, found: Column) -> Column:
    """Matches of a kind that are valid, with its name."""
    good = F.filter(found, lambda x: _valid(kind, x["hit"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit")))


def base_spans(df: DataFrame, text: str = "_text", name: str = "_base") -> DataFrame:
    """``df`` with the spans of the patterns: array of (start, k, kind, end), by start and kind. ``text`` has no nulls."""
    for k, kind in enumerate(KINDS):
        when = F.contains(F.col(text), F.lit(NEEDS[kind])) if NEEDS[kind] else F.col(text).rlike("[0-9][ -]?[0-9]")
        df = located(text, PATTERNS[kind], when, f"_found{k}", df)
        df = df.withColumn(f"_found{k}", _named(k, kind, F.col(f"_found{k}")))
    found = [f"_found{k}" for k in range(len(KINDS))]
    return df.withColumn(name, F.array_sort(F.concat(*found))).drop(*found)


def _identity(key: str, text: str) -> Column:
    """Rows with equal keys and texts have equal identities; nulls count as values."""
    return F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text))


def spanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _text, _doc, _base): texts and the spans of the patterns."""
    df = exact(docs, key, text).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return base_spans(df.withColumn("_doc", _identity("_key", "_text")))


def outside_terms(text: str, base: str) -> Column:
    """Different terms of a whole text, without what lies in spans."""
    masked = redacted(F.col(text), F.col(base), lambda s: F.lit(MASK))
    return F.array_distinct(F.regexp_extract_all(F.lower(masked), F.lit(OUTSIDE), 0))


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _doc, _copy, _base, _values, _said): spans of the patterns, the values they hold and, beside values, all terms of the text. Texts are read once and stay."""
    df = spanned(docs, key, text)

    def entity(s: Column) -> Column:
        value = F.when(s["kind"] == "email", F.lower(s["hit"])).otherwise(F.regexp_replace(s["hit"], "[^0-9.]", ""))
        return F.concat_ws(":", s["kind"], value)

    slim = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.when(F.size("_base") > 0, outside_terms("_text", "_base"))
    return df.select(F.col("_key").alias(key), "_doc", F.xxhash64("_text").alias("_copy"), slim.alias("_base"), F.array_distinct(F.transform("_base", entity)).alias("_values"), terms.alias("_said"))


def disclosing_terms(seen: DataFrame, docs: DataFrame, support: int, probability: float, bits: float) -> tuple[DataFrame, DataFrame] | None:
    """Terms that give an entity away (term, sure), and (_doc, term) for all documents that hold a candidate.

    An entity is a value that the patterns found. With n documents, a term in n(t) of them, an entity in n(e),
    and both in n(t, e), wherever in the document: P(e | t) = n(t, e) / n(t) is ``probability`` or more, and
    log2(P(e | t) / P(e)) is ``bits`` or more. ``support``: different texts that hold both at least, so
    that copies of one text prove nothing. None where no term has that support.
    """
    texts = seen.where(F.size("_values") > 0).groupBy("_copy").agg(F.countDistinct("_doc").alias("n"), F.first("_values").alias("values"), F.first("_said").alias("terms"))
    texts = cut(texts, "pii-texts")
    rows = texts.select("_copy", "n", F.explode("values").alias("entity"))
    often = rows.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("n_e")).where(F.col("texts") >= support).drop("texts")
    # the values that stay come back to their text, so its terms move once, however many values it has
    told = rows.join(often, "entity").groupBy("_copy").agg(F.collect_list(F.struct("entity", "n_e")).alias("told"))
    pairs = texts.join(told, "_copy").select("n", "terms", F.explode("told").alias("e")).select("e.entity", "e.n_e", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_te"), F.first("n_e").alias("n_e")).where(F.col("texts") >= support)
    # n(t) isn't less than the documents with any entity that hold the term, so a term that fails on these fails
    around = texts.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n_around"))
    pairs = pairs.join(around, "term").where(F.col("n_te") >= probability * F.col("n_around")).drop("n_around", "texts")
    pairs = cut(pairs, "term-pairs")
    terms = pairs.select("term").distinct()
    many = terms.count()
    if not many:
        return None
    # whether a text holds a term is a question to its distinct words; only the candidates' rows go on
    held = docs.select("_doc", F.explode(outside_terms("_text", "_base")).alias("term"))
    held = cut(held.join(F.broadcast(terms) if many <= BROADCAST_TERMS else terms, "term", "left_semi"), "term-docs")
    n = docs.select("_doc").count()
    found = pairs.join(held.groupBy("term").agg(F.countDistinct("_doc").alias("n_t")), "term")
    given = F.col("n_te") / F.col("n_t")
    found = found.where((given >= probability) & (F.log2(given * n / F.col("n_e")) >= bits))
    return found.groupBy("term").agg(F.max(given).alias("sure")), held


def term_spans(docs: DataFrame, text: str, terms: DataFrame, held: DataFrame, remove: float) -> DataFrame:
    """(_doc, _terms): spans of the disclosing terms in the documents that hold one, with what becomes of each."""
    per = held.join(terms, "term").groupBy("_doc").agg(F.map_from_entries(F.collect_set(F.struct("term", (F.col("sure") >= remove).alias("gone")))).alias("_map"))
    df = docs.join(per, "_doc").dropDuplicates(["_doc"])
    df = located(text, TERM, F.lit(True), "_words", df)
    good = F.filter("_words", lambda x: F.map_contains_key(F.col("_map"), F.lower(x["hit"])))
    spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), F.when(F.col("_map")[F.lower(x["hit"])], F.lit("removed")).otherwise(F.lit("term")).alias("kind"), x["end"].alias("end")))
    return df.select("_doc", spans.alias("_terms"))


def _all_spans(base: Column, terms: Column) -> Column:
    """Base spans, and term spans that overlap none of them."""
    terms = F.coalesce(terms, F.array().cast(f"array<{SPAN}>"))
    free = F.filter(terms, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return F.array_sort(F.concat(base, free))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, probability: float = 0.5, bits: float = 5.0, remove: float = 0.95) -> DataFrame:
    """A row for each document: key, _doc, base, spans; arrays of (start, k, kind, end) in code points, by start and kind.

    ``base`` has what the patterns found, each kind leftmost and without overlaps of its own; ``spans`` adds
    the terms that disclose an entity (see :func:`disclosing_terms`): kind ``term`` where the term is to be
    generalised, ``removed`` where P(e | t) is ``remove`` or more. Terms inside base spans are not added.

    Null and empty texts have no spans; null and repeated keys are values like others; repeated rows have a
    row each and count once as documents; other columns are ignored; an empty table gives an empty table.

    Texts don't move: spans are written and, for texts with values, their different terms. Statistics are
    aggregates of these, a value that enough texts hold being paired with each term of its texts. Only texts
    that hold a disclosing term are joined with it.
    """
    seen = cut(scan(docs, key, text), "pii-spans")
    base = exact(docs, key, text).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.select(_identity("_key", "_text").alias("_doc"), "_text")
    told = disclosing_terms(seen, spanned(docs, key, text), support, probability, bits)
    if told is None:
        return seen.select(key, "_doc", F.col("_base").alias("base"), F.col("_base").alias("spans"))
    extra = cut(term_spans(base, "_text", *told, remove), "term-spans")
    return seen.join(extra, "_doc", "left").select(key, "_doc", F.col("_base").alias("base"), _all_spans(F.col("_base"), F.col("_terms")).alias("spans"))


def redacted(text: Column, spans: Column, label=None) -> Column:
    """The text with ``[EMAIL]`` and so on in place of spans, nothing in place of removed terms, or what ``label`` makes of a span. Overlapping spans are one, named by the first."""
    whole = "array<struct<start:bigint,kind:string,end:bigint>>"
    one = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    last = lambda a: F.element_at(a, -1)
    apart = F.aggregate(
        spans,
        F.array().cast(whole),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), last(a)["kind"].alias("kind"), F.greatest(last(a)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(one(s)))),
    )
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(apart, lambda s: s["end"]))
    label = label or (lambda s: F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    pieces = F.zip_with(apart, F.slice(ends, 1, F.size(apart)), lambda s, e: F.concat(F.substring(text, (e + 1).cast("int"), (s["start"] - e).cast("int")), label(s)))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))))


def sanitize(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with ``text`` sanitised and a column pii_spans (spans of the text before), see :func:`detect`.

    A null text stays null. A column that clashes with pii_spans, in any case, is replaced.
    """
    found = detect(docs, key, text, **thresholds).select("_doc", F.col("spans").alias("pii_spans")).where(F.size("spans") > 0).dropDuplicates(["_doc"])
    rest = without(docs, ["pii_spans", "_doc", "_key", "_text"], keep=(key, text))
    columns = [c for c in rest.columns]
    rest = rest.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_doc", _identity(key, "_text"))
    done = rest.join(found, "_doc", "left")
    spans = F.coalesce("pii_spans", F.array().cast(f"array<{SPAN}>"))
    clean = F.when(F.col(text).isNotNull(), redacted(F.col(text), spans))
    return done.select(*[clean.alias(c) if c == text else F.col(c) for c in columns], spans.alias("pii_spans"))


# ---------------------------------------------------------------------------------------------- query


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all documents."""
    done = detect(exact(load(spark, sf_dir, "documents"), "doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, KINDS), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
