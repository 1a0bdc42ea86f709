"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lexispark.llm._spark import cut, exact, load, released, without
from lexispark.llm._text import ALNUM, U64, Words, blocks, folded, grams, mix, table, utf8, words

#: A window of items and the words that a fingerprint covers: each window holds a fingerprint that is the
#: least of its WINDOW - GRAM + 1, so every shared span of WINDOW words shares one that is kept.
WINDOW, GRAM = 8, 5
_VALUES = folded(table(3))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bits of the filters that are sent to the executors: at most this many whatever the benchmark's size.
FILTER_BITS = 1 << 23


def tokens(data: np.ndarray, offs: np.ndarray) -> Words:
    """Lower-cased words."""
    return words(data, offs, ALNUM, _VALUES)


def winnow(found: Words) -> np.ndarray:
    """Positions of the words where fingerprints begin that some window keeps: the last least hash in each."""
    at, hashes = grams(found, GRAM)
    spare = WINDOW - GRAM + 1
    if not len(at):
        return at
    room = found.left()[at] - GRAM + 1  # grams from here to the end of the document
    lead = np.flatnonzero(room >= spare)
    best, where = hashes[lead], lead.copy()
    for i in range(1, spare):
        here = hashes[lead + i]
        less = here <= best
        best, where = np.where(less, here, best), np.where(less, lead + i, where)
    return np.unique(where)


def window_hash(found: Words, at: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(at), size, np.uint64)
    for i in range(size):
        h = h * U64(0xD1342543DE82EF95) + found.hash[at + i]
    return mix(h)


def _span(raw: bytes, found: Words, at: int, size: int) -> str:
    """The words from ``at``, lower-cased and one blank apart."""
    return b" ".join(raw[s:e] for s, e in zip(found.start[at : at + size], found.end[at : at + size], strict=True)).decode()


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, size, window): distinct windows of each item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, offs = utf8(batch.column(1))
            for i, j in blocks(offs):
                part = offs[i : j + 1]
                found, raw = tokens(data, part), _LOWER[data[part[0] : part[-1]]].tobytes()
                for k in range(j - i):
                    lo, n = int(found.first[k]), int(found.first[k + 1] - found.first[k])
                    rows += [(i + k, min(n, WINDOW), _span(raw, found, at, min(n, WINDOW))) for at in range(lo, lo + max(1, n - WINDOW + 1)) if n]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["item_id", "size", "window"])

    kind = benchmark.schema[item].dataType.simpleString()
    return exact(benchmark, item, text).mapInArrow(released(run), f"item_id {kind}, size int, window string").distinct()


def _filter_of(windows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit tables of fixed size: of the fingerprints that the windows keep, and of the windows themselves; sizes of windows shorter than WINDOW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bits, short = np.zeros(FILTER_BITS, np.bool_), np.zeros(FILTER_BITS, np.bool_), set()
        for batch in batches:
            data, offs = utf8(batch.column(1))
            size = batch.column(0).to_numpy(zero_copy_only=False)
            found = tokens(data, offs)
            for n in np.unique(size):
                lead = found.first[:-1][size == n]
                bits[window_hash(found, lead, int(n)) % U64(FILTER_BITS)] = True
                short |= {int(n)} - {WINDOW}
            hashes = np.zeros(len(found.start), np.uint64)
            at, h = grams(found, GRAM)
            hashes[at] = h
            marks[hashes[at[winnow(found)]] % U64(FILTER_BITS)] = True
        packed = [np.packbits(x).tobytes() for x in (marks, bits)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*packed, sorted(short)], (pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["marks", "bits", "short"])

    # 2 MB from each of at most 8 tasks
    parts = windows.select("size", "window").coalesce(8).mapInArrow(released(run), "marks binary, bits binary, short array<long>").collect()
    marks, bits = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        marks |= np.frombuffer(bytes(r.marks), np.uint8)
        bits |= np.frombuffer(bytes(r.bits), np.uint8)
    return marks, bits, sorted({n for r in parts for n in r.short})


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % U64(FILTER_BITS)
    return (bits[at >> U64(3)] >> (7 - (at & U64(7)).astype(np.uint8))) & 1 > 0


def covered(spans: Column) -> Column:
    """How many words an array of (at, size) in order covers, each once."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        spans,
        F.struct(zero.alias("end"), zero.alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["at"] + x["size"]).cast("long").alias("end"),
            (a["n"] + F.greatest(zero, x["at"] + x["size"] - F.greatest(a["end"], x["at"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )


def candidates(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with a row number, its words, and windows around kept fingerprints that may be an item's.

    Columns ``_row``, ``_words`` and ``_found`` (array of at, size, window, first byte, last byte) are added; clashing ones go.
    """
    marks, bits, short = _filter_of(windows)
    rest = docs.select(*[c for c in docs.columns if c.lower() not in ("_row", "_words", "_found")])
    names = [c for c in rest.columns if c != text]
    one = StructType([StructField(c, StringType() if c == "window" else LongType()) for c in ("at", "size", "window", "lo", "hi")])
    added = [StructField("_row", LongType()), StructField("_words", LongType()), StructField("_found", ArrayType(one))]
    schema = StructType([*[f for f in rest.schema.fields if f.name != text], *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            n, hits = [], []
            for i, j in blocks(offs):
                part = offs[i : j + 1]
                found = tokens(data, part)
                n.append(found.counts)
                at, hashes = grams(found, GRAM)
                keep = winnow(found)
                keep = at[keep][_has(marks, hashes[keep])]
                left = found.left()
                doc = found.docs()
                lead = np.unique((keep[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())  # extended to all windows that hold it
                lead = lead[(lead >= 0)]
                lead = lead[left[lead] >= WINDOW]
                cases = [(lead, WINDOW), *((np.flatnonzero(left >= size), size) for size in short)]
                raw = None
                for lead, size in cases:
                    lead = lead[_has(bits, window_hash(found, lead, size))]
                    if len(lead):
                        raw = raw or _LOWER[data[part[0] : part[-1]]].tobytes()
                        own = doc[lead]
                        base = part[own] - part[0]
                        hits += zip((i + own).tolist(), (lead - found.first[own]).tolist(), [size] * len(lead), [_span(raw, found, k, size) for k in lead], (found.start[lead] - base).tolist(), (found.end[lead + size - 1] - base).tolist(), strict=True)
            per: list[list] = [[] for _ in range(batch.num_rows)]
            for k, *x in hits:
                per[k].append(tuple(x))
            found_type = arrow.field("_found").type
            per_col = pa.array([[dict(zip(("at", "size", "window", "lo", "hi"), x, strict=True)) for x in p] for p in per], found_type)
            columns = [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(row + np.arange(batch.num_rows)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), per_col]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rest.mapInArrow(released(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 2) -> DataFrame:
    """A row for each document: key, n_words, n_hit, n_items, items (sorted strings), spans, contaminated.

    Words are those of the contract of the query below. A word is hit if it lies in an occurrence of an
    item's window of ``WINDOW`` consecutive words; ``spans`` are the hit stretches as byte offsets (lo, hi)
    of the UTF-8 text; contaminated are documents with windows of ``least`` items or more.

    Null, empty and wordless texts have no hits; null or wordless items never occur; repeated rows each have
    their own row; null keys and null item ids are values like others (a null item counts and is named
    ``null``); items with equal windows each count. Columns other than those named are ignored.

    Plan: documents are read once, without a shuffle of their texts. What leaves that pass is a slim row per
    document and windows that pass two bit tables of ``FILTER_BITS`` (broadcast, of fixed size); an equi-join
    on the window's words decides. A window's documents are thus rows of a join that adaptive execution can
    split, and hits are gathered by document only.
    """
    windows = cut(item_windows(benchmark, item, item_text), "item-windows")
    seen = cut(candidates(exact(docs, key, text), windows, text), "candidates")
    hits = seen.select("_row", F.explode("_found").alias("x")).select("_row", "x.*")
    hits = hits.join(windows.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"), F.col("size").alias("_size")), "window")
    hits = hits.where(F.col("size") == F.col("_size"))
    spans = F.array_sort(F.collect_set(F.struct("at", "size", "lo", "hi")))
    per = hits.groupBy("_row").agg(spans.alias("_spans"), F.array_sort(F.collect_set("_item")).alias("items"))
    joined = F.aggregate(
        "_spans",
        F.array().cast("array<struct<end:bigint,lo:bigint,hi:bigint>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["at"] <= F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.greatest(F.element_at(a, -1)["end"], x["at"] + x["size"]).alias("end"), F.element_at(a, -1)["lo"].alias("lo"), F.greatest(F.element_at(a, -1)["hi"], x["hi"]).alias("hi")))),
        ).otherwise(F.concat(a, F.array(F.struct((x["at"] + x["size"]).alias("end"), x["lo"].alias("lo"), x["hi"].alias("hi"))))),
        lambda a: F.transform(a, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))),
    )
    per = per.select("_row", "items", covered(F.col("_spans")).alias("n_hit"), joined.alias("spans"))
    done = seen.select(key, "_row", F.col("_words").alias("n_words")).join(per, "_row", "left")
    return done.select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"),
        (F.coalesce(F.size("items"), F.lit(0)) >= least).alias("contaminated"),
    )


def scrub(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated ones, and without the hit words of the others; see :func:`decontaminate`.

    Each hit stretch is cut out, from the first byte of its first word to the last of its last. Null texts
    stay null. Columns whose names clash with another one's, in any case, are left out, the first stays.
    """
    rest = without(docs, ["_id", "_cut", "_gone"], keep=(key, text))
    rest_id = F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text))
    found = decontaminate(rest.select(rest_id.alias("_id"), F.col(text).alias("_text")), benchmark, "_id", "_text", **names)
    found = found.where(F.size("spans") > 0).select("_id", F.col("spans").alias("_cut"), F.col("contaminated").alias("_gone")).dropDuplicates(["_id"])
    done = rest.withColumn("_id", rest_id).join(found, "_id", "left").where(~F.coalesce("_gone", F.lit(False)))
    raw = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut", lambda x: x["hi"]))
    ends = F.concat(F.transform("_cut", lambda x: x["lo"]), F.array(F.octet_length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    clean = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return done.select(*[clean.alias(c) if c == text else F.col(c) for c in rest.columns])


# ---------------------------------------------------------------------------------------------- query


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    done = decontaminate(exact(docs, "doc_id", "text"), exact(items, "item_id", "text"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS size, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
       FROM b, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM d, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(i) WHERE len(w) >= size),
h AS (SELECT r, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT r, i, size FROM h)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
