"""Terms of texts, counted inside their document, on Arrow batches: what leaves a task is sums, or the sparse rows themselves."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T

#: Texts that are turned into rows together, sums that are held before they are passed on, terms whose hash is remembered.
SLICE, HELD, KNOWN = 250, 400_000, 300_000
#: Bytes of text that are weighed together where any term counts.
BUCKET = 16 << 20
_tokens = re.compile(T.TOKEN).findall
_STOP = frozenset(T.STOPWORDS)
_ENDS = tuple(T.SUFFIXES)
try:  # without the detour by OpenSSL, which costs more than a short digest
    from _md5 import md5 as _md5
    from _sha1 import sha1 as _sha1
except ImportError:
    _md5, _sha1 = hashlib.md5, hashlib.sha1


def unique(df: DataFrame, id: str) -> bool:
    """Whether no id is repeated, so that each text is all there is of its id; only ids are read and shuffled."""
    return not df.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


class Held(dict):
    """Values of terms, computed when first asked for; looked up without Python's interpreter. To be cleared when too many."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__()
        self.value = value

    def __missing__(self, term: str):
        out = self[term] = self.value(term)
        return out

    def of(self, terms) -> list:
        if len(self) > KNOWN:
            self.clear()
        return list(map(self.__getitem__, terms))


def stem(word: str) -> str:
    """As :func:`lexispark.functions.text.stem`."""
    if len(word) > 6 and word.endswith(_ENDS):
        for s in _ENDS:
            if word.endswith(s) and not (s == "s" and word.endswith("ss")):
                return word[: -len(s)]
    return word


def pairs(tokens: list[str]) -> list[str]:
    return list(map("_".join, itertools.pairwise(tokens)))


def hash_terms(bigrams: bool) -> Callable[[str], list[str]]:
    def terms(low: str) -> list[str]:
        tokens = [t for t in _tokens(low) if t not in _STOP]
        return tokens + pairs(tokens) if bigrams else tokens

    return terms


def tfidf_terms(bigrams: bool, stopwords: bool, stems: bool) -> Callable[[str], list[str]]:
    """Terms of a text, as often as they occur."""
    held = Held(stem)

    def terms(low: str) -> list[str]:
        tokens = _tokens(low)
        words = [t for t in tokens if t not in _STOP] if stopwords else tokens
        if bigrams:
            words = words + pairs(tokens)
        return held.of(words) if stems else words

    return terms


def _ids(df: DataFrame, id: str, text: str) -> tuple[DataFrame, str]:
    kind = df.select(id).schema[0].dataType.simpleString()
    return df.select(F.col(id).alias("key"), F.lower(F.col(text)).alias("low")).where(F.col("low").isNotNull()), kind


def _sums(totals: Counter, docs: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()), pa.array([docs[t] for t in totals], pa.int64())], ["term", "frequency", "doc_frequency"])


def term_totals(df: DataFrame, text: str, made: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """(term, frequency, doc_frequency) over all texts. A task sums before anything leaves it, ``HELD`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, docs, terms = Counter(), Counter(), made()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for low in batch.column(0).slice(lo, SLICE).to_pylist():
                    held = terms(low)
                    totals.update(held)
                    docs.update(set(held))
                    if len(totals) > HELD:
                        yield _sums(totals, docs)
                        totals.clear()
                        docs.clear()
        if totals:
            yield _sums(totals, docs)

    some = df.select(F.lower(F.col(text)).alias("low")).where(F.col("low").isNotNull())
    some = some.mapInArrow(run, "term string, frequency long, doc_frequency long")
    return some.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.sum("doc_frequency").alias("doc_frequency"))


def _rows(batch: pa.RecordBatch, per_slice) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, SLICE):
        some = batch.slice(lo, SLICE)
        doc, idx, weight = per_slice(some.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), pa.array(idx), pa.array(weight)], ["key", "idx", "weight"])


def _normal(doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    size = np.sqrt(np.bincount(doc, weight * weight, n))
    return weight / np.where(size > 0, size, 1.0)[doc]


def hasher(n: int, bigrams: bool, known: set[str], boost: float):
    """A function from lowered texts to (text, idx, normalised weight) by signed feature hashing."""
    terms, last = hash_terms(bigrams), 16 if n & (n - 1) else 4  # bytes of the digest that count

    def code(term: str) -> int:
        """idx * 4, and 2 for a negative sign, and 1 for a term of the domain."""
        raw = term.encode()
        return int.from_bytes(_md5(raw).digest()[-last:], "big") % n * 4 + (_sha1(raw).digest()[-1] & 1) * 2 + (term in known or term.replace("_", " ") in known)

    cache = Held(code)

    def per_slice(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, tf, sizes = [], [], []
        for low in texts:
            c = Counter(terms(low))
            codes += cache.of(c)
            tf += c.values()
            sizes.append(len(c))
        doc, c = np.repeat(np.arange(len(texts)), sizes), np.array(codes, np.int64)
        w = (1 + np.log(np.array(tf, float))) * np.where(c & 2, -1.0, 1.0) * np.where(c & 1, boost, 1.0)
        key, at = np.unique(doc * n + (c >> 2), return_inverse=True)
        weight = np.bincount(at, w, len(key))
        return key // n, key % n, _normal(key // n, weight, len(texts))

    return per_slice


def hash_rows(df: DataFrame, id: str, text: str, n: int, bigrams: bool, known: list[str], boost: float) -> DataFrame:
    """(id, idx, weight) of texts whose ids aren't repeated; nothing is shuffled."""
    some, kind = _ids(df, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_slice = hasher(n, bigrams, set(known), boost)
        for batch in batches:
            yield from _rows(batch, per_slice)

    return some.mapInArrow(run, f"key {kind}, idx long, weight double").withColumnRenamed("key", id)


def hash_vectors(low, n: int, bigrams: bool, known: list[str], boost: float):
    """The dense vector of each lowered text, null for one without any term, as a Column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        per_slice = hasher(n, bigrams, set(known), boost)
        for batch in batches:
            parts = [pa.array([], pa.list_(pa.float64()))]
            for lo in range(0, len(batch), SLICE):
                texts = [t or "" for t in batch.slice(lo, SLICE).to_pylist()]
                doc, idx, weight = per_slice(texts)
                held = np.zeros((len(texts), n))
                held[doc, idx] = weight
                void = np.bincount(doc, minlength=len(texts)) == 0
                ends = pa.array(np.arange(len(texts) + 1) * n, pa.int32())
                parts.append(pa.ListArray.from_arrays(ends, pa.array(held.ravel()), mask=pa.array(void)))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, "array<double>").asNondeterministic()(low)


def weighted_rows(df: DataFrame, id: str, text: str, made: Callable[[], Callable[[str], list[str]]], terms: list[tuple[str, int, float]], sublinear: bool, normal: bool) -> DataFrame:
    """(id, idx, weight) by (term, idx, factor) of ``terms``, for texts whose ids aren't repeated; nothing is shuffled."""
    some, kind = _ids(df, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, of = {t: k for k, (t, _, _) in enumerate(terms)}, made()
        number, factor = np.array([i for _, i, _ in terms], np.int64), np.array([f for _, _, f in terms], float)

        def per_slice(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, tf, sizes = [], [], []
            for low in texts:
                held = Counter(map(place.get, of(low)))  # terms that count for nothing go under None
                held.pop(None, None)
                at += held
                tf += held.values()
                sizes.append(len(held))
            doc, at, n = np.repeat(np.arange(len(texts)), sizes), np.array(at, np.int64), np.array(tf, float)
            weight = (1 + np.log(n) if sublinear else n) * factor[at]
            return doc, number[at], _normal(doc, weight, len(texts)) if normal else weight

        for batch in batches:
            yield from _rows(batch, per_slice)

    return some.mapInArrow(run, f"key {kind}, idx long, weight double").withColumnRenamed("key", id)


def n_terms(df: DataFrame, text: str, made: Callable[[], Callable[[str], list[str]]]) -> int:
    """How many terms all texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = made()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(terms(low)) for low in batch.column(0).to_pylist())], pa.int64())], ["n"])

    some = df.select(F.lower(F.col(text)).alias("low")).where(F.col("low").isNotNull())
    return some.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def bm25_rows(df: DataFrame, id: str, text: str, made: Callable[[], Callable[[str], list[str]]], terms: DataFrame, k1: float, b: float, average: float) -> DataFrame:
    """(id, term, weight) by (term, factor) of ``terms``, of which there may be any number, for texts whose ids aren't repeated.

    Texts are dealt into buckets of about ``BUCKET`` bytes and shuffled once; what is joined with ``terms`` are the distinct terms
    of a bucket, not those of each text.
    """
    some, kind = _ids(df, id, text)
    n = max(1, (some.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // BUCKET)
    some = some.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n))).repartition("bucket")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = made(), {}

        def flush() -> pa.RecordBatch:
            bucket = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(list(itertools.chain(*held.values())), pa.string())], ["bucket", "term"])

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                for bucket, low in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held.setdefault(bucket, set()).update(of(low))
                if sum(map(len, held.values())) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def weigh(texts: pa.Table, found: pa.Table) -> pa.Table:
        of, names = made(), found.column("term").combine_chunks()
        place = {t: k for k, t in enumerate(names.to_pylist())}
        factor = found.column("factor").to_numpy()
        at, tf, sizes, length = [], [], [], []
        for low in texts.column("low").to_pylist():
            tokens = of(low)
            held = Counter(map(place.get, tokens))  # terms that count for nothing go under None
            held.pop(None, None)
            at += held
            tf += held.values()
            sizes.append(len(held))
            length.append(len(tokens))
        doc, at, tf = np.repeat(np.arange(len(sizes)), sizes), np.array(at, np.int64), np.array(tf, float)
        weight = factor[at] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.array(length, float)[doc] / average)))
        key = texts.column("key").combine_chunks().take(pa.array(doc))
        return pa.table({"key": key, "term": names.take(pa.array(at)), "weight": _normal(doc, weight, len(sizes))})

    found = some.select("bucket", "low").mapInArrow(distinct, "bucket long, term string").join(terms, "term").select("bucket", "term", "factor")
    out = some.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(weigh, f"key {kind}, term string, weight double")
    return out.withColumnRenamed("key", id)
