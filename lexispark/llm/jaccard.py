"""N-gram Jaccard self-join by chosen paths.

A run sends each set down a path of its own tokens, the least under seeded hashes: two sets of similarity
J choose the same token with probability J. A bucket that is still large is split by the next token; a
small one is compared by brute force. Runs are repeated until the target recall. What passes is verified
exactly on the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm._graph import components, local_roots
from lexispark.llm._spark import cut, drop_cut, exact, load, per_key, released, without
from lexispark.llm._text import SPACE, U64, Words, blocks, by_doc, grams, mix, powers, table, utf8, words

WIDTH = 5
DEPTH = 3
#: Sets in a bucket that is compared by brute force, and in a block of the exact comparison.
LEAF, BLOCK = 1000, 400
#: Tokens of a sketch, and how many of two sketches agree at least before sets are compared: at similarity
#: 0.8 fewer agree with a probability under 1e-8.
SKETCH, AGREE = 64, 32
_VALUES = table(6)
_SEEDS = np.random.default_rng(61).integers(0, 1 << 64, 256, np.uint64)


def runs_for(similarity: float, recall: float) -> int:
    """Runs until a pair of this similarity shares a whole path of DEPTH tokens with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**DEPTH))


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of WIDTH consecutive words, of all words where there are fewer; and offsets by document."""
    at, hashes = grams(found, WIDTH)
    n = found.counts
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(WIDTH - 1):
            here = n[short] > i
            whole[here] = mix(whole[here] + found.hash[found.first[short[here]] + i])
        at, hashes = np.concatenate([at, found.first[short]]), np.concatenate([hashes, mix(whole + n[short].astype(np.uint64))])
        order = np.argsort(at)
        at, hashes = at[order], hashes[order]
    return hashes, np.searchsorted(at, found.first)


def least(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The token that each set chooses under the k-th hash."""
    x = (hashes ^ _SEEDS[k]) * U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return by_doc(x, first, np.minimum, np.uint64(0))


def signatures(docs: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    """(key, same, h, path, sketch): h identifies the sequence of words (null without words), ``same`` the text."""
    wide = max(runs * DEPTH, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for i, j in blocks(offs):
                found = words(data, offs[i : j + 1], SPACE, _VALUES)
                hashes, first = shingles(found)
                some = found.counts > 0
                place = np.arange(len(found.hash)) - np.repeat(found.first[:-1], found.counts)
                top = int(place.max()) + 1 if len(place) else 1
                h = mix(by_doc(found.hash * powers(top)[place], found.first, np.add, np.uint64(0)) + found.counts.astype(np.uint64))
                chosen = np.stack([least(hashes, first, k) for k in range(wide)], axis=1)
                sketch = np.ascontiguousarray((chosen[:, :SKETCH] >> U64(7)).astype(np.uint16))
                path = chosen[:, : runs * DEPTH].astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(path) + 1, runs * DEPTH), pa.int32()), pa.array(path))
                raw = pa.Array.from_buffers(pa.binary(SKETCH * 2), j - i, [None, pa.py_buffer(sketch)]).cast(pa.binary())
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(h.astype(np.int64), mask=~some), lists, raw]
                yield pa.RecordBatch.from_arrays(columns, ["key", "same", "h", "path", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    picked = exact(docs, key, text).select(F.col(key), F.xxhash64(text).alias("same"), F.col(text))
    return picked.mapInArrow(released(run), f"key {kind}, same long, h long, path array<long>, sketch binary")


def whole_groups(batches: Iterator[pa.RecordBatch], by: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches in the order of ``by`` as tables that end where a group ends."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        joined = pa.Table.from_batches(kept)
        keys = joined.column(by).to_numpy()
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at:
            yield joined.slice(0, cut_at)
        rest = joined.slice(cut_at).combine_chunks()
        kept, held = rest.to_batches(), rest.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def alike(sketch: np.ndarray, group: np.ndarray, small: int = 48, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect what has sketches that agree often enough, within each group (equal values stand together).

    Of a group of more than ``small`` the fewest pairs that connect the same; no more than about ``most`` are held at a time.
    """
    n = len(group)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edges)
    left = np.repeat(edges[1:], sizes) - np.arange(n)  # to the end of the group, itself included
    little = np.repeat(sizes <= small, sizes)
    out_i, out_j = [], []
    for d in range(1, min(small, int(sizes.max())) if n else 0):
        i = np.flatnonzero(little & (left > d))
        for lo in range(0, len(i), 1 << 12):
            some = i[lo : lo + (1 << 12)]
            good = (sketch[some] == sketch[some + d]).sum(1) >= AGREE
            out_i.append(some[good])
            out_j.append(some[good] + d)
    for g in np.flatnonzero(sizes > small):
        lo, hi = int(edges[g]), int(edges[g + 1])
        own, root, held_i, held_j, held = sketch[lo:hi], np.arange(hi - lo), [], [], 0
        for k in range(hi - lo - 1):
            good = np.flatnonzero((own[k + 1 :] == own[k]).sum(1) >= AGREE) + k + 1
            held_i.append(np.full(len(good), k))
            held_j.append(good)
            held += len(good)
            if held >= most or k == hi - lo - 2:
                root = local_roots(hi - lo, np.concatenate([np.arange(hi - lo), *held_i]), np.concatenate([root, *held_j]))
                held_i, held_j, held = [], [], 0
        some = np.flatnonzero(root != np.arange(hi - lo))
        out_i.append(lo + root[some])
        out_j.append(lo + some)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or empty), np.concatenate(out_j or empty)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sets in the order of their buckets to the fewest edges that connect what is alike in each."""
    for part in whole_groups(batches, "bucket", 8000):
        h = part.column("h").to_numpy()
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        i, j = alike(sketch, part.column("bucket").to_numpy())
        if len(i):
            root = local_roots(len(h), i, j)
            at = np.flatnonzero(root != np.arange(len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(h[root[at]])], ["a", "b"])


def candidate_edges(classes: DataFrame, runs: int) -> DataFrame:
    """(a, b): edges that connect classes which some run brought into one bucket and whose sketches agree."""
    step = lambda k: F.get("path", F.col("run") + runs * k)
    rows = classes.select("h", "path", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.select("h", F.xxhash64("run", step(0)).alias("bucket"), *[step(k).alias(f"t{k}") for k in range(1, DEPTH)])
    for k in range(DEPTH):  # a set alone in its bucket leaves this run; a large bucket is split by the next token
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
        rows = per_key(rows, sizes, "bucket", "size")
        if k + 1 < DEPTH:
            rows = rows.withColumn("bucket", F.when(F.col("size") > LEAF, F.xxhash64("bucket", f"t{k + 1}")).otherwise(F.col("bucket"))).drop("size")
            rows = cut(rows, "buckets")
    rows = in_blocks(rows.select("h", "bucket", "size"), "bucket", "h", LEAF)
    rows = rows.join(classes.select("h", "sketch"), "h")
    return rows.select("bucket", "h", "sketch").repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(released(_bucket_edges), "a long, b long").distinct()


def in_blocks(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Groups of more than ``most`` rows (column ``size``) as all pairs of their blocks; ``side`` tells the two blocks of a pair apart.

    A group of n rows makes n / ``most`` copies of each row, so no group is ever in one task.
    """
    rows = rows.withColumn("_nb", F.ceil(F.col("size") / most).cast("int"))
    rows = rows.withColumn("_b", F.when(F.col("_nb") > 1, F.pmod(F.xxhash64(F.lit(5), member), F.col("_nb"))).otherwise(F.lit(0)).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.when(F.col("_nb") > 1, F.sequence(F.lit(0), F.col("_nb") - 1)).otherwise(F.array(F.lit(0)))))
    pair = F.when(F.col("_nb") > 1, F.xxhash64(group, F.least("_b", "_j"), F.greatest("_b", "_j"))).otherwise(F.col(group))
    return rows.withColumns({group: pair, "side": F.when(F.col("_b") == F.col("_j"), F.lit(0)).when(F.col("_b") < F.col("_j"), F.lit(1)).otherwise(F.lit(2))}).drop("_nb", "_b", "_j")


def verify(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose sets have at least this similarity; of two sides only pairs across them."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, which, df = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = df[which] > 1  # only these are in an intersection
    rank = np.cumsum(df > 1) - 1
    column, owner = rank[which[shared]], owner[shared]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((m, min(4096, top - lo)), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        both += dense @ dense.T
    both = both.astype(np.int64)
    close = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    i, j = np.nonzero(np.triu(close, 1))
    if side.any():
        across = side[i] != side[j]
        i, j = i[across], j[across]
    return i, j


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "comp", 1000):
            comp, h = part.column("comp").to_numpy(), part.column("h").to_numpy()
            once = np.concatenate([[True], (comp[1:] != comp[:-1]) | (h[1:] != h[:-1])])  # repeated rows gave a set more than once
            if not once.all():
                part, comp, h = part.filter(pa.array(once)), comp[once], h[once]
            side, weight = part.column("side").to_numpy(), part.column("n").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
            links, root = np.zeros(len(h), np.int64), h.copy()
            edges = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                i, j = verify(sets[lo:hi], side[lo:hi], similarity)
                np.add.at(links, lo + i, weight[lo + j])
                np.add.at(links, lo + j, weight[lo + i])
                root[lo:hi] = h[lo + local_roots(hi - lo, i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(links), pa.array(root)], ["h", "links", "root"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(3))
        for i, j in blocks(offs):
            hashes, first = shingles(words(data, offs[i : j + 1], SPACE, _VALUES))
            raw = [np.unique(hashes[first[k] : first[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(3)], pa.array(raw, pa.binary())], ["h", "comp", "n", "set"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """A row for each document: key, class_id, n_links, class_size, first.

    Two documents are linked if the Jaccard similarity of their sets of WIDTH-word shingles is ``similarity``
    or more; documents of fewer words have one shingle of all. Words are what ASCII white space separates,
    with regard to case. A class is a connected set of documents; ``class_id`` is its least key, ``n_links``
    the number of other documents that a document is linked with, ``first`` whether it is the one that
    stands for its class (least key; of equal keys that of the least text hash and, for repeated rows, one).

    Documents without words, null ones included, are linked with none and are a class each, named by their
    key. Repeated rows are copies. A null key is not taken for the least unless all are null. Other columns
    are ignored; an empty table gives an empty table.

    Equal sequences of words are one class from the start and are carried as a count, so copies meet in a
    partial aggregate only. Buckets of more than LEAF sets are split along the path, then dealt in pairs of
    blocks; so are components of more than BLOCK sets when they are verified. Pairs never become rows: a
    task counts them and passes on the fewest edges that connect its sets. Texts are shuffled once, to meet the
    classes that need their sets.
    """
    runs = runs_for(similarity, recall)
    seen = cut(signatures(docs, key, text, runs), "signatures")
    of_class = F.struct(F.col("key").isNull().alias("none"), "key", "same")
    # the sketch of a class is that of any member: equal words have equal sketches
    classes = cut(
        seen.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min(of_class).alias("lead"), F.first("path").alias("path"), F.first("sketch").alias("sketch")), "classes"
    )
    comps = components(candidate_edges(classes, runs))
    need = classes.select("h", "n", "lead").join(comps.withColumnRenamed("node", "h"), "h").select("h", F.col("root").alias("comp"), "n", F.col("lead.key").alias("_k"), F.col("lead.same").alias("_s"))
    texts = exact(docs, key, text).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_same"), F.col(text).alias("_text"))
    held = texts.join(need, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_same") == F.col("_s"))).select("h", "comp", "n", "_text")
    sets = held.mapInArrow(released(_sets), "h long, comp long, n long, set binary")
    sizes = comps.groupBy(F.col("root").alias("comp")).agg(F.count("*").alias("size"))
    dealt = in_blocks(sets.join(sizes, "comp"), "comp", "h", BLOCK)
    dealt = dealt.select("comp", "h", "side", "n", "set").repartition("comp").sortWithinPartitions("comp", "h")
    links = cut(dealt.mapInArrow(released(_verified(similarity)), "h long, links long, root long"), "links")
    roots = components(links, "h", "root").withColumnRenamed("node", "h")
    per = classes.select("h", "n", "lead").join(links.groupBy("h").agg(F.sum("links").alias("links")), "h", "left").join(roots, "h", "left")
    per = cut(per.withColumn("root", F.coalesce("root", "h")), "members")
    whole = cut(per.groupBy("root").agg(F.min("lead").alias("class"), F.sum("n").alias("class_size"), F.count("*").alias("members")), "whole")
    per = per_key(per, whole, "root", "members").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "class", "class_size")
    done = seen.select("key", "same", "h").join(per, "h", "left")
    return done.select(
        F.col("key").alias(key),
        "same",
        F.coalesce("class.key", "key").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("h").isNull() | (F.col("key").eqNullSafe(F.col("class.key")) & (F.col("same") == F.col("class.same")))).alias("first"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`, all columns kept; of repeated rows one stays.

    Columns whose names clash with another one's, in any case, are left out, the first stays.
    """
    found = near_duplicates(docs, key, text, **limits).where("first").select(F.col(key).alias("_first"), F.col("same").alias("_first_same")).distinct()
    rest = without(docs, ["_same", "_n", "_first", "_first_same"], keep=(key, text))
    rows = rest.withColumn("_same", F.xxhash64(text)).join(found, F.col(key).eqNullSafe(F.col("_first")) & (F.col("_same") == F.col("_first_same")))
    one = F.row_number().over(Window.partitionBy(key, "_same").orderBy("_same"))
    return rows.withColumn("_n", one).where("_n = 1").select(*rest.columns)


# ---------------------------------------------------------------------------------------------- query


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all documents."""
    done = near_duplicates(exact(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "class_id", "n_links", "class_size")
