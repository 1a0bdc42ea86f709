"""Removal of long repeated byte strings by distributed prefix doubling.

A rank names the string of some length that begins at a position; two positions have equal ranks if their
strings are equal. Rank pairs at growing offsets (1, 2, 4 ... 128, then 256 and the threshold) give ranks of
longer strings. The offsets that stay within a document's row are applied there; Spark sorts what is left by
rank twice, and what is unique then leaves: first sampled positions by their ranks for 128 bytes, then all
positions by their ranks for the threshold where the sample inside is still repeated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm._spark import cut, drop_cut, exact, load, released
from lexispark.llm._text import U64, blocks, mix, table, utf8

#: Length of the strings that are sampled; a sample is kept in every stretch of the threshold's length.
SAMPLE = 128
#: Bytes of text that one task takes at a time when texts meet what is known of them.
GROUP = 8 << 20
#: Bits of the filter that keeps texts without any repeated sample where they are; of this size for any input.
FILTER_BITS = 1 << 25
_VALUES = table(10)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * U64(0x9E3779B97F4A7C15) + b
    x ^= x >> U64(32)
    return x * U64(0xD6E8FEB86659FD93)


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _double(rank: np.ndarray, have: int, want: int) -> np.ndarray:
    """Ranks for ``want`` bytes from those for ``have``; what runs over the end is void."""
    while have * 2 <= want:
        rank = _pair(rank, _shift(rank, have))
        have *= 2
    return _pair(rank, _shift(rank, want - have)) if want > have else rank


def _slide(x: np.ndarray, width: int, op: np.ufunc, void: int) -> np.ndarray:
    """``op`` over ``x[i:i + width]``."""
    have = 1
    while have < width:
        by = min(have, width - have)
        out = np.full_like(x, void)
        if by < len(x):
            op(x[: len(x) - by], x[by:], out=out[: len(x) - by])
        x = out
        have += by
    return x


def ranks(part: np.ndarray, rest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks for SAMPLE bytes, the least of them in the ``length`` bytes from each position (0 near the end), and which positions are samples.

    ``rest`` has the bytes from each position to the end of its document.

    Each stretch of ``length`` bytes keeps the samples of least rank in it, so equal stretches keep the same.
    """
    short = _double(_VALUES[part], 1, SAMPLE)
    width = length - SAMPLE + 1
    low = _slide(short, width, np.minimum, 0)
    low[rest < length] = 0
    # a slide over the reversed array looks to the left; padding gives its end room
    high = _slide(np.concatenate([low[::-1], np.zeros(width, np.uint64)]), width, np.maximum, 0)[: len(low)]
    best = high[::-1]
    return short, low, (best == short) & (best > 0)


def _rest(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])


def _samples(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, w, texts = _once(batch)
            data, offs = utf8(texts)
            for i, j in blocks(offs, 1 << 17):
                bounds = offs[i : j + 1] - offs[i]
                if (np.diff(bounds) < length).all():
                    continue
                short, _, is_sample = ranks(data[offs[i] : offs[j]], _rest(bounds), length)
                at = np.flatnonzero(is_sample)
                own = np.searchsorted(bounds, at, side="right") - 1
                columns = [short[at].astype(np.int64), t1[i + own], t2[i + own], (at - bounds[own]).astype(np.int64), w[i + own]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rank", "t1", "t2", "at", "w"])

    return run


def _once(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Different texts of a batch (columns t1, t2, text), and how often each occurs."""
    t1, t2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    _, lead, n = np.unique(np.stack([t1, t2]), axis=1, return_index=True, return_counts=True)
    return t1[lead], t2[lead], n.astype(np.int64), batch.column(2).take(pa.array(lead))


def _filtered(marks: np.ndarray):
    """Texts that the filter lets pass, each once with its number in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) % U64(FILTER_BITS)
            good = (marks[h >> U64(3)] >> (7 - (h & U64(7)).astype(np.uint8))) & 1 > 0
            if good.any():
                t1, t2, w, texts = _once(batch.filter(pa.array(good)))
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(w), texts], ["t1", "t2", "w", "text"])

    return run


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit table of the long column ``t1``: words of 64 bits, merged in each task before the shuffle; FILTER_BITS / 64 rows at most reach the driver."""
    at = F.col("t1").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(t1 & 63 as int))")
    words = ids.select(F.shiftright(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


#: A name of a string of the threshold's length: two independent hashes, 96 bits in all.
NAME = np.dtype([("rank", "<u8"), ("check", "<u4")])
PRIME, BASE = U64(4_294_967_291), U64(2_654_435_761)
INVERSE = U64(pow(int(BASE), -1, int(PRIME)))
_POWERS: dict[int, np.ndarray] = {}


def _prime_powers(n: int, base: np.uint64) -> np.ndarray:
    """Powers 0 to n of ``base`` modulo PRIME."""
    have = _POWERS.get(int(base))
    if have is None or len(have) <= n:
        have = np.ones(1, np.uint64)
        step = base
        while len(have) <= n:  # doubled: the next ones are those before times one power
            have = np.concatenate([have, have * step % PRIME])
            step = step * step % PRIME
        _POWERS[int(base)] = have
    return have


class _Group:
    """The different texts of a group in a fixed order, and the positions whose long ranks are to be compared."""

    def __init__(self, texts: pa.Table, known: pa.Table, length: int):
        t1, t2 = (texts.column(c).to_numpy() for c in ("t1", "t2"))
        order = np.lexsort((t2, t1))
        fresh = np.ones(len(order), np.bool_)
        fresh[1:] = (t1[order][1:] != t1[order][:-1]) | (t2[order][1:] != t2[order][:-1])
        lead = order[fresh]
        self.t1, self.t2 = t1[lead], t2[lead]
        self.copies = np.add.reduceat(texts.column("w").to_numpy()[order], np.flatnonzero(fresh)) if len(order) else np.zeros(0, np.int64)
        self.data, self.offs = utf8(texts.column("text").take(pa.array(lead)))
        k1, k2, at = (known.column(c).to_numpy() for c in ("t1", "t2", "at"))
        order = np.lexsort((k2, k1))
        self.known = k1[order], k2[order], at[order]
        self.length = length

    def _of(self, k: int) -> np.ndarray:
        k1, k2, at = self.known
        lo, hi = np.searchsorted(k1, self.t1[k]), np.searchsorted(k1, self.t1[k], side="right")
        return at[lo:hi][k2[lo:hi] == self.t2[k]]

    def steps(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts i to j, where they begin in the step's bytes, positions to compare, and their ranks for the threshold."""
        for i, j in blocks(self.offs, 1 << 17):
            bounds = self.offs[i : j + 1] - self.offs[i]
            rest = _rest(bounds)
            short, low, _ = ranks(self.data[self.offs[i] : self.offs[j]], rest, self.length)
            again = np.sort(short[np.concatenate([bounds[k - i] + self._of(k) for k in range(i, j)])])
            if not len(again):
                continue
            # equal strings hold the same sample of least rank, and that one is then repeated
            at = np.flatnonzero((again[np.minimum(np.searchsorted(again, low), len(again) - 1)] == low) & (rest >= self.length))
            yield i, j, bounds, at, self._named(_double(short, SAMPLE, self.length)[at], self.data[self.offs[i] : self.offs[j]], at)

    def _named(self, rank: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks with 32 bits of a second, independent name of the same bytes: a polynomial in them modulo a prime."""
        out = np.empty(len(rank), NAME)
        out["rank"] = mix(rank)
        sums = np.zeros(len(part) + 1, np.uint64)
        weights = _prime_powers(len(part), BASE)
        # the sum of byte * power, reduced often enough to stay below 2 ** 64
        for lo in range(0, len(part), 1 << 15):
            some = part[lo : lo + (1 << 15)].astype(np.uint64) + U64(1)
            sums[lo + 1 : lo + 1 + len(some)] = (sums[lo] + np.cumsum(some * weights[lo : lo + len(some)])) % PRIME
        value = (sums[at + self.length] + PRIME - sums[at]) % PRIME
        out["check"] = (value * _prime_powers(len(part), INVERSE)[at] % PRIME).astype(np.uint32)  # as if it began at 0
        return out


def _compare(length: int, buckets: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [x for *_, x in _Group(left, right, length).steps()] if left.num_rows else []
        rank = np.concatenate(found or [np.zeros(0, NAME)])
        bucket = _bucket(rank["rank"], buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        held = np.split(rank[order], edges[1:]) if len(edges) else []
        s = [key[0].as_py()] * len(held)
        return pa.table([pa.array(s, pa.int64()), pa.array(bucket[order][edges], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], ["s", "bucket", "ranks"])

    return run


def _bucket(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _repeated(part: pa.Table) -> pa.Table:
    """For each list of ranks in a bucket a bit by rank: whether it occurs elsewhere in the bucket."""
    lists = [np.frombuffer(x, NAME) for x in part.column("ranks").to_pylist()]
    rank = np.concatenate(lists)
    order = np.lexsort((rank["check"], rank["rank"]))
    rank = rank[order]
    same = (rank["rank"][1:] == rank["rank"][:-1]) & (rank["check"][1:] == rank["check"][:-1])
    twice = np.zeros(len(rank), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(x) for x in lists])[:-1])]
    return pa.table([part.column("s"), part.column("bucket"), pa.array(bits, pa.binary())], ["s", "bucket", "bits"])


def _remove(length: int, buckets: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            known = right.filter(pa.compute.is_valid(right.column("at")))
            masks = right.filter(pa.compute.is_valid(right.column("bucket")))
            group = _Group(left, known, length)
            steps = list(group.steps())
            rank = np.concatenate([x for *_, x in steps] or [np.zeros(0, NAME)])["rank"]
            bucket = _bucket(rank, buckets)
            order = np.argsort(bucket, kind="stable")
            sizes = dict(zip(*np.unique(bucket, return_counts=True), strict=True))
            bits = {b: np.unpackbits(np.frombuffer(x, np.uint8))[: sizes[b]] for b, x in zip(masks.column("bucket").to_pylist(), masks.column("bits").to_pylist(), strict=True)}
            twice = np.zeros(len(rank), np.bool_)
            if len(rank):
                twice[order] = np.concatenate([bits[b] for b in sorted(sizes)]) > 0
            done = 0
            for i, j, bounds, at, x in steps:
                at = at[twice[done : done + len(x)]]
                done += len(x)
                cover = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + length, 1)
                gone = np.cumsum(cover[:-1]) > 0
                for k in range(i, j):
                    lo, hi = bounds[k - i], bounds[k - i + 1]
                    own = gone[lo:hi]
                    if group.copies[k] > 1 and hi - lo >= length:
                        own = np.ones(hi - lo, np.bool_)
                    if own.any():
                        edge = np.diff(own.astype(np.int8), prepend=0, append=0)
                        spans = np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1)
                        kept = group.data[group.offs[k] : group.offs[k + 1]][~own]
                        rows.append((int(group.t1[k]), int(group.t2[k]), int(own.sum()), [dict(lo=int(a), hi=int(b)) for a, b in spans], hashlib.sha256(kept.tobytes()).hexdigest()))
        return pa.Table.from_pylist([dict(zip(_DONE.names, r, strict=True)) for r in rows], schema=_DONE)

    return run


_DONE = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """A row for each document: key, n_bytes, n_removed, spans, kept_sha256.

    ``spans`` (lo, hi) are the maximal runs of bytes of the UTF-8 text that lie in some string of ``length``
    bytes (SAMPLE or more) which also begins at another position of any document; kept_sha256 is the hex
    digest of the other bytes. All is judged on the input. Strings don't cross documents; null texts are
    empty; texts shorter than ``length`` lose nothing; of equal texts of that length each loses all. Null and
    repeated keys are values like others; other columns are ignored; an empty table gives an empty table.

    What is removed is decided by names of 96 bits (two independent hashes), so that two different strings are
    taken for equal with a probability of pairs / 2**96; the 64-bit ranks of samples only choose what is compared. Equal texts are carried once for each batch that reads them, with a count. Samples are sorted by
    rank as rows (about one for each 137 bytes); ranks for the whole length travel packed, 12 bytes each, only
    from texts and places whose sample of least rank is repeated, and come back as bits. No group of equal ranks is
    gathered but within a bucket of ranks, whose size the number of buckets bounds unless one string makes up
    most of the input. Each step's input is written or recomputed from written tables, so lost executors cost
    their own tasks.
    """
    if length < SAMPLE:
        raise ValueError(f"length is less than {SAMPLE}")
    base = exact(docs, key, text).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select(key, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(10), F.col("text")).alias("t2"), "text")
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP))
    buckets = 2 * groups
    long_enough = base.where(F.octet_length("text") >= length).select("t1", "t2", "text")

    samples = cut(long_enough.mapInArrow(released(_samples(length)), "rank long, t1 long, t2 long, at long, w long"), "samples")
    # written, so that the join below reads two plain exchanges and adaptive execution can split a rank that is everywhere
    again = cut(samples.groupBy("rank").agg(F.sum("w").alias("n")).where("n > 1").select("rank"), "repeated-ranks")
    group_of = F.pmod(F.xxhash64(F.lit(2), "t1", "t2"), F.lit(groups)).alias("s")
    known = cut(samples.join(again, "rank", "left_semi").select("t1", "t2", "at").distinct().select(group_of, "t1", "t2", "at"), "repeated-samples")
    drop_cut(samples)
    drop_cut(again)

    texts = long_enough.mapInArrow(released(_filtered(_marks(known))), "t1 long, t2 long, w long, text string").select(group_of, "t1", "t2", "w", "text")
    packed = texts.groupBy("s").cogroup(known.groupBy("s")).applyInArrow(_compare(length, buckets), "s long, bucket long, ranks binary")
    bits = packed.groupBy("bucket").applyInArrow(_repeated, "s long, bucket long, bits binary")
    none = lambda kind: F.lit(None).cast(kind)
    right = known.select("s", "t1", "t2", "at", none("long").alias("bucket"), none("binary").alias("bits")).unionByName(
        cut(bits, "bits").select("s", none("long").alias("t1"), none("long").alias("t2"), none("long").alias("at"), "bucket", "bits")
    )
    schema = "t1 long, t2 long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_sha256 string"
    found = texts.groupBy("s").cogroup(right.groupBy("s")).applyInArrow(_remove(length, buckets), schema)
    all_docs = base.select(key, "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    done = all_docs.join(found, ["t1", "t2"], "left")
    return done.select(
        key,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


# ---------------------------------------------------------------------------------------------- query


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes in all documents."""
    done = remove_repeats(exact(load(spark, sf_dir, "documents"), "doc_id", "text"), length=400)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
