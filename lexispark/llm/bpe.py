"""Byte-level BPE by corpus-level merge replay.

All distinct words of a batch of documents are held as one linked list of tokens. An inverted index
leads from the rank of a token pair to the positions where that pair stands; ranks are taken in order, a
rank is applied at all its positions at once, and only the neighbours of merged pairs are looked up anew.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from lexispark.llm._spark import exact, load, released, without
from lexispark.llm._text import U64, blocks, mix, powers, table, utf8

NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = range(4)
#: First and last code points that are letters or numbers only since Unicode 17; to the tokenizer library they are neither.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the splitting pattern tells them apart."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = m.span()
            out[a + 0x800 * (a >= 0xD800) : b + 0x800 * (b > 0xD800)] = kind
    for a, b in [(0xD800, 0xDFFF), *LATER]:
        out[a : b + 1] = OTHER
    return out


def split(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    r"""Where the matches of the splitting pattern begin in code points ``text``; documents begin at ``bounds``.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``. Its
    matches cover a text. Runs of one class are matches, but: a run of white space before something else
    gives up its last character, which joins what follows if it is a blank and stands alone otherwise; and
    a contraction is a match where an apostrophe begins one.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[text]
    first = np.zeros(n + 1, np.bool_)
    first[bounds] = True
    start = np.empty(n, np.bool_)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    space = kind == SPACE
    final = np.zeros(n, np.bool_)  # white space right before something else of its document
    final[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    blank = final & (text == 0x20)
    start |= final  # the last of a run begins a match: its own, or that of what follows
    start[1:] &= ~blank[:-1]  # what follows a blank is no longer the beginning
    quote = np.flatnonzero((text == 0x27) & start)
    if len(quote):
        at = lambda i: np.where(i < n, text[np.minimum(i, n - 1)], 0)
        end = np.searchsorted(bounds, quote, side="right")
        room = np.append(bounds, n)[np.minimum(end, len(bounds))] - quote
        a, b = at(quote + 1), at(quote + 2)
        short = (room >= 2) & np.isin(a, [ord(c) for c in "stmd"])
        pair = a.astype(np.int64) << 32 | b
        long = (room >= 3) & ~short & np.isin(pair, [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")])
        for found, size in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            after = found + size
            inside = after < n
            start[after[inside]] = True
            # a contraction that ends before a blank, or before more letters, begins nothing else
    return np.flatnonzero(start)


class Tokenizer:
    """A rank file: bytes of a token by rank, ranks of single bytes, and the rank that each pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        top = max(ranks.values()) + 1
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.merged = np.array([r for _, r in pairs] or [NONE], np.int32)
        # tokens that some neighbour may merge with at a lower rank than the token's own
        self.lower = np.zeros(top, np.bool_)
        if pairs:
            for side in (self.pair >> 32, self.pair & 0xFFFFFFFF):
                self.lower[side[self.merged < side]] = True
        a, b = np.meshgrid(self.single.astype(np.int64), self.single.astype(np.int64), indexing="ij")
        self.bytes_pair = self.rank(a.ravel(), b.ravel()).reshape(256, 256)
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the pairs (a, b) merge to, NONE where they don't."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], NONE)

    def replay(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words ``data[first[i]:first[i + 1]]``: all ids one after another, and offsets by word.

        A word's merges come out as a search for its lowest rank, leftmost first, would have them. Where the
        merged token can't form a pair of lower rank, all its positions are applied at once, every second
        one of a chain of overlapping pairs. Otherwise only the first of each word is applied, and the others
        are taken up again after any lower rank that this has brought about.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        token = self.single[data]
        word = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        after = np.arange(1, n + 1, dtype=np.int64)
        after[first[1:][np.diff(first) > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[first[:-1][np.diff(first) > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.bytes_pair[data[inner], data[inner + 1]]
        alive = np.ones(n, np.bool_)

        some = np.flatnonzero(rank != NONE)
        some = some[np.argsort(rank[some], kind="stable")]
        keys, starts = np.unique(rank[some], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(k): [p] for k, p in zip(keys, np.split(some, starts[1:]), strict=True)} if len(some) else {}
        heap = sorted(index)

        def put(ranks: np.ndarray, at: np.ndarray) -> None:
            good = ranks != NONE
            ranks, at = ranks[good], at[good]
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, at = ranks[order], at[order]
                edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate([[0], edges])].tolist(), np.split(at, edges), strict=True)
            elif len(ranks):
                groups = [(int(ranks[0]), at)]
            else:
                return
            for r, p in groups:
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(p)

        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and not self.lower[r]:
                joined = after[at[:-1]] == at[1:]
                if joined.any():
                    place = np.arange(len(at))
                    begin = np.concatenate([[True], ~joined])
                    at = at[(place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0]
            elif len(at) > 1:
                own = word[at]
                lead = np.empty(len(at), np.bool_)
                lead[0] = True
                np.not_equal(own[1:], own[:-1], out=lead[1:])
                if not lead.all():
                    put(np.full(int((~lead).sum()), r, np.int32), at[~lead])
                    at = at[lead]
            gone = after[at]
            far = after[gone]
            token[at] = r
            alive[gone] = False
            rank[gone] = NONE
            after[at] = far
            right = far >= 0
            before[far[right]] = at[right]
            fresh = np.full(len(at), NONE, np.int32)
            if right.any():
                fresh[right] = self.rank(token[at[right]], token[far[right]])
            rank[at] = fresh
            put(fresh, at)
            left = before[at]
            has = left >= 0
            if has.any():
                left = left[has]
                fresh = self.rank(token[left], token[at[has]])
                rank[left] = fresh
                put(fresh, left)
        counts = np.add.reduceat(alive, first[:-1][np.diff(first) > 0]) if n else np.zeros(0)
        sizes = np.zeros(len(first) - 1, np.int64)
        sizes[np.diff(first) > 0] = counts
        return token[alive], np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents ``data[offs[i]:offs[i + 1]]``, one after another, and offsets by document."""
        n = len(offs) - 1
        starts, hashes = [], []
        for i, j in blocks(offs, 1 << 19):
            part = data[offs[i] : offs[j]]
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            if not len(lead):
                continue
            text = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            bounds = np.searchsorted(lead, offs[i:j] - offs[i])
            begin = lead[split(text, np.unique(bounds[bounds < len(lead)]))]
            end = np.append(begin[1:], len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * powers(len(part))[: len(part)], out=sums[1:])
            hashes.append(mix((sums[end] - sums[begin]) * powers(len(part), True)[begin] + (end - begin).astype(np.uint64)))
            starts.append(begin + offs[i])
        if not starts:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        start = np.concatenate(starts)
        size = np.diff(start, append=offs[-1])
        per_doc = np.diff(np.searchsorted(start, offs))
        # distinct words by their hash, which the bytes then have to confirm
        _, lead, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        word_first = np.concatenate([[0], np.cumsum(size[lead])])
        distinct = gather(data, start[lead], size[lead])
        if not np.array_equal(size[lead][which], size) or not np.array_equal(gather(distinct, word_first[which], size), data[offs[0] : offs[-1]]):
            raise ValueError("two words share a hash")
        ids, ends = self.replay(distinct, word_first)
        counts = np.diff(ends)
        out = gather(ids, ends[:-1][which], counts[which])
        upto = np.concatenate([[0], np.cumsum(counts[which])])
        return out, upto[np.concatenate([[0], np.cumsum(per_doc)])]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id sequences ``ids[offs[i]:offs[i + 1]]``, one after another, and offsets by sequence."""
        size = self.ends[ids + 1] - self.ends[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return gather(self.blob, self.ends[ids], size), upto[offs]


def gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``source[start[i]:start[i] + size[i]]``, one after another."""
    out = np.empty(int(size.sum()), source.dtype)
    done = 0
    for lo in range(0, len(start), 1 << 18):  # index arrays stay in cache
        s, m = start[lo : lo + (1 << 18)], size[lo : lo + (1 << 18)]
        upto = np.cumsum(m)
        total = int(upto[-1]) if len(upto) else 0
        out[done : done + total] = source[np.arange(total) + np.repeat(s - (upto - m), m)]
        done += total
    return out


_BYTES = table(4)


@cache
def tokenizer(path: str) -> Tokenizer:
    """Built once in each Python worker."""
    return Tokenizer(path)


def _binary(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


#: Bytes of input that one step of a Python worker takes, whole rows at a time: bounds its memory.
STEP = 4 << 20


def _mapped(df: DataFrame, source: str, added: str, fn) -> DataFrame:
    rest = without(df, [added], keep=(source,))
    schema = StructType([*rest.schema.fields, StructField(added, BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for lo, hi in blocks(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), STEP):
                part = batch.slice(lo, hi - lo)
                columns = [*part.columns, fn(column.slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rest.mapInArrow(released(run), schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: the token ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor can read. The ids are those that the usual search for the
    lowest rank gives, without special tokens. Null and empty texts have no ids; a column named like
    ``ids``, in any case, is replaced; repeated rows are encoded each; an empty table stays empty. No row
    leaves its partition: ``STEP`` bytes of documents are the corpus whose distinct words are replayed.
    """

    def column(texts: pa.Array) -> pa.Array:
        found, offs = tokenizer(path).encode(*utf8(texts))
        return _binary(found.astype("<u4"), offs * 4)

    return _mapped(docs, text, ids, column)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a binary column of the bytes that ``ids`` stand for. Null ids count as none."""

    def column(encoded: pa.Array) -> pa.Array:
        encoded = pc.fill_null(encoded.cast(pa.large_binary()), b"")
        _, offsets, values = encoded.buffers()
        offs = np.frombuffer(offsets, np.int64)[encoded.offset : encoded.offset + len(encoded) + 1] if len(encoded) else np.zeros(1, np.int64)
        held = np.frombuffer(values, np.uint8)[offs[0] : offs[-1]] if values is not None else np.zeros(0, np.uint8)
        return _binary(*tokenizer(path).decode(np.frombuffer(held.tobytes(), "<u4").astype(np.int64), (offs - offs[0]) // 4))

    return _mapped(docs, ids, out, column)


# ---------------------------------------------------------------------------------------------- query


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of what the ids decode to."""
    docs = exact(load(spark, sf_dir, "documents"), "doc_id", "text")
    path = default_ranks()
    done = decode(encode(docs, path).drop("text"), path)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
