import base64
import hashlib
import random
from itertools import chain

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from lexispark.llm import bpe
from lexispark.llm._text import utf8

P = pytest.importorskip("public_tokenizers")
ALPHABET = "aAbsStTrevmldé ß\n\t\r   \x1c\x1f'''’.,!?()0123½²中文😀é-_  <|"


@pytest.fixture(scope="module")
def both():
    path = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Tokenizer(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(tok, texts):
    data, offs = utf8(pa.array(texts, pa.string()))
    ids, ends = tok.encode(data, offs)
    back, b = tok.decode(ids, ends)
    blob = back.tobytes()
    return [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])], [blob[i:j] for i, j in zip(b[:-1], b[1:])]


def test_against_the_library(both):
    tok, lib = both
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 60))) for _ in range(4000)]
    texts += ["", "'s", "x's's'tail", "\n's 's", "a  b", "  ", "a \n b", "don't we'll they'Re I'VE", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000, "the quick\n\n\nfox   ", "1234567 89"]
    got, back = run(tok, texts)
    for text, ids, raw in zip(texts, got, back):
        assert ids == lib.encode_ordinary(text), repr(text)
        assert raw.decode() == text


def test_documents(both):
    import pyarrow.parquet as pq

    tok, lib = both
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    got, back = run(tok, [*texts, None])
    assert got == [lib.encode_ordinary(t) for t in texts] + [[]]
    assert back == [t.encode() for t in texts] + [b""]


def test_split_of_every_code_point():
    later = {c for a, b in bpe.LATER for c in range(a, b + 1)}
    found = [chr(c) for c in chain(range(1, 0xD800), range(0xE000, 0x110000), range(0x20, 0x3000)) if c not in later]
    rng = random.Random(1)
    rng.shuffle(found)
    text = "".join(c + rng.choice(("", "a", " ", "1", "'s")) for c in found)
    expected = [m.start() for m in regex.finditer(P.PATTERN, text)]
    got = bpe.split(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]))
    assert got.tolist() == expected


def test_classes_are_those_of_the_library():
    """A rank for x (or 1, or !) and a lead byte shows whether the library keeps that and a code point in one piece."""
    ranks = {bytes([i]): i for i in range(256)}
    for x in b"x1!":
        for i in range(256):
            ranks[bytes([x, i])] = len(ranks)
    lib = tiktoken.Encoding("classes", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [*range(0x80, 0xD800), *range(0xE000, 0xE010), *range(0x10000, 0x20000), *range(0x2A6D0, 0x2B750), *range(0x32390, 0x33490)]
    kinds = bpe.classes()[points]
    for x, kind in (("x", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)):
        joined = np.array([ids[0] != ord(x) for ids in lib.encode_ordinary_batch([x + chr(c) for c in points])])
        assert np.array_equal(joined, kinds == kind)


def test_small_ranks_against_brute_force(tmp_path):
    """Ranks in an order that makes a merge bring about a lower one."""
    rng = random.Random(5)
    ranks = {bytes([i]): i for i in range(256)}
    pool = ["".join(rng.choices("abc", k=rng.randrange(2, 5))).encode() for _ in range(60)]
    for t in dict.fromkeys(pool):
        ranks[t] = len(ranks)
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    lib = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in range(2000)]
    # whole words that are tokens are not searched by the library; both ways give tokens of the same text
    got, _ = run(bpe.Tokenizer(str(path)), texts)

    def slow(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert got == [slow(t.encode()) for t in texts]
    assert sum(g == lib.encode_ordinary(t) for g, t in zip(got, texts)) > 1900


def test_frames(spark, tmp_path):
    rows = [(1, "the cat", 1), (2, None, 2), (None, "", 3), (1, "the cat", 1), (5, "x" * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    done = bpe.decode(bpe.encode(df, bpe.default_ranks()), bpe.default_ranks())
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in done.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(df.limit(0), bpe.default_ranks()).count() == 0
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op4_bpe(spark, str(tmp_path)).collect()
    assert len(got) == 5 and sum(r.decoded_sha256 == hashlib.sha256(b"").hexdigest() for r in got) == 2
