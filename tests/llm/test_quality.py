import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lexispark.llm import quality
from lexispark.llm._text import utf8

ODD = ["", " ", "\n\n", "a", "a a a a a a a", "x\n\nx\n x\nx \ny", "é é# |\r\né é# |\r\n", "a\tb\x0bc\x0cd e f g h i j a\tb c d e f g h i j k", "b" * 70_000, "w " * 40_000, "\x1c\x1d a b"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    alpha = sum(bool(re.search(r"[A-Za-z\x80-\U0010ffff]", w)) for w in words)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), lines, alpha, len(set(words))]


def test_counts():
    texts = [*ODD, None, *pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    got = quality.counts(*utf8(pa.array(texts, pa.string())))
    assert got.tolist() == [brute(t) for t in texts]
    # documents side by side don't run into one another
    assert quality.counts(*utf8(pa.array(["a", "a", "a", "a", "a"] * 3))).tolist() == [brute("a")] * 15
    sliced = pa.array(texts, pa.string()).slice(3, 7)
    assert quality.counts(*utf8(sliced)).tolist() == [brute(t) for t in texts[3:10]]


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    v = np.zeros((len(good), 4), int)
    for k, (g, b) in enumerate(((0.98, 0.5), (0.97, 0.6), (0.99, 0.4), (0.98, 0.5))):
        v[:, k] = np.where(good, np.where(rng.random(len(good)) < g, 1, -1), np.where(rng.random(len(good)) < b, -1, 1))
        v[rng.random(len(good)) < 0.1, k] = 0
    pattern, n = np.unique(quality.encode_votes(v), return_counts=True)
    m = quality.fit(quality.decode_votes(pattern, 4), n)
    assert abs(m["prior"] - 0.85) < 0.03
    assert np.abs(m["right_good"] - [0.98, 0.97, 0.99, 0.98]).max() < 0.02 and np.abs(m["right_bad"] - [0.5, 0.6, 0.4, 0.5]).max() < 0.08
    assert ((m["posterior"](v) >= 0.5) == good).mean() > 0.93  # with the true accuracies it is 0.94


def test_labels(spark):
    """Against labels that the rules never saw."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    clean = [r for r in got if r.label and not r.base_failed]
    assert sum(r.kept for r in clean) / len(clean) > 0.99
    assert not any(r.kept for r in got if not r.label)


def test_frames(spark, tmp_path):
    schema = "doc_id long, text string, KEPT string, Quality int"
    rows = [(i % 7, t, "x", 1) for i, t in enumerate([*ODD, None, *ODD])]
    got = quality.judge(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", *[f.name for f in quality.ADDED]]
    found = got.collect()
    assert sorted((r.doc_id, r.n_words) for r in found) == sorted((d, brute(t)[0]) for d, t, _, _ in rows)
    assert all(r.base_failed and not r.kept for r in found if not r.text)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).count() == 0
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert quality.op1_quality(spark, str(tmp_path)).count() == 0
