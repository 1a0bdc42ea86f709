import random
import re

import numpy as np

from lexispark.llm import jaccard
from lexispark.llm._graph import components, local_roots


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links, label = [0] * n, list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, least.get(root(i)) if sets[i] else k, links[i], sum(root(x) == root(i) for x in range(n))) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        texts.append(" ".join(base[:30] + passage))
    hot = [rng.choice(vocab) for _ in range(80)]
    for i in range(120):  # one large group of near copies
        w = list(hot)
        w[i % 80] = f"x{i}"
        texts.append(" \n".join(w))
    texts += [" ".join(hot)] * 40 + ["", "a b", "a  b", "a b c", None, " \n", "z " * 50_000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return [*rows, *rows[:3], (None, texts[0]), (None, "only null"), (None, None)]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS Doc_ID", "2 AS h").repartition(3)
    expected = brute(rows)
    for leaf, block in ((1000, 400), (30, 25)):  # the second splits buckets and components
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = jaccard.near_duplicates(df).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got), key=repr) == expected
        stands = {}
        for r in got:
            if r.first:
                stands[(r.class_id, r.class_size)] = stands.get((r.class_id, r.class_size), 0) + 1
        assert all(k in stands for k in {(r.class_id, r.class_size) for r in got})


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    n = 600
    label = local_roots(n, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: int(label[x]) for e in edges if e[0] != e[1] for x in e}


def test_runs():
    r = jaccard.runs_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**jaccard.DEPTH) ** r >= 0.9999
