import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import suffix


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    many = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if many[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out.append((k, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "group"), [(400, 8 << 20), (400, 20_000), (150, 20_000), (128, 20_000)])
def test_against_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(length)
    say = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    shared = [say(n) for n in (length - 40, length, length + 1, 3 * length)]
    rows = []
    for i in range(60):
        t = say(rng.randrange(0, 900))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 60)
            t = t[: rng.randrange(0, len(t) + 1)] + s[cut // 2 : len(s) - cut // 3] + say(rng.randrange(0, 500))
        rows.append((i, t))
    for i in range(15):  # near copies
        w = list(rows[3][1] + shared[3] + say(700) if i == 0 else rows[-1][1])
        for _ in range(2):
            w[rng.randrange(len(w))] = "X"
        rows.append((100 + i, "".join(w)))
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, "a" * 1000), (1, "ab" * 700), (2, None), (2, ""), (3, "x"), (4, say(length)), (4, "é" * 600), (6, "longer" + say(40_000) + shared[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS T1", "2 AS Text").repartition(4)
    got = suffix.remove_repeats(df, length=length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=repr) == brute(rows, length)
    assert all(sum(s.hi - s.lo for s in r.spans) == r.n_removed for r in got)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "short"), (1, "short")]
    assert [r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]
