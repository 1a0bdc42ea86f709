import random
import re

import pyarrow as pa

from lexispark.llm import decontam
from lexispark.llm._text import utf8

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    out = []
    wins = [(k, {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}) for k, w in ((k, split(t)) for k, t in items) if w]
    for key, text in docs:
        w = split(text)
        hit, its = set(), set()
        for k, own in wins:
            for win in own:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        its.add(k)
        out.append((key, len(w), len(hit), sorted(map(str, its)), len(its) >= 2))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "B", "c9", "é", "Éa", "d"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice((" ", "-", "\n\n", ". ")) for _ in range(n))
    items = [(i, say(rng.choice((1, 3, 5, 7, 8, 9, 20)))) for i in range(25)] + [(90, None), (91, "..."), (92, "z z z z z z z z z z z"), (12, "Q q Q")]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(80)]
    docs += [(200 + i, say(9) + t + say(9)) for i, (_, t) in enumerate(items) if t] + [(1, None), (1, ""), (1, "!?"), (7, "Z " * 300), (8, "q q q"), (None, "q q"), (9, "x " * 60_000 + "q Q q")]
    schema = "doc_id long, text string"
    df = spark.createDataFrame(docs, schema).selectExpr("doc_id", "text", "1 AS TEXT", "2 AS _row", "3 AS items").repartition(5)
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == brute(docs, items)
    for r in got:
        assert (r.n_hit > 0) == bool(r.spans) and all(s.lo < s.hi for s in r.spans)
        assert all(a.hi < b.lo for a, b in zip(r.spans, r.spans[1:]))


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontam.decontaminate(docs, items).collect()] == [(2, 0, 0)]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_every_window_keeps_a_fingerprint():
    rng = random.Random(1)
    found = decontam.tokens(*utf8(pa.array([" ".join(rng.choices("abcdefgh", k=rng.randrange(40))) for _ in range(300)])))
    kept = set(decontam.winnow(found).tolist())
    at, left = decontam.grams(found, decontam.GRAM)[0], found.left()
    starts = {int(at[k]) for k in kept}
    for i in range(len(left)):
        if left[i] >= decontam.WINDOW:
            assert starts & set(range(i, i + decontam.WINDOW - decontam.GRAM + 1))
