import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import lm
from lexispark.llm._text import utf8

MORE = [(1, None), (2, ""), (3, "!!"), (4, "one"), (4, "one"), (5, "w " * 50_000), (6, "zqxj éü 日本 42"), (7, "q" * 30_000)]


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hash_of(word):
    return lm.words(*utf8(pa.array([word])), lm.ALNUM, lm._VALUES).hash[0]


def letters(word):
    out = []
    for b in word.encode():
        c = chr(b)
        out.append(1 + int(c) if c.isdigit() and b < 128 else 11 + ord(c) - ord("a") if "a" <= c <= "z" else 37 + b - 0x80 if b < 0xC0 else 101 + (b - 0xC0) % 27)
    return out


def test_counts_and_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(MORE, "doc_id long, text string"))
    rows = docs.collect()
    counts = Counter(w for r in rows for w in tokens(r.text))
    name = {w: int(np.int64(hash_of(w))) for w in counts}
    ranked = sorted(counts, key=lambda w: (-counts[w], name[w]))[: lm.FREQUENT]
    vocab = lm.vocabulary(docs)
    assert vocab.hash.astype(np.int64).tolist() == [name[w] for w in ranked]
    assert vocab.rare == sum(counts.values()) - sum(counts[w] for w in ranked)
    rank = {w: i for i, w in enumerate(ranked)}

    cells = np.zeros((lm.LETTERS,) * 3)
    for w, n in counts.items():
        if w not in rank:
            s = [0, 0, *letters(w), 0]
            for i in range(2, len(s)):
                cells[s[i - 2], s[i - 1], s[i]] += n
    spelled = lm.spelling(docs, vocab)
    assert np.allclose(spelled, lm.spelling_table(cells), atol=1e-5)
    assert np.allclose(np.exp(spelled.reshape(-1, lm.LETTERS)).sum(1), 1, atol=1e-4)

    net, losses = lm.learn(docs, vocab, rounds=2)
    assert len(losses) == 2 and losses[1] < losses[0]
    got = {(r.doc_id, r.text): r for r in lm.apply(docs, vocab, net, spelled).collect()}
    assert len(got) == len(set((r.doc_id, r.text) for r in rows))
    cube, p = spelled.reshape((lm.LETTERS,) * 3).astype(float), {k: x.astype(float) for k, x in net.p.items()}
    symbol = lambda w: 1 + rank[w] if w in rank else 1 + lm.FREQUENT + (name[w] % 2**64 >> 40) % lm.KINDS
    soft = lambda z, i: float(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()))
    for r in rows:
        w = tokens(r.text)
        g = got[(r.doc_id, r.text)]
        assert g.n_tokens == len(w) and (g.mean_pll is None) == (not w)
        if len(w) > 500:
            continue
        line = [0] * lm.SIDE + [symbol(x) for x in w] + [0] * lm.SIDE
        pll = 0.0
        for i, x in enumerate(w):
            around = line[i : i + lm.SIDE] + line[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]
            h = np.tanh(p["hidden"] + sum(p["input"][s] * p["place"][k] for k, s in enumerate(around)))
            c = rank[x] // lm.CLASS if x in rank else lm.CLASSES
            pll += soft(p["class"] @ h + p["class_bias"], c)
            if x in rank:
                own = slice(c * lm.CLASS, (c + 1) * lm.CLASS)
                pll += soft(p["word"][own] @ h + p["word_bias"][own], rank[x] % lm.CLASS)
            else:
                s = [0, 0, *letters(x), 0]
                pll += sum(cube[s[k - 2], s[k - 1], s[k]] for k in range(2, len(s)))
        assert g.pll == pytest.approx(pll, rel=1e-4, abs=1e-3)


def test_gradient():
    rng = np.random.default_rng(0)
    vocab = lm.Vocabulary(rng.integers(0, 1 << 62, lm.FREQUENT), np.arange(lm.FREQUENT, 0, -1), 10**7)
    net = lm.Network(vocab)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    around, rank = rng.integers(0, lm.INPUTS, (50, 2 * lm.SIDE)), np.append(rng.integers(0, lm.FREQUENT, 40), [lm.FREQUENT] * 10)
    loss, g = net.step(around, rank)
    assert loss == pytest.approx(-net.log_probabilities(around, rank).mean())
    for k, at in (("input", (around[0, 2], 3)), ("place", (1, 4)), ("hidden", (2,)), ("class", (int(rank[0]) // lm.CLASS, 1)), ("class_bias", (lm.CLASSES,)), ("word", (int(rank[3]), 5)), ("word_bias", (int(rank[5]),))):
        was = net.p[k][at]
        net.p[k][at] = was + 1e-5
        more = net.step(around, rank)[0]
        net.p[k][at] = was - 1e-5
        less = net.step(around, rank)[0]
        net.p[k][at] = was
        assert g[k][at] == pytest.approx((more - less) / 2e-5, rel=1e-3, abs=1e-8), k


def test_every_word_is_learned(spark):
    """Rounds together mask each word once, wherever it stands; of small tables too."""
    rng = random.Random(3)
    word = lambda i: "pin" if i % 24 == 3 else "hay" if i % 24 == 2 else f"w{rng.randrange(30)}"
    rows = [(k, " ".join(word(i) for i in range(24 * 300))) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocab = lm.vocabulary(docs)
    net, losses = lm.learn(docs, vocab)
    assert len(losses) == lm.ROUNDS
    seen = lm.Windows(*utf8(pa.array([rows[0][1]])), vocab)
    pins = np.flatnonzero(seen.found.hash == hash_of("pin"))
    before, after = (x.log_probabilities(seen.around(pins), seen.rank[pins]).mean() for x in (lm.Network(vocab), net))
    assert after > before + 1

    few = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "f g")], "doc_id long, text string")
    assert len(lm.learn(few, lm.vocabulary(few))[1]) == lm.ROUNDS

    texts = [r[1] for r in rows[:2]] + [None, "one", "!", "zqxj two"]
    lines = list(lm._lines(iter([pa.record_batch({"text": pa.array(texts * 9)})]), vocab))
    got = Counter()
    for turn in range(4):
        for around, rank in lm.masked(iter(lines), turn, 4):
            assert len(rank) <= lm.BATCH + lm.MOST
            got.update(zip(map(tuple, around.tolist()), rank.tolist(), strict=True))
    want = lm.Windows(*utf8(pa.array(texts * 9)), vocab)
    at = np.arange(len(want.rank))
    assert got == Counter(zip(map(tuple, want.around(at).tolist()), want.rank.tolist(), strict=True))


def test_held_out(spark):
    """The words around tell more than word frequencies, on documents that weren't seen; shuffled words and garbage score lower."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("length(text) < 20000").repartition(4, "doc_id")
    train, test = docs.where("doc_id % 20 > 0"), docs.where("doc_id % 20 = 0")
    vocab = lm.vocabulary(train)
    net, losses = lm.learn(train, vocab)
    spelled = lm.spelling(train, vocab)
    alone = lm.Network(vocab)  # its biases are the frequencies of words
    for k in ("class", "word"):
        alone.p[k][:] = 0
    mean = lambda df, net: df.transform(lambda d: lm.apply(d, vocab, net, spelled)).selectExpr("sum(pll) / sum(n_tokens) AS m").first().m
    own = mean(test, net)
    print("held-out loss", -own, "by frequency", -mean(test, alone), "rounds", losses)
    assert own > mean(test, alone) + 0.05 and losses[-1] < losses[0]
    rng = random.Random(0)
    rows = [(r.doc_id, tokens(r.text)) for r in test.collect()]
    frame = lambda f: spark.createDataFrame([(k, " ".join(f(w))) for k, w in rows], "doc_id long, text string")
    assert own > mean(frame(lambda w: rng.sample(w, len(w))), net)
    assert own > mean(frame(lambda w: ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=len(x))) for x in w]), net) + 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, PLL int")
    got = lm.score(df)
    assert got.columns == ["doc_id", "text", "n_tokens", "pll", "mean_pll"] and got.count() == 0
    got = lm.score(spark.createDataFrame(MORE, "doc_id long, text string")).collect()
    assert len(got) == len(MORE) and all(np.isfinite(r.pll) for r in got)
