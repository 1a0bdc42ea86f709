import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import embed, kernels, learned, vectors
from lexispark.operators import match as M
from lexispark.plans.queries import VOCABULARY
from lexispark.sources.vocabulary import Vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def chunked(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for sep in T.BREAKS:
                at = text.rfind(sep, start + size // 2, end)
                if at > start:
                    end = at + len(sep)
                    break
        if piece := text[start:end].strip():
            out.append(piece)
        start = end - overlap
    return out


def test_chunk_text(spark, texts):
    rng = random.Random(1)
    more = ["".join(rng.choices(["a", "bc ", ". ", ".\n", "\n\n", "\n", " ", "é", " "], weights=[30, 5, 1, 1, 1, 1, 3, 5, 1], k=rng.randrange(0, 4000))) for _ in range(150)]
    for size, overlap in ((1200, 100), (1000, 100), (150, 20)):
        some = [*texts[:60], *more, "", "x" * 3000]
        assert column(spark, some, lambda x: T.chunk_text(x, size, overlap)) == [chunked(t, size, overlap) for t in some]  # noqa: B023


def test_stem_hash_and_tokens(spark, texts):
    words = sorted({w for t in texts[:40] for w in re.findall("[a-z][a-z0-9_]*", t.lower())})[:3000] + ["stations", "classes", "glasses", "payment", "payments", "running", "ending", "happily", "greater", "ss"]

    def stem(w):
        if len(w) > 6:
            for s in T.SUFFIXES:
                if w.endswith(s) and not (s == "s" and w.endswith("ss")):
                    return w[: -len(s)]
        return w

    assert column(spark, words, T.stem) == [stem(w) for w in words]
    for n in (1024, 1000, 7, 1 << 20):
        got = column(spark, words, lambda x: F.struct(*[c.alias(k) for c, k in zip(T.hash_term(x, n), "ab")]))  # noqa: B023
        md5, sha = (lambda w: int(hashlib.md5(w.encode()).hexdigest(), 16)), (lambda w: int(hashlib.sha1(w.encode()).hexdigest(), 16))
        assert [(r.a, r.b) for r in got] == [(md5(w) % n, 1 if sha(w) % 2 == 0 else -1) for w in words]
    tokens = column(spark, texts, T.tokenize)
    assert tokens == [re.findall("[a-z][a-z0-9_]*", t.lower()) for t in texts]
    assert column(spark, ["", "a", "a b", "a b c"], lambda x: T.with_bigrams(T.tokenize(x))) == [[], ["a"], ["a", "b", "a_b"], ["a", "b", "c", "a_b", "b_c"]]


def test_headings(spark):
    def heading(t):
        t = t.strip()
        if not t or len(t) >= 100 or t.endswith((".", ",", ";", ":")):
            return False
        return bool(t.isupper() or re.match(r"^\d+\.?\s+\w", t) or re.match(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$", t) or (re.match(r"^[A-Z0-9\s\-:]+$", t) and len(t) < 80))

    rng = random.Random(2)
    some = ["".join(rng.choices("AbZ9 -:.é ", k=rng.randrange(0, 12))) for _ in range(1500)] + ["Two Words", "1. é", "X" * 99, "X" * 100, "9" * 79, "9" * 80]
    assert column(spark, some, T.is_heading) == [heading(t) for t in some]


def test_keywords(spark, texts):
    some = ["WireTransfer and wire_transfer, WIRE_X MAX a-b NASA nasa wiretransfer", *texts[:30]]

    def keywords(t):
        out = {}
        for p in T.KEYWORDS:
            for k in re.findall(p, t):
                out.setdefault(k.lower(), k)
        return list(out.values())

    assert column(spark, some, T.extract_keywords) == [keywords(t) for t in some]


def scan(vocabulary, text, deduplicate):
    low = text.lower()
    hits = sorted((i + len(t), -len(t), e, k, i, w) for t, w, e, k in vocabulary.terms for i in range(len(low)) if low.startswith(t, i))
    out, seen = [], set()
    for end, _, e, _, start, said in hits:
        name = vocabulary.entries[e].canonical_term
        if not deduplicate or name.lower() not in seen:
            seen.add(name.lower())
            out.append((said, name, start, end, text[max(0, start - 50) : end + 50]))
    return out


def test_matches(spark, texts, monkeypatch):
    some = [t[:3000] for t in texts[:60]] + ["", None, "WIRE the and ander", "licensed licensed"]
    df = spark.createDataFrame(list(enumerate(some)), "i long, text string")
    for dedup, limit in ((True, 2000), (True, 0), (False, 2000)):
        monkeypatch.setattr(M, "NATIVE_TERMS", limit)
        got = {r.i: [(m.matched_term, m.canonical_term, m.start, m.end, m.context) for m in r.domain_matches] for r in M.match_text(df, VOCABULARY, deduplicate=dedup).collect()}
        for i, t in enumerate(some):
            assert got[i] == scan(VOCABULARY, t or "", dedup), (dedup, limit, i)
    assert [r.domain_matches for r in M.match_text(df, Vocabulary([])).collect()] == [[]] * len(some)


def test_matching_reads_a_text_once(spark):
    """The search isn't copied into filters, and what it searches in is lowered outside of its terms: time grows with the text, not with text times terms."""
    df = spark.createDataFrame([(0, "Licensed Wire the AND " * 3, None)], "i long, text string, other string")
    some = M.match_text(df, VOCABULARY).select("i", F.explode("domain_matches").alias("m")).select("i", "m.canonical_term", "m.start")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "instr(" not in plan
    texts = spark.range(200).select("id", F.repeat(F.concat(F.lit("Licensed \u00c9mail the AND que de "), F.col("id").cast("string")), 1500).alias("text"))
    began = time.perf_counter()
    got = M.match_text(texts, VOCABULARY, context=None, deduplicate=False).select(F.size("domain_matches").alias("n")).agg(F.sum("n")).first()[0]
    assert got == 200 * 1500 * len(scan(VOCABULARY, "licensed \u00e9mail the and que de ", False)) and time.perf_counter() - began < 60


def test_vocabulary(spark, tmp_path):
    v = VOCABULARY
    assert v.owner["ment"] == 3 and v.owner["the and"] == 4 and v.entry_by_term("TION").canonical_term == "tion"
    assert "Screening" in v.capabilities and [e.canonical_term for e in v.entries_by_capability("Screening")] == ["tion", "que de"]
    v.save(spark, str(tmp_path / "v"))
    assert Vocabulary.load(spark, str(tmp_path / "v")).entries == v.entries
    (tmp_path / "w.json").write_text('{"version": 1, "entries": [{"keywords": "a b, c", "metadata": "M", "business_capability": "X, Y"}]}')
    e = Vocabulary.load(spark, str(tmp_path / "w.json")).entries[0]
    assert e.keywords == ["a b", "c"] and e.capabilities == ["X", "Y"] and e.canonical_term == "a b"


def test_learned_terms(spark, texts):
    config = learned.Config()
    got = column(spark, texts[:80], lambda x: learned.document_terms(x, config))

    def valid(t):
        return len(t) >= 2 and t not in learned.STOPWORDS and not t.isdigit()

    def terms(text):
        low = text.lower()
        out = [m[1] for m in re.finditer(r"\b([a-z][a-z0-9_\-\.]*[a-z0-9]|[a-z])\b", low) if valid(m[1])]
        for n in (2, 3):
            p = r"\b" + r"\s+".join([r"([a-z][a-z0-9]*)"] * n) + r"\b"
            out += [" ".join(m.groups()) for m in re.finditer(p, low) if all(map(valid, m.groups()))]
        return out

    assert got == [terms(t) for t in texts[:80]]


def test_clusters():
    rng = np.random.default_rng(0)
    sim = rng.random((14, 14))
    sim = (sim + sim.T) / 2
    clusters = [[i] for i in range(14)]
    distance = 1 - sim
    np.fill_diagonal(distance, 0)
    while len(clusters) > 4:
        best = min(((np.mean([distance[a, b] for a in clusters[i] for b in clusters[j]]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))))
        clusters[best[1]] += clusters.pop(best[2])
    assert learned.cluster_hierarchical(sim.copy(), 4) == clusters
    assert sorted(x for c in learned.cluster_kmeans(sim, 4) for x in c) == list(range(14))


def test_learned_embedder(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    model = learned.LearnedEmbedder(learned.Config(n_dimensions=6, max_terms=40)).fit(df)
    model.save(spark, str(tmp_path / "m"))
    again = learned.LearnedEmbedder.load(spark, str(tmp_path / "m"))
    assert again.dimensions == model.dimensions and model.n_dimensions == 6
    got = {r.chunk_id: r.embedding for r in again.transform(df).collect()}
    for i, t in enumerate(texts[:50]):
        v = np.zeros(6)
        for d in model.dimensions:
            v[d["id"]] = max([w for x, w in d["term_weights"].items() if x in t.lower()] + [0])
        assert np.allclose(got.get(i, np.zeros(6)), v / (np.linalg.norm(v) or 1))
    assert all(r.rank <= 2 for r in model.explain(df, top=2).collect())
    assert learned.LearnedEmbedder().fit(df.limit(0)).transform(df).count() == 0


@pytest.mark.parametrize("kind", sorted(embed.EMBEDDERS))
def test_embedders(spark, texts, kind):
    df = spark.createDataFrame([*enumerate(texts[:30]), (99, "")], "chunk_id long, text string")
    kw = {"config": learned.Config(n_dimensions=5, max_terms=30)} if "learned" in kind else {}
    model = embed.create_embedder(kind, VOCABULARY, **kw).fit(df)
    for r in model.transform(df).collect():
        assert len(r.embedding) == model.n_dimensions
        size = np.linalg.norm(r.embedding)
        assert size <= 1 + 1e-9 if "hybrid" in kind else abs(size - 1) < 1e-9
    with pytest.raises(ValueError):
        embed.create_embedder("other", VOCABULARY)


def test_batch_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    queries = df.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.batch_topk(df, queries, 4).collect()}
    for j in range(12):
        s = v @ v[j] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[j]) + 1e-8)
        assert [got[j, k] for k in range(1, 5)] == sorted(range(300), key=lambda i: (-s[i], i))[:4]


def test_batch_topk_of_equal_vectors():
    """A task passes on k rows for each query, however many vectors tie and batches it reads; ties go by id, nulls first."""
    ids = list(range(5000, 0, -1))
    data = pa.table({"id": pa.array([*ids, None]), "v": pa.array([[1.0, 2.0]] * 5001)})
    run = vectors._best(["a", "b"], np.array([[1.0, 2.0], [2.0, 1.0]]), 3)
    out = pa.Table.from_batches(run(iter(data.to_batches(max_chunksize=700))))
    assert out.column("id").to_pylist() == [None, 1, 2] * 2 and out.column("query_id").to_pylist() == ["a"] * 3 + ["b"] * 3
    assert not list(run(iter([])))


def test_long_texts_without_blanks(spark):
    """A megabyte without a blank, or of blanks only inside, neither ends the JVM nor takes quadratic time; and keywords are those of Python."""
    long = ["a_" * 3000 + "a", "Ab" * 20_000, "A_" * 5000 + "A", "a-" * 5000 + "a1", "x" * 1_000_000, "a_" * 500_000 + "a", "Ab" * 500_000, "a-b-c1 d-e FooBar fooBar x_y_1 NASA_X", "a" + " " * 1_000_000 + "b", "<" * 1_000_000]
    got = column(spark, long, T.extract_keywords, "string")

    def keywords(text):
        found = {}
        for p in T.KEYWORDS:
            for m in re.finditer(p, text):
                found.setdefault(m[0].lower(), m[0])
        return list(found.values())

    assert got == [keywords(t) for t in long]
    assert column(spark, long, T.strip) == long
    assert [len(x) for x in column(spark, long, T.strip_tags)][-2:] == [3, 1_000_000]
    for f in (T.sanitize_for_llm, T.tokenize, T.extract_tal_keywords, T.is_heading):
        assert len(column(spark, long, f)) == len(long)


def test_batch_topk_in_tiles(monkeypatch):
    """Many vectors and queries at once: a tile of scores at a time, in bounded memory; scores that differ beyond nine digits tie."""
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(20_000, 16)), rng.normal(size=(500, 16))
    v[100:200] = v[100] * (1 + 1e-12 * rng.normal(size=(100, 16)))
    q[0] = v[100]
    batch = pa.record_batch({"id": pa.array(range(len(v), 0, -1)), "v": pa.array(v.tolist())})
    tracemalloc.start()
    out = pa.Table.from_batches(vectors._best(list(range(500)), q, 3)(iter([batch]))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak  # all scores at once: 80 MB for each of several arrays
    score = (v @ q.T / (np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)) + 1e-8)).round(9)
    for j in range(500):
        best = sorted(range(len(v)), key=lambda i: (-score[i, j], len(v) - i))[:3] if j < 3 else np.lexsort((-np.arange(len(v)), -score[:, j]))[:3]  # noqa: B023
        assert [r["id"] for r in out if r["query_id"] == j] == [len(v) - i for i in best]


def test_kernels_read_terms_as_columns_do(spark, texts):
    rng = random.Random(11)
    odd = ["".join(rng.choices("ab z9_-. \u00e9\u0301\u00b2\u00bd\u2460\u24b6\u203f\u200d\u00a0\x1c\x0b\n", k=30)) for _ in range(400)]
    some = [t.lower() for t in texts[:40]] + odd
    for config in (learned.Config(), learned.Config(extract_trigrams=False, min_term_length=1)):
        read = learned._term_reader(config)
        assert [read(t) for t in some] == column(spark, some, lambda x: learned.document_terms(x, config))  # noqa: B023
    words = sorted({w for t in some for w in t.split()})
    assert [kernels.stem(w) for w in words] == column(spark, words, T.stem)


def test_sparse_rows_without_shuffle(spark, texts):
    """Where ids are unique nothing is shuffled by text and term; repeated ids make one document, with the same rows as its texts joined."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])] + [(99, None)], "i long, text string")
    joined = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts[:40])], "i long, text string")
    for model in (embed.HashEmbedder(VOCABULARY, 100, use_bigrams=False), embed.TFIDFEmbedder(VOCABULARY, use_bigrams=False, max_features=500)):
        assert "Exchange" not in model.fit(df, "text").sparse(df, "i")._jdf.queryExecution().executedPlan().toString()
        one = df.where("text IS NOT NULL").groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "text")))["text"], "\n").alias("text"))
        rows = lambda x: sorted((r.i, r.idx, round(r.weight, 9)) for r in model.sparse(x, "i").collect())  # noqa: B023, E731
        assert rows(joined) == rows(one)


def test_bm25_in_buckets(spark, texts, monkeypatch):
    """Texts are weighed bucket by bucket with the same rows as by pairs of text and term, which aren't shuffled any more."""
    df = spark.createDataFrame([*enumerate(texts[:60]), (99, None), (100, "")], "i long, text string")
    rows = lambda x: sorted((r.i, r.term, round(r.weight, 9)) for r in x.collect())
    monkeypatch.setattr(kernels, "BUCKET", 20_000)
    model = embed.BM25Embedder(VOCABULARY).fit(df, id="i")
    out = model.sparse(df, "i")
    assert "hashpartitioning(i#" not in out._jdf.queryExecution().executedPlan().toString()
    got = rows(out)
    monkeypatch.setattr(kernels, "unique", lambda df, id: False)
    assert got == rows(embed.BM25Embedder(VOCABULARY).fit(df, id="i").sparse(df, "i")) and got


def test_window_pairs_of_many_terms(spark):
    """Pairs of more terms than a dense table holds, and of terms that overlap themselves, against brute force."""
    terms = ["aa", "ab", "ba", *[f"x{i}" for i in range(2100)]]
    some = ["aaab aab x7 aaa x8", "baab" * 20, "x1 x2 x3", None, ""]

    def brute(text):
        at = [(m.start(), t) for t in terms for m in re.finditer(re.escape(t), text or "")]
        return [tuple(sorted((a[1], b[1]))) for i, a in enumerate(at) for b in at[i + 1 :] if a[1] != b[1] and abs(a[0] - b[0]) <= 50]

    want = {}
    for pair in (p for t in some for p in brute(t)):
        want[pair] = want.get(pair, 0) + 1
    df = spark.createDataFrame([(t,) for t in some], "text string")
    for own in (terms, [t for t in terms if len(t) < 4]):
        got = {(r.t1, r.t2): r.cnt for r in learned.cooccurrence(df, own, learned.Config(min_cooccurrence=1)).collect()}
        assert got == want
