import base64

import numpy as np
import tiktoken

import corpus_pipeline
from lexispark.llm import bpe
from lexispark.llm._spark import cut
from tests.llm import test_decontam, test_jaccard, test_pii

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF), "stage")
        at[name] = before.toPandas(), docs.toPandas()
        if name != "token ids":
            assert docs.columns == columns and docs.schema == before.schema

    before, after = at["quality rules"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(after["doc_id"])
    assert 0 < len(kept) < len(before)
    assert not [d for d in kept if labels.get(d) == 0]

    before, after = at["near duplicates"]
    classes = test_jaccard.brute(list(zip(before["doc_id"].tolist(), before["text"])))
    assert sorted(after["doc_id"]) == sorted({c for _, c, _, _ in classes})

    before, after = at["benchmark decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    items = list(zip(items["item_id"].tolist(), items["text"]))
    found = {k: (n, hit, bad) for k, n, hit, _, bad in test_decontam.brute(list(zip(before["doc_id"].tolist(), before["text"])), items)}
    was = dict(zip(before["doc_id"], before["text"]))
    assert sorted(after["doc_id"]) == sorted(k for k, (_, _, bad) in found.items() if not bad)
    for k, text, n in zip(after["doc_id"], after["text"], after["n_chars"]):
        assert len(test_decontam.split(text)) == found[k][0] - found[k][1] and len(text) == n
        assert found[k][1] or text == was[k]

    before, after = at["personal data"]
    was = dict(zip(before["doc_id"], before["text"]))
    assert sorted(after["doc_id"]) == sorted(before["doc_id"])
    for k, text in zip(after["doc_id"], after["text"]):
        assert not test_pii.brute(text)
        assert test_pii.brute(was[k]) or "[TERM]" in text or len(text) <= len(was[k])

    before, after = at["token ids"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))}
    import public_tokenizers

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(zip(before["doc_id"], before["text"]))
    assert sorted(after["doc_id"]) == sorted(text) and after["decodes"].all()
    assert all(np.frombuffer(x, "<u4").tolist() == lib.encode_ordinary(text[k]) for k, x in zip(after["doc_id"], after["ids"]))

    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(whole["doc_id"]) == sorted(after["doc_id"]) and whole["n_tokens"].sum() == after["n_tokens"].sum()


def test_odd_rows(spark):
    rows = [(1, None, "x", None, 0), (1, None, "x", None, 0), (None, "", None, "s", 0), (2, "w " * 5, "x", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == {"quality rules": 0, "near duplicates": 3}.get(name, 4), name
        assert stage(spark, docs.limit(0), SF).count() == 0
