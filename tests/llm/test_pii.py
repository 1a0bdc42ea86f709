import hashlib
import random
import re

import pytest

from lexispark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab1290.@+- ()_é😀\n4", k=rng.randrange(0, 50))) for _ in range(2500)]
    good = ["4111 1111 1111 1111", "4111-1111-1111-1111", "a.b@c.de_x@y.zz", "x@y@z.aa", "1.2.3.4.5.6.7.8", "000256.1.1.1", "0001.02.3.255", "+1 (269) 555-3296", "+49.30.1234567-", "a@b", "@c.d", "256.1.1.1"]
    texts += [" ".join(rng.choices([*good, "é", "und", ",", "😀"], k=8)) for _ in range(300)] + good
    texts += ["", None, "1" * 50_000, "a" * 50_000, "1 " * 30_000, "a." * 30_000 + "@" + "b." * 30_000 + "c", "+1" + "(" * 20_000, "é x@y.zz " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS TEXT", "2 AS base")
    got = {r.doc_id: [(s.start, s.k, s.kind, s.end) for s in r._base] for r in pii.scan(df, "doc_id", "text").select("doc_id", "_base").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr((t or "")[:100])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, say(40)) for i in range(400)]
    rows += [(1000 + i, f"{say(20)} chairwoman zebrafish jo@corp{i}.org {say(20)}") for i in range(3)]  # no shared entity
    rows += [(2000 + i, f"{say(20)} harpsichord ann@corp.org {say(20)}") for i in range(6)] + [(2100, f"{say(10)} Harpsichord {say(10)}")]
    rows += [(3000, f"{say(9)} trombone bob@corp.org {say(20)}")] * 5  # copies prove nothing
    return [*rows, (7, None), (7, ""), (None, "ann@corp.org")]


def test_disclosing_terms(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = pii.detect(df).collect()
    assert len(got) == len(corpus)
    texts = dict(corpus)
    found = {(texts[r.doc_id] or "")[s.start : s.end].lower() for r in got if r.doc_id is not None for s in r.spans if s.k == 4}
    assert found == {"harpsichord"}
    assert sum(any(s.k == 4 for s in r.spans) for r in got) == 7
    for r in got:
        assert [(s.start, s.k, s.kind, s.end) for s in r.base] == brute(texts[r.doc_id])
        assert [s for s in r.spans if s.k < 4] == r.base
    clean = {r.doc_id: r for r in pii.sanitize(df.selectExpr("*", "1 AS PII_spans", "3 AS extra")).collect()}
    assert clean[2000].text.count("[TERM]") == 1 and "[EMAIL]" in clean[2000].text and "ann@" not in clean[2000].text
    assert clean[7].text in (None, "") and clean[5].text == texts[5]


def test_whole_documents(spark):
    """A name far from the value, or near it in one of the texts only, discloses it; so does one beside a value whose neighbourhood is always the same."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, say(60)) for i in range(400)]
    rows += [(1000 + i, f"Xylophone {say(60)} ann@corp.org {say(20)}") for i in range(5)]
    rows += [(2000 + i, f"Violoncello {say(60 * (i % 2))} +49 30 1234567{' ' + say(30)}") for i in range(6)]
    rows += [(3000 + i, f"{say(40)} Clavichord {say(40)} {'always the same line ' * 5} 10.1.2.3 {'of every single letter ' * 5}") for i in range(4)]
    rows += [(4000 + i, f"Trombone {say(60) if i < 2 else 'one'} bob@corp.org") for i in range(2)] + [(4100, rows[-1][1])] * 3
    rows += [(5000 + i, f"Bassoon {say(50)}") for i in range(9)] + [(5100 + i, f"Bassoon {say(50)} eve@corp.org") for i in range(4)]  # P(e | t) = 4 / 13
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.detect(df).collect()
    texts = dict(rows)
    found = {texts[r.doc_id][s.start : s.end].lower() for r in got for s in r.spans if s.k == 4}
    assert {"xylophone", "violoncello", "clavichord"} <= found
    assert not found & ({"trombone", "bassoon"} | set(words))


def test_outside_terms(spark):
    df = spark.createDataFrame([(1, "Grüßann@x.de Ann Ann 1.2.3.4tail abc,def@x.yy"), (2, None), (3, "Éclair no")], "doc_id long, text string")
    got = {r._doc: r.t for r in pii.spanned(df, "doc_id", "text").select(pii.F.col("_key").alias("_doc"), pii.outside_terms("_text", "_base").alias("t")).collect()}
    assert got == {1: ["ann", "abc"], 2: [], 3: ["éclair"]}


def test_redacted(spark):
    texts = ["é a@b.cc,1.2.3.4 +1 (269) 555-3296", "x@y.zz", "none", "a@1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert got == {0: "é [EMAIL],[IP] [PHONE]", 1: "[EMAIL]", 2: "none", 3: "[EMAIL]"}


def test_query(spark, tmp_path, corpus):
    spark.createDataFrame(corpus[:420], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op7_pii(spark, str(tmp_path)).collect():
        b = brute(dict(corpus)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest()
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
