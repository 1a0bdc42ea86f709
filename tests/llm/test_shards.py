import zlib

from lexispark.llm import shards


def test_shards(spark, tmp_path):
    rows = [(i % 300, None if i % 50 == 0 else ("é" * (i % 17))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS SIZE", "2 AS Shard", "3 AS extra")
    runs = []
    df.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    written = spark.read.parquet(str(tmp_path / "in"))
    for n, (source, size) in enumerate(((df, 1 << 20), (written, 700), (written, 700))):
        done = shards.shuffle_and_shard(source, str(tmp_path / f"o{n}"), shards=8, bucket_bytes=size)
        assert done.columns == ["doc_id", "text", "extra", "size", "text_crc32", "shard", "slot"]
        got = done.collect()
        assert sorted((r.doc_id, r.text or "") for r in got) == sorted((a, b or "") for a, b in rows)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
            assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert set(by) == set(range(8)) and {len(v) for v in by.values()} == {125}
        assert all(sorted(v) == list(range(125)) for v in by.values())
        runs.append(sorted((r.shard, r.slot, r.doc_id, r.size) for r in got))
    assert runs[1] == runs[2] != runs[0]
    order = [r[2] for r in runs[1]]
    assert order != sorted(order) and len(set(order[:50])) > 20


def test_small(spark, tmp_path):
    schema = "doc_id long, text string"
    assert shards.shuffle_and_shard(spark.createDataFrame([], schema), str(tmp_path / "a")).count() == 0
    got = shards.shuffle_and_shard(spark.createDataFrame([(None, None), (1, "x" * 300_000), (1, "b")], schema), str(tmp_path / "b")).collect()
    assert sorted((r.size, r.slot) for r in got) == [(1, 0), (2, 0), (300_001, 0)] and len({r.shard for r in got}) == 3


def test_equal_rows_spread(spark, tmp_path):
    """A third of all rows are equal; every bucket gets about its share of them."""
    spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'the same text', cast(id AS string)) AS text").write.parquet(str(tmp_path / "in"))
    done = shards.shuffle_and_shard(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), shards=8, bucket_bytes=10_000)
    got = done.groupBy("shard").agg({"*": "count"}).collect()
    assert len(got) == 8 and {r[1] for r in got} == {3750}
    hot = [r.n for r in done.where("doc_id = 7").selectExpr("shard", "slot div 250 AS b").groupBy("shard", "b").count().withColumnRenamed("count", "n").collect()]
    assert len(hot) == 8 * 15 and max(hot) < 2 * 10_000 / 120
