"""The index: chunks, their postings and their vectors as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import text as T


def canonical_terms(matches: str = "domain_matches") -> Column:
    return F.array_distinct(F.transform(matches, lambda m: m["canonical_term"]))


def capability_set(matches: str = "domain_matches") -> Column:
    return F.array_distinct(F.flatten(F.transform(matches, lambda m: m["capabilities"])))


def last_of_each(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each chunk_id, the last by ``order``."""
    if order is None:
        return chunks.dropDuplicates(["chunk_id"])
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(order)))
    return chunks.withColumn("_n", n).where("_n = 1").drop("_n")


def postings(chunks: DataFrame) -> DataFrame:
    """(kind, key, chunk_id, source_type): concepts in lower case, capabilities, categories and source types as they are. One pass over the chunks."""
    pair = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    keys = F.concat(
        F.transform(F.array_distinct(F.transform("domain_matches", lambda m: F.lower(m["canonical_term"]))), pair("concept")),
        F.transform(capability_set(), pair("capability")),
        F.transform(F.array_distinct(F.transform("domain_matches", lambda m: m["category"])), pair("category")),
        F.array(pair("source_type")(F.col("source_type"))),
    )
    return chunks.select("chunk_id", "source_type", F.explode(keys).alias("p")).select("p.kind", "p.key", "chunk_id", "source_type")


def lookup(found: DataFrame, kind: str, key: str) -> DataFrame:
    return found.where((F.col("kind") == kind) & (F.col("key") == (key.lower() if kind == "concept" else key))).select("chunk_id")


def statistics(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(metric, name, value): chunks in all and by source type, embedded chunks, distinct concepts, capabilities and categories, chunks by capability."""
    one = lambda metric, name, df: df.select(F.lit(metric).alias("metric"), name.alias("name"), F.col("v").cast("long").alias("value"))
    out = one("total_chunks", F.lit(""), chunks.agg(F.countDistinct("chunk_id").alias("v")))
    if "embedding" in chunks.columns:
        out = out.unionByName(one("vector_store_size", F.lit(""), chunks.agg(F.count("embedding").alias("v"))))
    counts = found.groupBy("kind", "key").agg(F.countDistinct("chunk_id").alias("v"))  # one pass over the postings, a row for each key
    row = lambda metric, name, v: F.struct(metric.alias("metric"), name.alias("name"), v.cast("long").alias("value"))
    chunks_by = F.when(F.col("kind").isin("source_type", "capability"), F.array(row(F.concat(F.lit("chunks_by_"), F.col("kind")), F.col("key"), F.col("v"))))
    rows = counts.select(F.inline(F.concat(F.array(row(F.lit("distinct_keys"), F.col("kind"), F.when(F.col("key").isNull(), 0).otherwise(1))), F.coalesce(chunks_by, F.array().cast("array<struct<metric:string,name:string,value:bigint>>")))))
    out = out.unionByName(rows.groupBy("metric", "name").agg(F.sum("value").alias("value")))
    return out


def vector_topk(vectors: DataFrame, query: list[float], k: int, id: str = "chunk_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, score): the k vectors of greatest cosine with the query; ``where`` is applied before. A top-k in each task, then of these."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) * float(x) for x in query) ** 0.5
    df = vectors if where is None else vectors.where(where)
    score = T.dot(F.col(embedding), q) / (T.norm(F.col(embedding)) * size + 1e-8)
    return df.where(F.col(embedding).isNotNull()).select(id, score.alias("score")).orderBy(F.desc(F.round("score", 9)), id).limit(k)


def save(chunks: DataFrame, path: str) -> None:
    """Chunks by source type, and their postings by kind."""
    chunks.write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/chunks")
    postings(chunks).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/postings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings")
