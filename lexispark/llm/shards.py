"""Sharding by a two-pass external shuffle: scatter into buckets, then permute each bucket and write it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from lexispark.llm._spark import cut, exact, load, released, shared_dir, without


def shuffle_and_shard(
    docs: DataFrame, path: str, shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write ``docs`` in a random order as Parquet shards under ``path``; returns the written table.

    Law ``rows``: shard sizes differ by one row at most. Added columns: size (UTF-8 bytes of the text plus
    1; null texts count 1), text_crc32 (of the UTF-8 bytes; of none for null), shard, slot (place in the
    shard, gapless from 0). Input columns that clash with these, in any case, are replaced.

    Pass 1 scatters rows over buckets of about ``bucket_bytes`` of text by a hash of the seed and of a row's
    place in the files that it is read from, so that equal rows spread like any others; what isn't read
    from files is written to the shared folder first. Each bucket is a partition of its own. Pass 2 brings
    a bucket's rows into the order of their places and applies a seeded Fisher-Yates permutation. The order
    of all rows is buckets one after another, so a prefix sum over bucket sizes (the driver holds one number
    for each bucket) gives each row its place, its shard and its slot, and a bucket writes to the few shards
    that it overlaps.

    A retried task sees the same rows in the same order, because places are those in written files and all
    seeds are fixed; so a lost executor changes nothing. The method knows no groups: equal texts may go to
    different shards. Null keys and null texts are ordinary rows; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    df = positioned(without(docs, ["size", "text_crc32", "shard", "slot", "_file", "_at", "_bucket"], keep=(key, text)))
    octets = F.coalesce(F.octet_length(text), F.lit(0))
    df = df.withColumns({"size": (octets + 1).cast("long"), "text_crc32": F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")))})
    buckets = max(1, math.ceil((df.agg(F.sum("size")).first()[0] or 0) / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_file", "_at"), F.lit(buckets)).cast("int").alias("_bucket")
    counts = df.select(bucket).groupBy("_bucket").agg(F.count("*").alias("n")).toPandas()  # a row for each bucket
    rows = np.zeros(buckets, np.int64)
    rows[counts["_bucket"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    starts, total = np.concatenate([[0], np.cumsum(rows)]), int(rows.sum())
    ends = [total * (i + 1) // shards for i in range(shards)]
    begins = np.array([0, *ends[:-1]], np.int64)

    names = [c for c in df.columns if c not in ("_file", "_at")]
    out = StructType([*df.select(*names).schema.fields, StructField("shard", LongType()), StructField("slot", LongType())])
    arrow = to_arrow_schema(out)
    order = [(c, "ascending") for c in ("_file", "_at", key, "size", "text_crc32")]

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held)
        bucket = int(part.column("_bucket")[0].as_py())
        if len(part) != rows[bucket]:
            raise ValueError(f"bucket {bucket} has {len(part)} rows where {rows[bucket]} were counted: the input has changed")
        at = pa.compute.sort_indices(part.select([c for c, _ in order]), sort_keys=order)
        at = at.take(pa.array(np.random.default_rng([seed, bucket]).permutation(len(part))))
        part = part.select(names)
        place = int(starts[bucket]) + np.arange(len(part))
        shard = np.searchsorted(begins, place, side="right") - 1
        for lo in range(0, len(part), 1024):  # the batches that leave are small even if a bucket isn't
            some = slice(lo, lo + 1024)
            columns = [*part.take(at.slice(lo, 1024)).columns, pa.array(shard[some]), pa.array((place - begins[shard])[some])]
            yield from pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow).to_batches()

    done = df.select("*", bucket).repartitionById(buckets, "_bucket").mapInArrow(released(permute), out)
    done.write.partitionBy("shard").parquet(path)
    columns = [f.name for f in out.fields]
    return spark.read.schema(out).parquet(path).select(*columns)


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with the place of each row in the files it is read from: _file (without the part of the name that no seed fixes) and _at."""

    def places(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        name = F.regexp_replace(meta.getField("file_name"), "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
        return df.select("*", name.alias("_file"), meta.getField("row_index").alias("_at"))

    try:
        return places(df)
    except AnalysisException:  # not read from files that number their rows
        return places(cut(df, "shard-input"))


# ---------------------------------------------------------------------------------------------- query


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, read back from the files that were written."""
    docs = exact(load(spark, sf_dir, "documents"), "doc_id", "text")
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    done = shuffle_and_shard(docs, path, shards=8)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
