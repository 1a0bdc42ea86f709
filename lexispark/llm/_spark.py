"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exact(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched by exact spelling.

    A table may carry further columns whose names differ in case only; Spark would call such a
    reference ambiguous, so columns are addressed by position.
    """
    order = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [name for name in names if name not in order]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{order[name]}").alias(name) for name in names])


def without(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but those whose names clash, in any case, with ``names`` or with an earlier column.

    ``keep`` is spelled exactly and always stays.
    """
    taken = {name.lower() for name in names} | {name.lower() for name in keep}
    picked = []
    for i, name in enumerate(df.columns):
        if name in keep and all(name != p for _, p in picked):
            picked.append((i, name))
        elif name.lower() not in taken:
            taken.add(name.lower())
            picked.append((i, name))
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(name) for i, name in picked])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset one is made, if all executors are in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        current = context.getCheckpointDir()
        if current is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
            current = context.getCheckpointDir()
        return current
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    What was written survives the loss of any executor, and later stages read a fixed row order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`cut` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def per_key(rows: DataFrame, table: DataFrame, key: str, weight: str = "n", small: int = 100_000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``weight`` how many of ``rows`` there are, and which is written.

    The keys of most rows are joined by a broadcast of at most ``small`` rows of ``table``, so no task gets more than
    a share of 1 / ``small`` of all rows for one key; the others meet by a shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    most = max(1000, -(-int(total) // small))  # no more than ``small`` keys can have more rows than that
    hot = table.where(F.col(weight) > most)
    if not hot.head(1):
        return rows.join(table, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def released(run):
    """An Arrow function that gives memory back to the system when its partition ends: workers live on, idle, beside later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
