"""Many queries against all vectors: blocks of queries go to the vectors, and each task keeps its best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent out at a time; more are taken in further blocks. Scores that are held at a time: vectors by queries.
BLOCK, TILE = 4096, 1 << 21


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank): for each query the k vectors of greatest cosine (to nine digits), equal scores by id.

    A task multiplies its vectors with a block of queries and passes on k rows for each query, however many
    vectors tie, so a row for each pair never exists. ``queries`` has query_id and the embedding column. Empty vectors score 0.
    """
    kind, qkind = vectors.schema[id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    held = queries.select(query_id, embedding).toArrow().combine_chunks()  # the stated set of queries, as numbers
    ids, parts = held.column(0).to_pylist(), []
    for lo in range(0, len(ids), BLOCK):
        q = _matrix(held.column(1).slice(lo, BLOCK).combine_chunks(), None)
        parts.append(vectors.select(id, embedding).mapInArrow(_best(ids[lo : lo + BLOCK], q, k), f"query_id {qkind}, id {kind}, score double"))
    if not parts:
        return vectors.select(F.lit(None).cast(qkind).alias("query_id"), F.col(id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", id)


def _matrix(vectors: pa.Array, n: int | None) -> np.ndarray:
    """Vectors as rows of n numbers; those of another length, or null, are zeros."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = int(size.max(initial=0)) if n is None else n
    flat = pc.cast(vectors.flatten(), pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), n))
    good = size == n
    out[good] = flat.reshape(-1, n) if good.all() else flat[np.repeat(good, size)].reshape(-1, n)
    return out


def _best(ids: list, q: np.ndarray, k: int):
    """The k best of a task's vectors for each query. A tile of scores is held at a time, and k rows for each query as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, m = np.linalg.norm(q, axis=1), len(ids)
        step = max(1, TILE // max(1, m))
        least = np.full(m, -np.inf)  # the k-th best so far
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                v = _matrix(some.column(1), q.shape[1])
                score = v @ q.T
                score /= np.outer(np.linalg.norm(v, axis=1), size) + 1e-8
                key = score.round(9)
                bar = least if len(v) <= k else np.maximum(least, np.partition(key, len(v) - k, axis=0)[len(v) - k])
                row, col = np.nonzero(key >= bar)
                if not len(row):
                    continue
                fresh = pa.table({"q": col, "key": key[row, col], "id": some.column(0).take(pa.array(row)), "score": score[row, col]})
                held = fresh if held is None else pa.concat_tables([held, fresh])
                held = held.take(pc.sort_indices(held, sort_keys=[("q", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start"))
                of = held.column("q").to_numpy()
                place = np.arange(len(of)) - np.searchsorted(of, of)
                held = held.filter(pa.array(place < k)).combine_chunks()
                of, place = held.column("q").to_numpy(), place[place < k]
                least[of[place == k - 1]] = held.column("key").to_numpy()[place == k - 1]
        if held is not None:
            own = pa.array(ids).take(pa.array(held.column("q").to_numpy()))
            yield pa.RecordBatch.from_arrays([own, held.column("id").combine_chunks(), held.column("score").combine_chunks()], ["query_id", "id", "score"])

    return run
