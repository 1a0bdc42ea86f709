"""Searches over an index: hybrid, by capability, and across source types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.index import capability_set, canonical_terms, lookup, vector_topk
from lexispark.sources.vocabulary import Vocabulary

RESULT = ["rank", "chunk_id", "source_type", "vector_score", "concept_score", "combined_score", "matched_concepts", "matched_capabilities", "retrieval_method"]


def concept_weights(vocabulary: Vocabulary, query: str) -> dict[str, float]:
    """What a chunk scores for each concept: 1 for each that the query matches, 0.5 for each expanded term of its owner."""
    out: dict[str, float] = {}
    for _, e, _ in vocabulary.match(query):
        name = vocabulary.entries[e].canonical_term.lower()
        out[name] = out.get(name, 0.0) + 1.0
    for term in vocabulary.expand(query):
        entry = vocabulary.entry_by_term(term)
        if entry:
            name = entry.canonical_term.lower()
            out[name] = out.get(name, 0.0) + 0.5
    return out


def concept_scores(found: DataFrame, weights: dict[str, float], capabilities: list[str] | None, source_types: list[str] | None) -> DataFrame:
    """(chunk_id, concept_score): sums of weights, divided by the greatest. Postings are filtered by key before anything moves."""
    cases = [(F.col("kind") == "concept") & (F.col("key") == name) for name in weights]
    case = reduce(lambda a, x: a.when(x[0], x[1]), zip(cases, weights.values(), strict=True), F.when(F.lit(False), 0.0))
    wanted = reduce(lambda a, b: a | b, cases, F.lit(False))
    for c in capabilities or []:
        hit = (F.col("kind") == "capability") & (F.col("key") == c)
        case, wanted = case.when(hit, 0.5 * (capabilities or []).count(c)), wanted | hit
    rows = found.where(wanted)
    if source_types:
        rows = rows.where(F.col("source_type").isin(source_types))
    rows = rows.groupBy("chunk_id").agg(F.sum(case).alias("raw"))
    top = rows.agg(F.max("raw")).scalar()
    return rows.select("chunk_id", F.when(top > 0, F.col("raw") / top).otherwise(F.col("raw")).alias("concept_score"))


def hybrid_search(
    chunks: DataFrame, found: DataFrame, vocabulary: Vocabulary, query: str, top_k: int = 10, source_types: list[str] | None = None,
    capabilities: list[str] | None = None, vector_weight: float = 0.5, concept_weight: float = 0.5, query_embedding: list[float] | None = None,
) -> DataFrame:
    """The ``top_k`` chunks by a weighted sum of cosine and concept score; equal ones by chunk_id. Columns as in ``RESULT``.

    Capabilities filter vectors and add to concept scores; source types filter both. 3 ``top_k`` vectors
    are fused. Without ``query_embedding`` only concepts count. The chunks themselves are met by the hits only.
    """
    where: Column | None = None
    if source_types:
        where = F.col("source_type").isin(source_types)
    if capabilities:
        has = F.arrays_overlap(capability_set(), F.array(*map(F.lit, capabilities)))
        where = has if where is None else where & has
    concepts = concept_scores(found, concept_weights(vocabulary, query), capabilities, source_types)
    if query_embedding is None:
        fused = concepts.select("chunk_id", F.lit(0.0).alias("vector_score"), "concept_score")
    else:
        near = vector_topk(chunks, query_embedding, 3 * top_k, where=where).withColumnRenamed("score", "vector_score")
        fused = near.join(concepts, "chunk_id", "full_outer").select("chunk_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vector_score", "concept_score")])
    fused = fused.withColumn("combined_score", vector_weight * F.col("vector_score") + concept_weight * F.col("concept_score"))
    order = (F.desc(F.round("combined_score", 9)), "chunk_id")  # sums in another order differ in their last bits
    top = fused.orderBy(*order).limit(top_k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of top_k rows
    asked = [vocabulary.entries[e].canonical_term.lower() for _, e, _ in vocabulary.match(query)]
    method = F.when((F.col("vector_score") > 0) & (F.col("concept_score") > 0), "hybrid").when(F.col("vector_score") > 0, "vector").otherwise("concept")
    hit = F.filter("domain_matches", lambda m: F.lower(m["canonical_term"]).isin(asked) if asked else F.lit(False))
    done = chunks.join(F.broadcast(top), "chunk_id").withColumn("_hit", hit)  # top_k rows
    return done.withColumns(
        {
            "matched_concepts": F.array_sort(F.array_distinct(F.transform("_hit", lambda m: m["canonical_term"]))),
            "matched_capabilities": F.array_sort(F.array_distinct(F.flatten(F.transform("_hit", lambda m: m["capabilities"])))),
            "retrieval_method": method,
        }
    ).select(*RESULT, *[c for c in chunks.columns if c not in RESULT and c != "embedding"])


def capability_search(chunks: DataFrame, found: DataFrame, capability: str, top_k: int = 10) -> DataFrame:
    """``top_k`` chunks with a capability, by chunk_id; they all score 1."""
    top = lookup(found, "capability", capability).distinct().orderBy("chunk_id").limit(top_k)
    return chunks.join(F.broadcast(top), "chunk_id").select(
        "chunk_id", "source_type", F.lit(1.0).alias("combined_score"), F.array(F.lit(capability)).alias("matched_capabilities"), F.lit("concept").alias("retrieval_method")
    )


def cross_reference(chunks: DataFrame, found: DataFrame, vocabulary: Vocabulary, query: str, source_type: str, reference_types: list[str], top_k: int = 5, **kw) -> DataFrame:
    """(result_type, rank, chunk_id, score, retrieval_method): hits of one source type, then chunks of others that share up to five concepts with them.

    The concepts are the first by rank of the hit, then name; chunks of a type stand by concept, then chunk_id.
    """
    first = hybrid_search(chunks, found, vocabulary, query, top_k, [source_type], **kw)
    own = first.select(F.lit(source_type).alias("result_type"), "rank", "chunk_id", F.col("combined_score").alias("score"), "retrieval_method")
    names = first.select("rank", F.explode(canonical_terms()).alias("concept")).groupBy("concept").agg(F.min("rank").alias("r")).orderBy("r", "concept").limit(5)
    names = names.select(F.lower("concept").alias("key"), F.row_number().over(Window.orderBy("r", "concept")).alias("o"))  # five rows
    hits = found.where((F.col("kind") == "concept") & F.col("source_type").isin(reference_types)).join(F.broadcast(names), "key")
    hits = hits.groupBy("source_type", "chunk_id").agg(F.min("o").alias("o"))
    order = Window.partitionBy("source_type").orderBy("o", "chunk_id")
    rest = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return own.unionByName(rest.select(F.col("source_type").alias("result_type"), "rank", "chunk_id", F.lit(1.0).alias("score"), F.lit("cross_reference").alias("retrieval_method")))
