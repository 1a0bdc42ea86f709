"""The whole path from files to answers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import index
from lexispark.operators.embed import create_embedder, load_state, save_state
from lexispark.plans import search
from lexispark.sources import files
from lexispark.sources.vocabulary import Vocabulary


class Pipeline:
    """Files are indexed under ``path``; searches read what is there.

    ``embedder`` names one of the embedders (None for concepts only); ``embed`` is a function from a text
    column to a vector column that is used instead. ``progress`` is called with the name of each step of an
    indexing run that is done, its number and the number of steps.
    """

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, path: str, embedder: str | None = "hash", embed: Callable[[Column], Column] | None = None, progress: Callable[[str, int, int], None] | None = None, **options):
        self.progress = progress
        self.spark, self.vocabulary, self.path, self.kind, self.options, self.embed = spark, vocabulary, path, embedder, options, embed
        self.embedder = create_embedder(embedder, vocabulary, **options) if embedder else None
        self._corpus: DataFrame | None = None

    def set_embedder(self, kind: str, **options) -> None:
        self.kind, self.options, self.embed = kind, options, None
        self.embedder = create_embedder(kind, self.vocabulary, **options)

    def fit_embedder(self, texts: DataFrame, text: str = "text") -> None:
        self.embedder.fit(texts, text)

    def _done(self, step: str, number: int) -> None:
        if self.progress is not None:
            self.progress(step, number, 4)

    def parser_info(self) -> list[dict]:
        return files.parser_info()

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        if self.embed is not None:
            return chunks.withColumn("embedding", self.embed(F.col("embedding_text")))
        if self.embedder is None:
            return chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
        return chunks.join(self.embedder.transform(chunks, "chunk_id", "embedding_text"), "chunk_id", "left")

    def index_directory(self, path: str, recursive: bool = True, extensions: list[str] | None = None, exclude: list[str] | None = None, kind: str | None = None) -> DataFrame:
        """Index all files; returns (path, source_type, chunks, error) for each."""
        return self.index_files(files.read(self.spark, path, recursive, extensions, exclude, kind))

    def index_content(self, content: bytes, path: str, kind: str | None = None) -> DataFrame:
        one = self.spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
        one = one.select("path", F.lit(kind).alias("source_type") if kind else files.source_type(F.col("path")).alias("source_type"), "content")
        return self.index_files(one, add=True)

    def index_files(self, found: DataFrame, add: bool = False) -> DataFrame:
        chunks, errors = files.chunks(found, self.vocabulary)
        chunks = chunks.dropDuplicates(["chunk_id"])
        chunks.write.mode("append" if add else "overwrite").parquet(f"{self.path}/parsed")
        parsed = self.spark.read.parquet(f"{self.path}/parsed").dropDuplicates(["chunk_id"])
        self._done("parsed", 1)
        if self.embedder is not None and hasattr(self.embedder, "terms") and self.embedder.terms is None or getattr(self.embedder, "dimensions", None) == []:
            self.embedder.fit(parsed, "embedding_text")  # corpus statistics come from what is indexed
        if self.embedder is not None:
            save_state(self.embedder, f"{self.path}/embedder")
            load_state(self.spark, self.embedder, f"{self.path}/embedder")  # and are read from there, not computed again
        self._done("fitted", 2)
        index.save(self._embedded(parsed), self.path)
        self._done("embedded", 3)
        manifest = {"embedder": self.kind, "options": self.options, "vocabulary": self.vocabulary.to_rows()}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        self._done("described", 4)
        per = parsed.groupBy("path", "source_type").agg(F.count("*").alias("chunks"))
        return found.select("path", "source_type").join(per, ["path", "source_type"], "left").join(errors, "path", "left").select("path", "source_type", F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed: Callable | None = None) -> Pipeline:
        """A pipeline over an index that was saved, with what its embedder was fitted to; one without is fitted on the indexed texts."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        out = cls(spark, Vocabulary(manifest["vocabulary"]), path, manifest["embedder"], embed, **manifest["options"])
        if out.embedder is not None and not load_state(spark, out.embedder, f"{path}/embedder"):
            out.embedder.fit(spark.read.parquet(f"{path}/parsed").dropDuplicates(["chunk_id"]), "embedding_text")
        return out

    @property
    def tables(self) -> tuple[DataFrame, DataFrame]:
        return index.load(self.spark, self.path)

    def query_embedding(self, query: str) -> list[float] | None:
        one = self.spark.createDataFrame([("q", query)], "chunk_id string, embedding_text string")
        if self.embed is not None:
            return one.select(self.embed(F.col("embedding_text")).alias("v")).first().v
        if self.embedder is None:
            return None
        row = self.embedder.transform(one, "chunk_id", "embedding_text").first()
        return row.embedding if row else [0.0] * self.embedder.n_dimensions

    def search(self, query: str, top_k: int = 10, source_types: list[str] | None = None, capabilities: list[str] | None = None, vector_weight: float = 0.5, concept_weight: float = 0.5) -> DataFrame:
        return search.hybrid_search(*self.tables, self.vocabulary, query, top_k, source_types, capabilities, vector_weight, concept_weight, self.query_embedding(query))

    def search_cross_reference(self, query: str, from_type: str, to_types: list[str], top_k: int = 5) -> DataFrame:
        return search.cross_reference(*self.tables, self.vocabulary, query, from_type, to_types, top_k, query_embedding=self.query_embedding(query))

    def related_code(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search(query, top_k, ["code"])

    def documentation(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search(query, top_k, ["document"])

    def by_capability(self, capability: str, top_k: int = 10) -> DataFrame:
        return search.capability_search(*self.tables, capability, top_k)

    def statistics(self) -> DataFrame:
        return index.statistics(*self.tables)

    def capability_counts(self) -> DataFrame:
        return self.tables[1].where("kind = 'capability'").groupBy(F.col("key").alias("capability")).agg(F.countDistinct("chunk_id").alias("chunks")).orderBy("capability")
