"""Embedders. Texts become sparse rows (id, idx, weight) by aggregates; dense vectors are made on demand.

``df`` has an id and a text column. Fitted embedders keep their corpus statistics as tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import kernels
from lexispark.operators.match import match_text
from lexispark.sources.vocabulary import Vocabulary


def _boost(term: Column, vocabulary: Vocabulary | None, boost: float, underscores: bool = False) -> Column:
    known = vocabulary.domain_terms if vocabulary else []
    if not known:
        return F.lit(1.0)
    hit = term.isin(known)
    if underscores:
        hit = hit | F.replace(term, F.lit("_"), F.lit(" ")).isin(known)
    return F.when(hit, boost).otherwise(1.0)


def occurrences(df: DataFrame, tokens: Column, id: str, pairs: bool = False) -> DataFrame:
    """(id, term): a row for each token and, with ``pairs``, for each two in a row; pairs are made outside of lambdas, in generated code."""
    if not pairs:
        return df.select(id, F.explode(tokens).alias("term"))
    df = df.select(id, tokens.alias("_t"))
    df = df.select(id, F.inline(F.arrays_zip(F.col("_t").alias("a"), F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))).alias("b"))))
    return df.select(id, F.explode(F.array("a", F.concat("a", F.lit("_"), "b"))).alias("term")).where("term IS NOT NULL")


def term_counts(rows: DataFrame, id: str) -> DataFrame:
    """(id, term, tf) of (id, term)."""
    return rows.groupBy(id, "term").agg(F.count("*").alias("tf"))


def normalized(weights: DataFrame, id: str) -> DataFrame:
    """Weights of each id divided by their length."""
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id)))
    return weights.withColumn("weight", F.when(size > 0, F.col("weight") / size).otherwise(F.col("weight")))


def dense(weights: DataFrame, id: str, n: int, name: str = "embedding") -> DataFrame:
    """(id, embedding array<double>) from sparse rows; ids without any weight are absent."""
    held = weights.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    return held.select(id, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.lit(0.0))).alias(name))


def numbered(df: DataFrame, by: list[str], block: Column, group: list[str] | None = None, name: str = "idx") -> DataFrame:
    """``df`` with the place of each row in the order of ``by`` within its ``group``, from 0.

    ``block`` is a value of each row that grows with ``by``; rows are numbered in each block, after the sizes of the blocks
    before, so no task has more than the rows of a block, or one row for each block of a group.
    """
    group = group or []
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*group, "_block").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "_block", before.alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*by)))
    return own.join(starts, [*group, "_block"]).select(*df.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias(name))


@dataclass
class HashEmbedder:
    """Signed feature hashing of words and pairs of words; nothing to fit."""

    vocabulary: Vocabulary | None = None
    n_features: int = 1024
    use_bigrams: bool = True
    domain_boost: float = 2.0

    def fit(self, df: DataFrame, text: str = "text") -> HashEmbedder:
        return self

    @property
    def n_dimensions(self) -> int:
        return self.n_features

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        if kernels.unique(df, id):
            return kernels.hash_rows(df, id, text, *self._options)
        counts = term_counts(occurrences(df, T.remove_stopwords(T.tokenize(F.col(text))), id, self.use_bigrams), id)
        idx, sign = T.hash_term(F.col("term"), self.n_features)
        weight = sign * (1 + F.log("tf")) * _boost(F.col("term"), self.vocabulary, self.domain_boost, underscores=True)
        sums = counts.select(id, idx.alias("idx"), weight.alias("w")).groupBy(id, "idx").agg(F.sum("w").alias("weight"))
        return normalized(sums, id)

    @property
    def _options(self) -> tuple:
        return self.n_features, self.use_bigrams, self.vocabulary.domain_terms if self.vocabulary else [], self.domain_boost

    def vector(self, text: Column) -> Column:
        """The dense vector of a text in its row; null for one without any term."""
        return kernels.hash_vectors(F.lower(text), *self._options)

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        if kernels.unique(df, id):
            return df.select(id, self.vector(F.col(text)).alias("embedding")).where(F.col("embedding").isNotNull())
        return dense(self.sparse(df, id, text), id, self.n_features)


@dataclass
class TFIDFEmbedder:
    vocabulary: Vocabulary | None = None
    domain_boost: float = 2.0
    max_features: int = 10_000
    min_df: int = 1
    use_idf: bool = True
    sublinear_tf: bool = True
    normalize: bool = True
    use_bigrams: bool = True
    remove_stopwords: bool = True
    use_stemming: bool = True
    terms: DataFrame | None = field(default=None, repr=False)

    @property
    def _terms(self):
        options = self.use_bigrams, self.remove_stopwords, self.use_stemming
        return lambda: kernels.tfidf_terms(*options)

    def counts(self, df: DataFrame, id: str, text: str) -> DataFrame:
        """(id, term, tf): stop words and stems are looked at row by row, in generated code."""
        rows = occurrences(df, T.tokenize(F.col(text)), id, self.use_bigrams)
        if self.remove_stopwords:
            rows = rows.where(~F.col("term").isin(T.STOPWORDS))
        if self.use_stemming:
            rows = rows.select(id, T.stem(F.col("term")).alias("term"))
        return term_counts(rows, id)

    def fit(self, df: DataFrame, text: str = "text", id: str | None = None) -> TFIDFEmbedder:
        """Terms by total frequency, equal ones by name; (idx, term, df, idf).

        With ``id`` the texts of a repeated id are one document.
        """
        n = df.select(F.count("*").alias("n"))
        if id is None or kernels.unique(df, id):
            stats = kernels.term_totals(df, text, self._terms).select("term", F.col("frequency").alias("freq"), F.col("doc_frequency").alias("df"))
        else:
            stats = self.counts(df, id, text).groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
        stats = stats.where(F.col("df") >= self.min_df)
        top = stats.orderBy(F.desc("freq"), "term").limit(self.max_features)  # the window below orders these few only
        idf = F.log((n.scalar().cast("double") + 1) / (F.col("df") + 1)) + 1 if self.use_idf else F.lit(1.0)
        self.terms = top.select((F.row_number().over(Window.orderBy(F.desc("freq"), "term")) - 1).cast("long").alias("idx"), "term", "df", idf.alias("idf"))
        return self

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        if self.terms is None:
            raise ValueError("fit first")
        if self.max_features <= 200_000 and kernels.unique(df, id):
            held = self.terms.select("term", "idx", (F.col("idf") * _boost(F.col("term"), self.vocabulary, self.domain_boost)).cast("double")).collect()  # max_features rows
            return kernels.weighted_rows(df, id, text, self._terms, [tuple(r) for r in held], self.sublinear_tf, self.normalize)
        tf = 1 + F.log("tf") if self.sublinear_tf else F.col("tf")
        weight = tf * F.col("idf") * _boost(F.col("term"), self.vocabulary, self.domain_boost)
        terms = F.broadcast(self.terms) if self.max_features <= 200_000 else self.terms
        out = self.counts(df, id, text).join(terms, "term").select(id, "idx", weight.cast("double").alias("weight"))
        return normalized(out, id) if self.normalize else out

    @property
    def n_dimensions(self) -> int:
        return self.terms.count()

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return dense(self.sparse(df, id, text), id, self.n_dimensions)


@dataclass
class BM25Embedder:
    vocabulary: Vocabulary | None = None
    k1: float = 1.5
    b: float = 0.75
    domain_boost: float = 2.0
    terms: DataFrame | None = field(default=None, repr=False)
    average: float = 1.0

    def tokens(self, text: Column) -> Column:
        return T.remove_stopwords(T.tokenize(text))

    def fit(self, df: DataFrame, text: str = "text", id: str | None = None) -> BM25Embedder:
        """With ``id`` the texts of a repeated id count as one document."""
        n, total = df.count(), kernels.n_terms(df, text, self._terms)
        self.average = total / n if n else 1.0
        if id is None or kernels.unique(df, id):
            stats = kernels.term_totals(df, text, self._terms).select("term", F.col("doc_frequency").alias("df"))
        else:
            stats = self.counts(df, id, text).groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        self.terms = stats.select("term", "df", idf.alias("idf"))
        return self

    @property
    def _terms(self):
        return lambda: kernels.hash_terms(False)

    def counts(self, df: DataFrame, id: str, text: str) -> DataFrame:
        """(id, term, tf, n): n is the number of tokens of the text."""
        df = df.select(id, self.tokens(F.col(text)).alias("_t"))
        return df.select(id, F.size("_t").alias("_n"), F.explode("_t").alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"), F.first("_n").alias("n"))

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        """(id, term, weight): dimensions are the terms themselves."""
        if self.terms is None:
            raise ValueError("fit first")
        if kernels.unique(df, id):
            terms = self.terms.select("term", (F.col("idf") * _boost(F.col("term"), self.vocabulary, self.domain_boost)).alias("factor"))
            return kernels.bm25_rows(df, id, text, self._terms, terms, self.k1, self.b, self.average or 1.0)
        counts = self.counts(df, id, text)
        part = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("n") / (self.average or 1.0)))
        weight = F.col("idf") * part * _boost(F.col("term"), self.vocabulary, self.domain_boost)
        return normalized(counts.join(self.terms, "term").select(id, "term", weight.alias("weight")), id)

    @property
    def n_dimensions(self) -> int:
        return self.terms.count()

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        index = numbered(self.terms.select("term"), ["term"], F.left(F.col("term"), F.lit(3)))
        return dense(self.sparse(df, id, text).join(index, "term"), id, self.n_dimensions)


@dataclass
class ConceptEmbedder:
    """A dimension for each canonical term, capability and category; equal names share one."""

    vocabulary: Vocabulary
    include_capabilities: bool = True
    include_categories: bool = True

    def fit(self, df: DataFrame, text: str = "text") -> ConceptEmbedder:
        return self

    @property
    def dimensions(self) -> dict[str, int]:
        names = [e.canonical_term.lower() for e in self.vocabulary.entries]
        if self.include_capabilities:
            names += [c.lower() for e in self.vocabulary.entries for c in e.capabilities]
        if self.include_categories:
            names += [e.category.lower() for e in self.vocabulary.entries]
        return {name: i for i, name in enumerate(dict.fromkeys(names))}

    @property
    def n_dimensions(self) -> int:
        return len(self.dimensions)

    def activations(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        """(id, name, idx, weight) before normalisation: 1 for a concept, 0.5 for its capabilities, 0.3 for its category."""
        df = match_text(df, self.vocabulary, text, out="_m").select(id, F.explode("_m").alias("m"))
        hits = [F.array(F.struct(F.lower("m.canonical_term").alias("name"), F.lit(1.0).alias("w")))]
        if self.include_capabilities:
            hits.append(F.transform("m.capabilities", lambda c: F.struct(F.lower(c).alias("name"), F.lit(0.5).alias("w"))))
        if self.include_categories:
            hits.append(F.array(F.struct(F.lower("m.category").alias("name"), F.lit(0.3).alias("w"))))
        sums = df.select(id, F.explode(F.concat(*hits)).alias("x")).groupBy(id, F.col("x.name").alias("name")).agg(F.sum("x.w").alias("weight"))
        index = F.map_from_arrays(F.array(*map(F.lit, self.dimensions)), F.array(*[F.lit(i).cast("long") for i in self.dimensions.values()]))
        return sums.select(id, "name", index[F.col("name")].alias("idx"), "weight")

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return normalized(self.activations(df, id, text), id).select(id, "idx", "weight")

    def explain(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        """(id, name, weight): active dimensions, the strongest first within an id."""
        return normalized(self.activations(df, id, text), id).where("weight > 0").select(id, "name", "weight").orderBy(id, F.desc("weight"), "name")

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return dense(self.sparse(df, id, text), id, self.n_dimensions)


@dataclass
class Concatenated:
    """Two embedders side by side, each with its weight; not normalised again."""

    left: object
    right: object
    left_weight: float = 0.6
    right_weight: float = 0.4

    def fit(self, df: DataFrame, text: str = "text") -> Concatenated:
        self.left.fit(df, text)
        self.right.fit(df, text)
        return self

    @property
    def n_dimensions(self) -> int:
        return self.left.n_dimensions + self.right.n_dimensions

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        left = self.left.sparse(df, id, text).select(id, "idx", (F.col("weight") * self.left_weight).alias("weight"))
        shift = self.left.n_dimensions
        return left.unionByName(self.right.sparse(df, id, text).select(id, (F.col("idx") + shift).alias("idx"), (F.col("weight") * self.right_weight).alias("weight")))

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return dense(self.sparse(df, id, text), id, self.n_dimensions)


def hybrid(vocabulary: Vocabulary, text_embedder: str = "hash", n_features: int = 512, **kw) -> Concatenated:
    right = TFIDFEmbedder(vocabulary, max_features=n_features) if text_embedder == "tfidf" else HashEmbedder(vocabulary, n_features)
    return Concatenated(ConceptEmbedder(vocabulary), right, **kw)


def _learned(vocabulary: Vocabulary, **kw):
    from lexispark.operators.learned import LearnedEmbedder

    return LearnedEmbedder(**kw)


def _learned_hybrid(vocabulary: Vocabulary, n_features: int = 512, **kw):
    return Concatenated(_learned(vocabulary, **kw), HashEmbedder(None, n_features), 0.7, 0.3)


EMBEDDERS: dict[str, Callable] = {"hybrid": hybrid, "tfidf": TFIDFEmbedder, "hash": HashEmbedder, "domain": ConceptEmbedder, "bm25": BM25Embedder, "learned": _learned, "learned_hybrid": _learned_hybrid}


def create_embedder(kind: str, vocabulary: Vocabulary, **kw):
    """An embedder by name. Options that belong to another kind are left out, so one set of options serves all."""
    if kind not in EMBEDDERS:
        raise ValueError(f"unknown embedder {kind!r}; there are {', '.join(EMBEDDERS)}")
    make = EMBEDDERS[kind]
    names = {"hybrid": {"text_embedder", "n_features", "left_weight", "right_weight"}, "learned": {"config", "dimensions"}, "learned_hybrid": {"n_features", "config", "dimensions"}}.get(kind)
    names = names or {f.name for f in fields(make)} - {"vocabulary", "terms", "average"}
    return make(vocabulary, **{k: v for k, v in kw.items() if k in names})


def save_state(embedder, path: str) -> None:
    """Write what an embedder has been fitted to, so that it need not see the corpus again; nothing for those without."""
    for i, part in enumerate([embedder.left, embedder.right] if isinstance(embedder, Concatenated) else [embedder]):
        if getattr(part, "terms", None) is not None:
            part.terms.withColumn("_average", F.lit(float(getattr(part, "average", 0.0)))).write.mode("overwrite").parquet(f"{path}/{i}")
        elif getattr(part, "dimensions", None) and hasattr(part, "save"):
            part.save(SparkSession.active(), f"{path}/{i}")


def load_state(spark: SparkSession, embedder, path: str) -> bool:
    """Give an embedder what :func:`save_state` wrote; whether it is fitted now."""
    for i, part in enumerate([embedder.left, embedder.right] if isinstance(embedder, Concatenated) else [embedder]):
        if hasattr(part, "terms"):
            try:
                terms = spark.read.parquet(f"{path}/{i}")
            except AnalysisException:
                return False
            part.terms = terms.drop("_average")
            if hasattr(part, "average"):
                row = terms.select("_average").first()
                part.average = row[0] if row else 1.0
        elif hasattr(part, "save"):
            try:
                part.__dict__.update(type(part).load(spark, f"{path}/{i}").__dict__)
            except AnalysisException:
                return False
    return True
