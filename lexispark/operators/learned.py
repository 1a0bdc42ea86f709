"""Dimensions learned from a corpus: terms, their co-occurrence, and clusters of terms."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators import kernels
from lexispark.operators.embed import dense, normalized

#: Words that are no terms.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need",
    "this", "that", "these", "those", "it", "its", "if", "then", "else", "when", "where", "which", "who", "what", "how", "why", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no", "not", "only", "same", "so", "than", "too", "very", "just", "also",
    "now", "here", "there", "any", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further",
    "once", "end", "begin", "return", "int", "string", "proc", "call", "true", "false", "null", "none", "def", "class", "function", "var",
    "let", "const", "import", "export", "default", "new", "delete", "type", "interface", "enum", "struct", "void", "public", "private",
    "static", "final", "abstract", "extends", "implements", "override",
]
#: Terms of one, two and three words. Matches of a pattern don't overlap.
UNIGRAM = r"(?U)\b([a-z][a-z0-9_\-\.]*[a-z0-9]|[a-z])\b"
BIGRAM = r"(?U)\b([a-z][a-z0-9]*)\s+([a-z][a-z0-9]*)\b"
TRIGRAM = r"(?U)\b([a-z][a-z0-9]*)\s+([a-z][a-z0-9]*)\s+([a-z][a-z0-9]*)\b"


@dataclass
class Config:
    min_term_frequency: int = 3
    max_term_frequency_pct: float = 0.8
    min_term_length: int = 2
    max_terms: int = 1000
    extract_bigrams: bool = True
    extract_trigrams: bool = True
    window: int = 50
    min_cooccurrence: int = 2
    n_dimensions: int = 80
    clustering: str = "hierarchical"


def _valid(term: Column, least: int) -> Column:
    return (F.length(term) >= least) & ~term.isin(STOPWORDS) & ~term.rlike("^[0-9]+$")


def document_terms(text: Column, config: Config) -> Column:
    """Terms of a text, as often as they occur."""
    low = F.lower(text)
    out = [F.filter(F.regexp_extract_all(low, F.lit(UNIGRAM), 1), lambda t: _valid(t, config.min_term_length))]
    for pattern, n in ((BIGRAM, 2), (TRIGRAM, 3)):
        if config.extract_bigrams if n == 2 else config.extract_trigrams:
            words = F.transform(F.regexp_extract_all(low, F.lit(pattern), 0), lambda m: F.split(m, r"(?U)\s+"))
            good = F.filter(words, lambda w: F.forall(w, lambda t: _valid(t, config.min_term_length)))
            out.append(F.transform(good, lambda w: F.array_join(w, " ")))
    return F.concat(*out)


_WORD, _NONE = "\u00e9", "\u00b7"  # a letter that no pattern takes, and what is neither word nor blank


def _as_java(c: str) -> str:
    """A character for which Python's classes are those of Java's ``(?U)``."""
    kind = unicodedata.category(c)
    word = kind[0] == "L" or kind in ("Nl", "Nd", "Mn", "Mc", "Me", "Pc") or c in "\u200c\u200d" or c.isupper() or c.islower()
    blank = c.isspace() and c not in "\x1c\x1d\x1e\x1f"
    same = word == (c.isalnum() or c == "_") and blank == c.isspace()
    return c if same else _WORD if word else _NONE


def _term_reader(config: Config):
    """A function from a lowered text to its terms, as :func:`document_terms`, in Python."""
    same, changed = set(), {}  # characters met so far
    one, two, three = (re.compile(p[4:]).findall for p in (UNIGRAM, BIGRAM, TRIGRAM))
    stop, least, digits = frozenset(STOPWORDS), config.min_term_length, re.compile(r"[0-9]+\Z").match
    valid = kernels.Held(lambda word: len(word) >= least and word not in stop and not digits(word))

    def terms(low: str) -> list[str]:
        if not low.isascii() or not same.issuperset(low):
            for c in set(low).difference(same):
                if (other := _as_java(c)) == c:
                    same.add(c)
                else:
                    changed[ord(c)] = other
            low = low.translate(changed) if changed else low
        found = one(low)
        out = [w for w, good in zip(found, valid.of(found), strict=True) if good]
        if config.extract_bigrams:
            out += [f"{a} {b}" for a, b in two(low) if valid[a] and valid[b]]
        if config.extract_trigrams:
            out += [f"{a} {b} {c}" for a, b, c in three(low) if valid[a] and valid[b] and valid[c]]
        return out

    return terms


def term_statistics(df: DataFrame, config: Config, text: str = "text", all_terms: bool = False) -> DataFrame:
    """(term, frequency, doc_frequency, tfidf): the ``max_terms`` of greatest tf-idf, equal ones by name; or all that pass the filters."""
    n = df.count()
    stats = kernels.term_totals(df, text, lambda: _term_reader(config))
    stats = stats.where((F.col("frequency") >= config.min_term_frequency) & (F.col("doc_frequency") <= n * config.max_term_frequency_pct))
    stats = stats.withColumn("tfidf", (1 + F.log("frequency")) * F.log(F.lit(float(n)) / (1 + F.col("doc_frequency"))))
    return stats if all_terms else stats.orderBy(F.desc(F.round("tfidf", 9)), "term").limit(config.max_terms)


def occurrences(terms: list[str]):
    """A function from a text to (begin, index of the term) of all occurrences of ``terms``: one pass by an automaton, or a search for each."""
    try:
        import ahocorasick
    except ImportError:
        pattern = [re.compile(f"(?={re.escape(t)})") for t in terms]
        return lambda text: [(m.start(), i) for i, p in enumerate(pattern) for m in p.finditer(text)]
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, (i, len(t)))
    found.make_automaton()
    return lambda text: [(end - n + 1, i) for end, (i, n) in found.iter(text)] if terms else []


def _first_only(at: np.ndarray, group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which places of a term, sorted by ``group`` (one term of one text), stay when those that overlap an earlier one that stays go."""
    keep = np.ones(len(at), np.bool_)
    lap = np.flatnonzero((group[1:] == group[:-1]) & (at[1:] - at[:-1] < size[1:]))
    if len(lap):
        some = np.flatnonzero(np.isin(group, group[lap]))
        last, end = -1, -1
        for k, g, p, n in zip(some.tolist(), group[some].tolist(), at[some].tolist(), size[some].tolist(), strict=True):
            if g == last and p < end:
                keep[k] = False
            else:
                last, end = g, p + n
    return keep


def _window_pairs(terms: list[str], window: int):
    """Counts of pairs of terms that begin within ``window`` characters, summed over a task before they leave it.

    Texts of a slice stand one after the other, further apart than the window, and are paired together.
    """
    size, m = np.array([len(t) for t in terms], np.int64), len(terms)
    flat = m <= 2000  # sums are held for all pairs, else by pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = occurrences(terms)
        total, held = np.zeros(m * m if flat else 0, np.int64), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, kernels.SLICE):
                found, base, doc = [], [0], []
                for d, text in enumerate(batch.column(0).slice(lo, kernels.SLICE).to_pylist()):
                    low = (text or "").lower()
                    hits = finder(low)
                    found += hits
                    doc.append(len(hits))
                    base.append(base[-1] + len(low) + window + 1)
                if not found:
                    continue
                at = np.array(found, np.int64)
                place, which, own = at[:, 0] + np.repeat(base[:-1], doc), at[:, 1], np.repeat(np.arange(len(doc)), doc)
                order = np.lexsort((place, which, own))
                place, which, own = place[order], which[order], own[order]
                keep = _first_only(place, own * m + which, size[which])
                place, which = place[keep], which[keep]
                order = np.lexsort((which, place))
                place, which = place[order], which[order]
                n = len(place)
                left = np.searchsorted(place, place + window, side="right") - np.arange(n)
                i, d = np.flatnonzero(left > 1), 1
                while len(i):
                    a, b = which[i], which[i + d]
                    pair = (np.minimum(a, b) * m + np.maximum(a, b))[a != b]
                    if flat:
                        total += np.bincount(pair, minlength=m * m)
                    else:
                        held.update(dict(zip(*(x.tolist() for x in np.unique(pair, return_counts=True)), strict=True)))
                    d += 1
                    i = i[left[i] > d]
        pair = np.flatnonzero(total) if flat else np.array(list(held), np.int64)
        n = total[pair] if flat else np.array(list(held.values()), np.int64)
        name = pa.array(terms, pa.string())
        yield pa.RecordBatch.from_arrays([name.take(pa.array(pair // m if m else pair)), name.take(pa.array(pair % m if m else pair)), pa.array(n)], ["a", "b", "n"])

    return run


def cooccurrence(df: DataFrame, terms: list[str], config: Config, text: str = "text") -> DataFrame:
    """(t1, t2, cnt), t1 < t2: how often two terms begin within ``window`` characters of one another, ``min_cooccurrence`` times at least.

    ``terms`` are at most ``max_terms``, so pairs are bounded; occurrences are paired inside their text, by
    position in a band, never all with all.
    """
    held = df.select(F.col(text).alias("text")).mapInArrow(_window_pairs(sorted(terms), config.window), "a string, b string, n long")
    return held.groupBy(F.col("a").alias("t1"), F.col("b").alias("t2")).agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= config.min_cooccurrence)


def npmi(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(t1, t2, cnt, npmi): normalised pointwise mutual information, not below 0."""
    total = pairs.agg(F.sum("cnt").cast("double")).scalar()  # of the exchange below, so texts are read once
    freq = stats.select("term", "frequency")
    all_freq = stats.agg(F.sum("frequency").cast("double").alias("total_freq"))
    one = pairs.join(freq.select(F.col("term").alias("t1"), F.col("frequency").alias("f1")), "t1").join(freq.select(F.col("term").alias("t2"), F.col("frequency").alias("f2")), "t2")
    all_freq = all_freq.first()[0] or 0.0
    joint = F.col("cnt") / total
    pmi = F.log(joint / ((F.col("f1") / F.lit(all_freq)) * (F.col("f2") / F.lit(all_freq))))
    return one.select("t1", "t2", "cnt", F.when(joint < 1, F.greatest(F.lit(0.0), pmi / -F.log(joint))).otherwise(0.0).alias("npmi"))


def similarity_matrix(terms: list[str], scored: DataFrame) -> np.ndarray:
    """On the driver: at most ``max_terms`` squared values."""
    place = {t: i for i, t in enumerate(terms)}
    out = np.zeros((len(terms), len(terms)))
    for r in scored.collect():
        if r.t1 in place and r.t2 in place:
            out[place[r.t1], place[r.t2]] = out[place[r.t2], place[r.t1]] = r.npmi
    return out


def cluster_hierarchical(similarity: np.ndarray, n: int) -> list[list[int]]:
    """Average linkage down to n clusters, the first of equally close pairs is merged. Sums of distances are updated, not computed anew."""
    m = len(similarity)
    sums = 1 - similarity
    np.fill_diagonal(sums, 0)
    size, clusters = np.ones(m), [[i] for i in range(m)]
    mean = np.where(np.triu(np.ones((m, m), np.bool_), 1), sums, np.inf).round(12)
    low, at = (mean.min(1), mean.argmin(1)) if m else (np.zeros(0), np.zeros(0, np.int64))  # the closest later cluster of each
    for _ in range(m - max(n, 1)):
        i = int(np.argmin(low))
        j = int(at[i])
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        clusters[i] += clusters[j]
        clusters[j] = []
        fresh = (sums[i] / (size[i] * size)).round(12)
        fresh[[not c for c in clusters]] = np.inf
        mean[j], mean[:, j] = np.inf, np.inf
        mean[i, i + 1 :], mean[:i, i] = fresh[i + 1 :], fresh[:i]
        again = np.flatnonzero((at == i) | (at == j))
        again = np.append(again, [i, j])
        low[again], at[again] = mean[again].min(1), mean[again].argmin(1)
        nearer = (mean[:, i] < low) | ((mean[:, i] == low) & (i < at))
        low[nearer], at[nearer] = mean[nearer, i], i
    return [c for c in clusters if c]


def cluster_kmeans(similarity: np.ndarray, n: int) -> list[list[int]]:
    """k-means on the rows of the similarity matrix from n seeded terms."""
    np.random.seed(42)
    centre = similarity[np.random.choice(len(similarity), n, replace=False)].copy()
    for _ in range(100):
        near = ((similarity**2).sum(1)[:, None] - 2 * similarity @ centre.T + (centre**2).sum(1)).argmin(1)
        fresh = np.array([similarity[near == k].mean(0) if (near == k).any() else centre[k] for k in range(n)])
        if np.allclose(centre, fresh):
            break
        centre = fresh
    return [np.flatnonzero(near == k).tolist() for k in range(n) if (near == k).any()]


def _cluster_counts(rows: DataFrame, of: dict[str, int], config: Config) -> DataFrame:
    """(k, n): how many texts have a term of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = _term_reader(config), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, kernels.SLICE):
                for low in batch.column(0).slice(lo, kernels.SLICE).to_pylist():
                    n.update({k for t in terms(low) if (k := of.get(t)) is not None})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["k", "n"])

    some = rows.select(F.lower("text").alias("low")).where(F.col("low").isNotNull()).mapInArrow(run, "k long, n long")
    return some.groupBy("k").agg(F.sum("n").alias("n"))


@dataclass
class LearnedEmbedder:
    """Each dimension is a cluster of terms; a text activates it by its heaviest term."""

    config: Config = field(default_factory=Config)
    dimensions: list[dict] = field(default_factory=list)

    def fit(self, df: DataFrame, text: str = "text") -> LearnedEmbedder:
        config, rows = self.config, df.select(F.col(text).alias("text"))
        stats = term_statistics(rows, config)
        held = stats.orderBy(F.desc(F.round("tfidf", 9)), "term").collect()  # max_terms rows
        terms = [r.term for r in held]
        if len(terms) < 2:
            self.dimensions = []
            return self
        scored = npmi(cooccurrence(rows, terms, config), rows.sparkSession.createDataFrame([(r.term, r.frequency) for r in held], "term string, frequency long"))
        sim = similarity_matrix(terms, scored)
        wanted = config.n_dimensions if len(terms) >= config.n_dimensions else max(10, len(terms) // 2)
        n = max(1, min(wanted, len(terms) // 2))
        clusters = (cluster_hierarchical if config.clustering == "hierarchical" else cluster_kmeans)(sim, n)
        of = {terms[i]: k for k, c in enumerate(clusters) for i in c}
        df_of = {r.k: r.n for r in _cluster_counts(rows, of, config).collect()}
        tfidf, out = {r.term: r.tfidf for r in held}, []
        for k, c in enumerate(clusters):
            top = max(tfidf[terms[i]] for i in c)
            inner = sim[np.ix_(c, c)]
            out.append(
                {
                    "name": max((terms[i] for i in c), key=tfidf.get).upper().replace(" ", "_"),
                    "term_weights": {terms[i]: tfidf[terms[i]] / top if top > 0 else 1.0 for i in c},
                    "document_frequency": df_of.get(k, 0),
                    "coherence": float((inner.sum() - np.trace(inner)) / (len(c) * (len(c) - 1))) if len(c) > 1 else 1.0,
                }
            )
        if config.clustering == "hierarchical":
            out.sort(key=lambda d: -d["document_frequency"])
        self.dimensions = [{"id": i, **d} for i, d in enumerate(out)]
        return self

    @property
    def n_dimensions(self) -> int:
        return len(self.dimensions)

    def info(self, spark: SparkSession) -> DataFrame:
        rows = [(d["id"], d["name"], d["term_weights"], d["document_frequency"], d["coherence"]) for d in self.dimensions]
        return spark.createDataFrame(rows, "id int, name string, term_weights map<string,double>, document_frequency long, coherence double")

    def activations(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        """(id, idx, term, weight) of all terms that a text contains, anywhere."""
        terms = [(t, d["id"], float(w)) for d in self.dimensions for t, w in d["term_weights"].items()]
        kind = df.select(id).schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = occurrences([t for t, *_ in terms])
            for batch in batches:
                held = [sorted({i for _, i in finder(low)}) for low in batch.column(1).to_pylist()]
                flat = [i for h in held for i in h]
                own = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
                values = [pa.array([terms[i][k] for i in flat], t) for k, t in ((1, pa.int64()), (0, pa.string()), (2, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), *values], ["key", "idx", "term", "weight"])

        out = df.select(F.col(id).alias("key"), F.coalesce(F.lower(text), F.lit("")).alias("low")).mapInArrow(run, f"key {kind}, idx long, term string, weight double")
        return out.withColumnRenamed("key", id)

    def sparse(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return normalized(self.activations(df, id, text).groupBy(id, "idx").agg(F.max("weight").alias("weight")), id)

    def transform(self, df: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
        return dense(self.sparse(df, id, text), id, self.n_dimensions)

    def explain(self, df: DataFrame, id: str = "chunk_id", text: str = "text", top: int = 10) -> DataFrame:
        """(id, name, weight, rank): the ``top`` strongest dimensions of each text."""
        order = Window.partitionBy(id).orderBy(F.desc("weight"), "idx")
        out = self.sparse(df, id, text).where("weight > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = F.array(*[F.lit(d["name"]) for d in self.dimensions]) if self.dimensions else F.array(F.lit(""))
        return out.select(id, F.element_at(names, (F.col("idx") + 1).cast("int")).alias("name"), "weight", "rank")

    def save(self, spark: SparkSession, path: str) -> None:
        state = json.dumps({"config": asdict(self.config), "dimensions": self.dimensions})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LearnedEmbedder:
        state = json.loads(spark.read.text(path).first().value)
        return cls(Config(**state["config"]), state["dimensions"])
