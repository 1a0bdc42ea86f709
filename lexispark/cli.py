"""python -m lexispark.cli index|search|xref|capability|capabilities|stats|shell|learn ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lexispark.operators.learned import Config, LearnedEmbedder
from lexispark.plans.assist import Assistant, create_model
from lexispark.plans.pipeline import Pipeline
from lexispark.sources import files
from lexispark.sources.vocabulary import Vocabulary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexispark")
    verbs = top.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("index")
    p.add_argument("directory")
    p.add_argument("--vocabulary", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--embedder", default="hash")
    p.add_argument("--exclude", action="append")
    p.add_argument("--extension", action="append")
    p.add_argument("--type", choices=["code", "document", "log"])
    for name in ("search", "xref", "capability", "capabilities", "stats", "shell"):
        p = verbs.add_parser(name)
        p.add_argument("--index", required=True)
        if name in ("search", "xref", "capability"):
            p.add_argument("query")
            p.add_argument("--top", type=int, default=10)
        if name == "search":
            p.add_argument("--type", action="append")
            p.add_argument("--capability", action="append")
            p.add_argument("--min-score", type=float, default=0.0)
            p.add_argument("--analyze", action="store_true")
        if name == "xref":
            p.add_argument("--from-type", default="code")
            p.add_argument("--to-type", action="append", default=None)
    p = verbs.add_parser("learn")
    p.add_argument("directory")
    p.add_argument("--out", required=True)
    p.add_argument("--dimensions", type=int, default=80)
    p.add_argument("--clustering", choices=["hierarchical", "kmeans"], default="hierarchical")
    return top


HELP = ":code Q, :doc Q, :cap C, :caps, :analyze Q, :top N, :minscore X, :verbose, :stats, :help, :quit; anything else is a query"


def shell(pipeline: Pipeline, lines) -> None:
    """Commands and queries, one a line, until ``:quit`` or the end."""
    top, least, verbose = 10, 0.0, False

    def show(found) -> None:
        columns = ["rank", "combined_score", "retrieval_method", "source_ref", "matched_concepts", *(["text"] if verbose else [])]
        found.where(found.combined_score >= least).orderBy("rank").select(*columns).show(top, truncate=not verbose)

    for line in lines:
        verb, _, rest = line.strip().partition(" ")
        if verb == ":quit":
            return
        elif verb == ":top":
            top = int(rest)
        elif verb == ":minscore":
            least = float(rest)
        elif verb == ":verbose":
            verbose = not verbose
        elif verb == ":code":
            show(pipeline.related_code(rest, top))
        elif verb == ":doc":
            show(pipeline.documentation(rest, top))
        elif verb == ":cap":
            pipeline.by_capability(rest, top).show(top, truncate=False)
        elif verb == ":caps":
            pipeline.capability_counts().show(1000, truncate=False)
        elif verb == ":stats":
            pipeline.statistics().show(1000, truncate=False)
        elif verb == ":analyze":
            print(Assistant(create_model()).analyze(rest, pipeline.search(rest, top), least))
        elif verb.startswith(":"):
            print(HELP)
        elif verb:
            show(pipeline.search(line.strip(), top))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lexispark").getOrCreate()
    if a.verb == "index":
        pipeline = Pipeline(spark, Vocabulary.load(spark, a.vocabulary), a.index, a.embedder)
        pipeline.index_directory(a.directory, extensions=a.extension, exclude=a.exclude, kind=a.type).show(truncate=False)
        return
    if a.verb == "learn":
        texts = files.corpus_texts(files.read(spark, a.directory)).select("text")
        learned = LearnedEmbedder(Config(n_dimensions=a.dimensions, clustering=a.clustering)).fit(texts)
        learned.save(spark, a.out)
        learned.info(spark).select("id", "name", "document_frequency", "coherence").show(20, truncate=False)
        return
    pipeline = Pipeline.load(spark, a.index)
    if a.verb == "search":
        found = pipeline.search(a.query, a.top, a.type, a.capability)
        found = found.where(found.combined_score >= a.min_score)
        if a.analyze:
            print(Assistant(create_model()).analyze(a.query, found, a.min_score))
        else:
            found.orderBy("rank").select("rank", "combined_score", "retrieval_method", "source_ref", "matched_concepts").show(a.top, truncate=False)
    elif a.verb == "xref":
        pipeline.search_cross_reference(a.query, a.from_type, a.to_type or ["document", "log"], a.top).show(100, truncate=False)
    elif a.verb == "capability":
        pipeline.by_capability(a.query, a.top).show(a.top, truncate=False)
    elif a.verb == "shell":
        shell(pipeline, sys.stdin)
    elif a.verb == "capabilities":
        pipeline.capability_counts().show(1000, truncate=False)
    else:
        pipeline.statistics().show(1000, truncate=False)


if __name__ == "__main__":
    main()
