"""Files to chunks: one scan of a directory, each file parsed by the kind that its name tells."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators.match import match_keywords, match_text
from lexispark.sources import documents, logs, tal
from lexispark.sources.vocabulary import Vocabulary

#: Extensions of each kind of source; of several kinds the first counts.
EXTENSIONS = {"code": [".tal", ".tacl", ".txt"], "document": [".pdf", ".docx", ".doc", ".txt", ".md", ".html"], "log": [".log", ".json", ".jsonl", ".txt"]}
CHUNK = ["chunk_id", "path", "source_type", "semantic_type", "text", "embedding_text", "domain_matches", "title", "procedure_name", "page_number", "line_start", "line_end", "timestamp", "trace_id", "transaction_id", "source_ref", "metadata"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def source_type(path: Column) -> Column:
    """The kind of source that a name tells: code before document before log; null for others."""
    out = F.lit(None).cast("string")
    for kind in reversed(EXTENSIONS):
        out = F.when(extension(path).isin(EXTENSIONS[kind]), kind).otherwise(out)
    return out


def read(spark: SparkSession, path: str, recursive: bool = True, extensions: list[str] | None = None, exclude: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """(path, source_type, content) of the files under a directory, or of one file. ``exclude`` has shell patterns on paths; ``kind`` overrides what names tell."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.select("path", F.lit(kind).alias("source_type") if kind else source_type(F.col("path")).alias("source_type"), "content")
    if extensions:
        df = df.where(extension(F.col("path")).isin([e.lower() for e in extensions]))
    for pattern in exclude or []:
        df = df.where(~F.col("path").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
    return df.where("source_type IS NOT NULL")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, what isn't valid replaced."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def _annotated(df: DataFrame, vocabulary: Vocabulary, kind: str) -> DataFrame:
    """Rows of a parser as chunks, with domain matches, embedding text and all columns of ``CHUNK``."""
    df = match_text(df, vocabulary)
    if kind == "code":  # keywords that the text itself doesn't match
        df = match_keywords(df, vocabulary)
        caps = F.map_from_arrays(F.array(*[F.lit(e.canonical_term) for e in {e.canonical_term: e for e in vocabulary.entries}.values()]), F.array(*[F.struct(F.array(*map(F.lit, e.capabilities)).cast("array<string>").alias("c"), F.lit(e.category).alias("k")) for e in {e.canonical_term: e for e in vocabulary.entries}.values()]))
        seen = F.transform("domain_matches", lambda m: m["canonical_term"])
        names = F.transform("keyword_matches", lambda m: m["canonical_term"])
        extra = F.filter("keyword_matches", lambda m, i: ~F.array_contains(seen, m["canonical_term"]) & (F.array_position(names, m["canonical_term"]) == i + 1))
        more = F.transform(
            extra,
            lambda m: F.struct(
                m["matched_term"].alias("matched_term"), m["canonical_term"].alias("canonical_term"), caps[m["canonical_term"]]["c"].alias("capabilities"), caps[m["canonical_term"]]["k"].alias("category"),
                F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("context"),
            ),
        )
        df = df.withColumn("domain_matches", F.concat("domain_matches", more)).drop("keyword_matches")
    types = {"page_number": "int", "line_start": "int", "line_end": "int", "metadata": "map<string,string>"}
    for name in CHUNK:
        if name not in df.columns and name not in ("embedding_text", "source_ref", "source_type"):
            df = df.withColumn(name, F.lit(None).cast(types.get(name, "string")))
    ref = T.source_ref(F.col("path"), F.col("line_start"), F.col("line_end"), F.col("procedure_name"), F.col("page_number"), F.col("timestamp"))
    said = T.embedding_text(F.col("text"), F.col("semantic_type"), F.col("domain_matches"), F.col("procedure_name"), F.nullif(F.col("title"), F.lit("")))
    return df.withColumns({"source_ref": ref, "embedding_text": said, "source_type": F.lit(kind)}).select(*CHUNK)


def _map(**values: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def code_chunks(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """From (path, text)."""
    out = tal.chunks(df).withColumn("metadata", _map(language=F.lit("TAL"), return_type=F.col("return_type")))
    return _annotated(out, vocabulary, "code")


def document_chunks(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """From (path, sections)."""
    out = documents.section_chunks(df.select("path", "sections"))
    out = out.withColumn("metadata", _map(element_type=F.col("element_type"), section_level=F.col("section_level"), section_title=F.nullif(F.col("title"), F.lit(""))))
    return _annotated(out, vocabulary, "document")


def log_chunks(df: DataFrame, vocabulary: Vocabulary, group_by_trace: bool = True, max_trace: int = logs.MAX_TRACE) -> DataFrame:
    """From (path, text)."""
    rows = logs.entries(df)
    if group_by_trace:
        out = logs.traces(rows, max_trace)
        codes = F.when(F.size("error_codes") > 0, F.array_join("error_codes", ","))
        out = out.withColumns({"metadata": F.map_concat(_map(entry_count=F.col("entry_count"), has_error=F.col("has_error"), error_codes=codes), _map(fields=F.when(F.size("fields") > 0, F.to_json("fields")))), "timestamp": F.col("start_time"), "trace_id": F.when(~F.col("orphan"), F.col("trace_id"))})
    else:
        out = logs.batches(rows).withColumn("metadata", _map(entry_count=F.col("entry_count"), has_error=F.col("has_error"), levels=F.array_join("levels", ",")))
    return _annotated(out.withColumns({c: F.col(c).cast("int") for c in ("line_start", "line_end")}), vocabulary, "log")


def sections(df: DataFrame) -> DataFrame:
    """(path, sections, error) of documents by their format: PDF, DOCX, Markdown, HTML, else plain text. A file that can't be read has an error."""
    ext, text = extension(F.col("path")), decoded(F.col("content"))
    out = []
    for kinds, found in ((None, None), ([".pdf"], documents.pdf_sections), ([".docx"], documents.docx_sections)):
        if kinds:
            some = df.where(ext.isin(kinds)).withColumn("_r", found("content")).select("path", "_r.sections", "_r.error")
        else:
            some = df.where(~ext.isin(".pdf", ".docx")).withColumn("_t", text)
            html = some.where(ext.isin(".html", ".htm")).withColumn("sections", documents.html_sections("_t"))
            rest = some.where(~ext.isin(".html", ".htm")).withColumn("sections", F.when(ext == ".md", documents.markdown_sections(F.col("_t"))).otherwise(documents.text_sections(F.col("_t"))))
            some = html.unionByName(rest).select("path", "sections", F.lit(None).cast("string").alias("error"))
        out.append(some)
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Parsers of further kinds of source: a function from (path, content) and a vocabulary to rows with some of the columns of ``CHUNK``.
PARSERS: dict[str, Callable[[DataFrame, Vocabulary], DataFrame]] = {}


def register_parser(kind: str, extensions: list[str], parse: Callable[[DataFrame, Vocabulary], DataFrame]) -> None:
    """A parser of one's own for files with these extensions, which no longer belong to any other kind."""
    extensions = [e.lower() for e in extensions]
    for own in EXTENSIONS.values():
        own[:] = [e for e in own if e not in extensions]
    EXTENSIONS[kind] = extensions
    PARSERS[kind] = parse


def parser_info() -> list[dict]:
    """Kinds of source with their extensions, whether a parser of one's own reads them, and which PDF library is there."""
    return [{"kind": k, "extensions": list(e), "custom": k in PARSERS, "pdf_library": documents.pdf_library() if k == "document" else None} for k, e in EXTENSIONS.items()]


def corpus_texts(files: DataFrame) -> DataFrame:
    """(path, source_type, text) to learn from: what each kind of file says, without markup and without binary noise."""
    found = sections(files.where("source_type = 'document'")).where("error IS NULL")
    out = found.select("path", F.lit("document").alias("source_type"), F.array_join(F.transform("sections", lambda s: F.concat_ws("\n", F.nullif(s["title"], F.lit("")), s["content"])), "\n\n").alias("text"))
    plain = files.where("source_type <> 'document'").select("path", "source_type", decoded(F.col("content")).alias("text"))
    said = logs.entries(plain.where("source_type = 'log'").select("path", "text")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "message"))).alias("m"))
    said = said.select("path", F.lit("log").alias("source_type"), F.array_join(F.transform("m", lambda x: x["message"]), "\n").alias("text"))
    return out.unionByName(plain.where("source_type <> 'log'")).unionByName(said).where("text <> ''")


def chunks(files: DataFrame, vocabulary: Vocabulary, **log_options) -> tuple[DataFrame, DataFrame]:
    """Chunks of (path, source_type, content), and (path, error) of files that couldn't be read."""
    of = lambda kind: files.where(F.col("source_type") == kind)
    plain = lambda kind: of(kind).select("path", decoded(F.col("content")).alias("text"))
    found = sections(of("document"))
    out = code_chunks(plain("code"), vocabulary).unionByName(document_chunks(found, vocabulary)).unionByName(log_chunks(plain("log"), vocabulary, **log_options))
    for kind, parse in PARSERS.items():
        out = out.unionByName(_annotated(parse(of(kind).select("path", "content"), vocabulary), vocabulary, kind))
    return out, found.where("error IS NOT NULL").select("path", "error")
