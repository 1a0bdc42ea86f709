"""Logs to entries and traces. Input tables have ``path`` and ``text``, or one line in a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators.embed import numbered

MAX_TRACE, BATCH = 50, 10
#: What is looked for in a line of text, and the group that is taken.
PATTERNS = {
    "timestamp": (r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)", 1),
    "level": (r"\b(ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL|CRITICAL)\b", 1),
    "trace_id": (r"(?:trace[_-]?id|x-trace-id|traceid)[=:\s]+([a-zA-Z0-9\-_]{8,})", 1),
    "transaction_id": (r"(?:transaction[_-]?id|txn[_-]?id|trxid)[=:\s]+([a-zA-Z0-9\-_]{6,})", 1),
    "request_id": (r"(?:request[_-]?id|req[_-]?id)[=:\s]+([a-zA-Z0-9\-_]{6,})", 1),
    "error_code": (r"(?:error[_-]?code|err[_-]?code)[=:\s]+([A-Z0-9_\-]+)", 1),
    "imad": (r"\b(IMAD)[:\s]+([A-Z0-9]{20,})", 2),
    "omad": (r"\b(OMAD)[:\s]+([A-Z0-9]{20,})", 2),
    "message_type": (r"\b(MT\d{3})\b", 1),
    "amount": (r"(?:amount|amt)[=:\s]+(\d+(?:\.\d{2})?)", 1),
    "currency": (r"(?:currency|ccy)[=:\s]+([A-Z]{3})", 1),
}
FIELDS = ["imad", "omad", "message_type", "amount", "currency"]
#: Names that a field goes by in JSON records, the first with a value counts.
ALIASES = {
    "timestamp": ["timestamp", "time", "@timestamp", "datetime", "ts"],
    "level": ["level", "severity", "log_level", "loglevel"],
    "message": ["message", "msg", "log", "text"],
    "trace_id": ["trace_id", "traceId", "x-trace-id", "spanId"],
    "transaction_id": ["transaction_id", "transactionId", "txn_id", "txnId", "payment_id", "paymentId"],
    "request_id": ["request_id", "requestId", "req_id"],
    "error_code": ["error_code", "errorCode"],
}
SEVERE = ["ERROR", "FATAL", "CRITICAL"]
NAMES = ["timestamp", "level", "message", "trace_id", "transaction_id", "request_id", "fields", "is_error", "error_code"]


def text_columns(line: Column, level: Column) -> dict[str, Column]:
    """A line of text as the columns of an entry."""
    found = {name: _found(line, name) for name in PATTERNS}
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), found[f].alias("value")) for f in FIELDS]), lambda x: x["value"].isNotNull())
    wrong = F.when(level.isNotNull(), level.isin(SEVERE)).otherwise(F.contains(F.lower(line), F.lit("error")))
    return found | {"level": level, "message": line, "fields": F.map_from_entries(pairs), "is_error": wrong}


def text_entry(line: Column) -> Column:
    """A line of text as an entry."""
    columns = text_columns(line, F.upper(_found(line, "level")))
    return F.struct(*[columns[n].alias(n) for n in NAMES])


def _found(line: Column, name: str) -> Column:
    pattern, group = PATTERNS[name]
    return F.nullif(F.regexp_extract(line, f"(?iU){pattern}", group), F.lit(""))


def json_columns(line: Column, data: Column, level: Column) -> dict[str, Column]:
    """A JSON object, parsed to a map, as the columns of an entry."""
    found = {name: _alias(line, data, name) for name in ALIASES if name != "level"}
    return found | {"level": level, "message": F.coalesce(found["message"], line), "fields": data, "is_error": F.coalesce(level.isin(SEVERE), F.lit(False))}


def _alias(line: Column, data: Column, name: str) -> Column:
    """The first value under the names that a field goes by. Empty, zero and false values count as missing."""

    def value(name: str) -> Column:
        void = data[name].isin("0", "0.0", "false", "[]", "{}") & line.rlike(rf'"{re.escape(name)}"\s*:\s*(?:0|0\.0|false|\[\]|\{{\}})\s*[,}}]')  # not if it is a string
        return F.when((data[name] != "") & ~void, data[name])

    return F.coalesce(*map(value, ALIASES[name]))


def _entries(df: DataFrame, record: Column) -> DataFrame:
    """(path, line_number, ...) of (path, line_number, _line).

    What several columns need, a parsed record and a level, is a column of its own before them, so it is computed once; each
    column of an entry stands for itself, so those that nobody reads aren't computed.
    """
    line, data, level = F.col("_line"), F.col("_data"), F.col("_level")
    df = df.select("path", "line_number", "_line", record.alias("_record"))
    df = df.select("*", F.when(F.col("_record"), F.from_json(line, "map<string,string>")).alias("_data"))
    df = df.select("*", F.upper(F.when(F.col("_record"), _alias(line, data, "level")).otherwise(_found(line, "level"))).alias("_level"))
    own, other = json_columns(line, data, level), text_columns(line, level)
    return df.select("path", "line_number", *[F.when(F.col("_record"), own[n]).otherwise(other[n]).alias(n) for n in NAMES])


def is_object(line: Column) -> Column:
    return F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")) & F.try_parse_json(line).isNotNull()


def is_json_lines(text: Column) -> Column:
    """Whether at least half of the first five lines (and one) are JSON objects."""
    lines = F.slice(F.split(T.strip(text), "\n", -1), 1, 5)
    good = F.size(F.filter(F.transform(lines, T.strip), is_object))
    return good >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2))


def is_json_array(text: Column) -> Column:
    t = T.strip(text)
    return F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & F.try_parse_json(t).isNotNull()


def entries(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_number, timestamp, level, ...) of whole files, whichever format each has."""
    df = df.select(F.col(path).alias("path"), F.col(text).alias("_text"), T.strip(F.col(text)).alias("_t"), is_json_lines(F.col(text)).alias("_j"))
    bracket = F.startswith("_t", F.lit("[")) & F.endswith("_t", F.lit("]"))
    df = df.select("path", "_text", "_j", F.when(bracket & ~F.col("_j"), F.try_parse_json("_t")).alias("_v"))  # null but for arrays
    items = F.transform(F.variant_get("_v", "$", "array<variant>"), lambda v: F.to_json(v))
    lines = F.transform(F.split("_text", "\n", -1), T.strip)
    array = F.col("_v").isNotNull()
    df = df.select("path", array.alias("_a"), "_j", F.posexplode(F.when(array, items).otherwise(lines)).alias("_n", "_line"))
    df = df.where("_line <> ''").select("path", (F.col("_n") + 1).alias("line_number"), "_line", "_a", "_j")
    return _entries(df, F.when(F.col("_a"), F.startswith("_line", F.lit("{"))).otherwise(F.col("_j") & is_object(F.col("_line"))))  # items were parsed


def line_entries(df: DataFrame, path: str = "path", line_number: str = "line_number", line: str = "line") -> DataFrame:
    """As :func:`entries`, for one line in a row: JSON objects are records, other lines text."""
    t = T.strip(F.col(line))
    df = df.select(F.col(path).alias("path"), F.col(line_number).alias("line_number"), t.alias("_line")).where("_line <> ''")
    return _entries(df, is_object(F.col("_line")))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) pairs in order, the last of a key counts."""
    keys = F.reverse(F.transform(entries, lambda x: x["key"]))
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["key"]) == F.size(entries) - i))


def traces(df: DataFrame, limit: int = MAX_TRACE) -> DataFrame:
    """Entries by trace, else transaction, else request; others stand alone. (path, trace_id, orphan, entry_count, ...)

    A trace takes its first ``limit`` entries in file order: what is gathered for one is bounded, however
    hot its id is, and the rank that bounds it is computed by a sort that spills.
    """
    known = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("trace_id", "transaction_id", "request_id")])
    df = df.withColumn("_id", F.coalesce(known, F.concat(F.lit("orphan_"), F.col("line_number").cast("string")))).withColumn("_orphan", known.isNull())
    order = Window.partitionBy("path", "_id", "_orphan").orderBy("line_number")
    df = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    item = F.struct("line_number", F.map_entries("fields").alias("pairs"), *[n for n in NAMES if n != "fields"])
    df = df.groupBy("path", "_id", "_orphan").agg(F.sort_array(F.collect_list(item)).alias("e"))
    stamps = F.filter(F.transform("e", lambda x: x["timestamp"]), lambda t: t.isNotNull())
    codes = F.array_distinct(F.filter(F.transform("e", lambda x: x["error_code"]), lambda c: c.isNotNull()))
    wrong = F.exists("e", lambda x: x["is_error"])
    pairs = F.flatten(F.filter(F.transform("e", lambda x: x["pairs"]), lambda p: p.isNotNull()))
    return df.select(
        "path", F.col("_id").alias("trace_id"), F.col("_orphan").alias("orphan"), F.size("e").cast("long").alias("entry_count"),
        F.try_element_at(stamps, F.lit(1)).alias("start_time"), F.try_element_at(stamps, F.lit(-1)).alias("end_time"), wrong.alias("has_error"), codes.alias("error_codes"),
        F.array_join(F.transform("e", lambda x: x["message"]), "\n").alias("text"), last_wins(pairs).alias("fields"),
        F.element_at("e", 1)["line_number"].alias("line_start"), F.element_at("e", -1)["line_number"].alias("line_end"), F.element_at("e", 1)["transaction_id"].alias("transaction_id"),
        F.when(wrong, "error_trace").otherwise("transaction").alias("semantic_type"), T.chunk_id(F.lit("log"), F.col("path"), F.array_join(F.transform("e", lambda x: x["message"]), "\n"), F.col("_id")).alias("chunk_id"),
    )


def batches(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Entries in file order, ``size`` to a chunk. (path, batch, entry_count, has_error, levels, text, line_start, line_end, ...)"""
    df = numbered(df, ["line_number"], F.floor(F.col("line_number") / 100_000), ["path"], "_n")  # a large file is many blocks of lines
    df = df.withColumn("batch", F.floor(F.col("_n") / size).cast("long"))
    df = df.groupBy("path", "batch").agg(F.sort_array(F.collect_list(F.struct("line_number", "message", "level", "is_error", "timestamp"))).alias("e"))
    text, wrong = F.array_join(F.transform("e", lambda x: x["message"]), "\n"), F.exists("e", lambda x: x["is_error"])
    return df.select(
        "path", "batch", F.size("e").cast("long").alias("entry_count"), wrong.alias("has_error"),
        F.array_sort(F.array_distinct(F.filter(F.transform("e", lambda x: x["level"]), lambda v: v.isNotNull()))).alias("levels"), text.alias("text"),
        F.element_at("e", 1)["line_number"].alias("line_start"), F.element_at("e", -1)["line_number"].alias("line_end"), F.element_at("e", 1)["timestamp"].alias("timestamp"),
        F.when(wrong, "error_trace").otherwise("audit_entry").alias("semantic_type"), T.chunk_id(F.lit("log"), F.col("path"), text, (F.col("batch") * size).cast("string")).alias("chunk_id"),
    )
