"""TAL source to procedures, by the lines that declare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T

#: A line that declares a procedure, its type and its name.
PROC = r"(?i)^\s*(?:(INT(?:\([^)]*\))?|REAL(?:\([^)]*\))?|STRING|FIXED|UNSIGNED(?:\([^)]*\))?)\s+)?PROC\s+([a-zA-Z_][a-zA-Z0-9_\^]*)"
SIZE, OVERLAP = 1500, 150


def procedures(text: Column) -> Column:
    """array<struct<name,return_type,line_start,line_end,text>>: from each declaration to the next or the end; what stands before the first is lost."""
    # a lambda's variable is computed once, where an expression inside the lambda would split the file anew for each procedure
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.element_at(F.transform(F.array(_starts(lines)), lambda starts: _cut(lines, starts)), 1)), 1)


def _starts(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"))), lambda s: s["line"].rlike(PROC))


def _cut(lines: Column, starts: Column) -> Column:
    ends = F.concat(F.slice(F.transform(starts, lambda s: s["at"] - 1), 2, F.size(lines)), F.array(F.size(lines)))
    return F.when(F.size(starts) == 0, F.array().cast("array<struct<name:string,return_type:string,line_start:int,line_end:int,text:string>>")).otherwise(
        F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(
                F.regexp_extract(s["line"], PROC, 2).alias("name"), F.nullif(F.regexp_extract(s["line"], PROC, 1), F.lit("")).alias("return_type"),
                s["at"].alias("line_start"), e.alias("line_end"), F.array_join(F.slice(lines, s["at"], e - s["at"] + 1), "\n").alias("text"),
            ),
        )
    )


def chunks(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, procedure_name, return_type, line_start, line_end, text, semantic_type, keywords, chunk_id); files without procedures in overlapping chunks."""
    df = df.select(F.col(path).alias("path"), F.col(text).alias("_text"))
    found = procedures(F.col("_text"))
    none = lambda t: F.lit(None).cast(t)
    rest = F.transform(
        T.chunk_text(F.col("_text"), SIZE, OVERLAP),
        lambda c, i: F.struct(i.cast("string").alias("extra"), none("string").alias("name"), none("string").alias("return_type"), none("int").alias("line_start"), none("int").alias("line_end"), c.alias("text"), F.lit("unknown").alias("kind")),
    )
    own = F.transform(found, lambda p: F.struct(p["name"].alias("extra"), p["name"].alias("name"), p["return_type"].alias("return_type"), p["line_start"].alias("line_start"), p["line_end"].alias("line_end"), p["text"].alias("text"), F.lit("procedure").alias("kind")))
    df = df.select("path", F.explode(F.when(F.size(own) > 0, own).otherwise(rest)).alias("c"))
    return df.select(
        "path", F.col("c.name").alias("procedure_name"), "c.return_type", "c.line_start", "c.line_end", "c.text", F.col("c.kind").alias("semantic_type"),
        T.extract_tal_keywords(F.col("c.text")).alias("keywords"), T.chunk_id(F.lit("code"), F.col("path"), F.col("c.text"), F.col("c.extra")).alias("chunk_id"),
    )
