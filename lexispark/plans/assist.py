"""Search results as context for a language model, and the interface to one."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T

RULE = "=" * 60
#: MIME types of images by extension.
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}


def context(results: DataFrame, min_score: float = 0.70, max_chunks: int = 20) -> DataFrame:
    """One row, ``context``: code, documents and logs among the best ``max_chunks`` results of ``min_score`` or more, by rank.

    ``results`` has rank, source_type, text, combined_score, matched_concepts and domain_matches, and path,
    procedure_name, line_start, line_end, page_number, title where these are known.
    """
    top = results.where(F.col("combined_score") >= min_score).orderBy("rank").limit(max_chunks)
    have = lambda c, kind="string": F.col(c) if c in results.columns else F.lit(None).cast(kind)
    named = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    score = F.concat(F.lit("Score: "), F.format_string("%.3f", "combined_score"))
    concepts = F.when(F.size("matched_concepts") > 0, named("Concepts", F.array_join(F.slice("matched_concepts", 1, 5), ", ")))
    caps = F.slice(F.array_distinct(F.flatten(F.transform("domain_matches", lambda m: m["capabilities"]))), 1, 5)
    lines = F.concat(have("line_start", "int").cast("string"), F.coalesce(F.concat(F.lit("-"), have("line_end", "int").cast("string")), F.lit("")))
    head = lambda label: F.concat(F.lit(f"\n--- {label}: "), F.coalesce(have("path"), F.lit("unknown")), F.lit(" ---"))
    body = T.strip(F.col("text"))
    code = [head("File"), named("Procedure", have("procedure_name")), named("Lines", lines), score, concepts, F.when(F.size(caps) > 0, named("Capabilities", F.array_join(caps, ", "))), F.lit("\n```"), body, F.lit("```")]
    document = [head("Document"), named("Page", have("page_number", "int").cast("string")), named("Section", F.nullif(have("title"), F.lit(""))), score, concepts, F.lit(""), body]
    log = [head("Log"), score, F.lit(""), body]
    kind = F.col("source_type")
    said = F.when(kind == "code", _lines(code)).when(kind == "document", _lines(document)).when(kind == "log", _lines(log))
    one = top.agg(*[F.array_sort(F.collect_list(F.when(kind == k, F.struct("rank", said.alias("said"))))).alias(k) for k in ("code", "document", "log")], F.count("*").alias("n"))
    block = lambda k, title, lead: F.when(F.size(k) > 0, F.concat_ws("\n", F.lit(f"{lead}{RULE}\n{title}\n{RULE}"), F.array_join(F.transform(k, lambda x: x["said"]), "\n")))
    whole = F.concat_ws("\n", block("code", "CODE ARTIFACTS", ""), block("document", "DOCUMENTATION ARTIFACTS", "\n"), block("log", "LOG ARTIFACTS", "\n"))
    return one.select(F.when(F.col("n") == 0, F.lit(f"No results found with score >= {min_score:.2f}")).otherwise(whole).alias("context"))


def _lines(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *parts)


@dataclass
class Item:
    """Text or an image that goes to a model."""

    text: str | None = None
    image: bytes | None = None
    media_type: str | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def encoded(self) -> str | None:
        return None if self.image is None else base64.b64encode(self.image).decode()

    @classmethod
    def of_image(cls, path: str, image: bytes) -> Item:
        suffix = "." + path.rsplit(".", 1)[-1].lower()
        if suffix not in IMAGES:
            raise ValueError(f"not an image: {path}")
        return cls(image=image, media_type=IMAGES[suffix], metadata={"source_file": path})


class Model(Protocol):
    def ask(self, system: str, items: list[Item]) -> str: ...


class Echo:
    """A model without a network: says what it got."""

    def ask(self, system: str, items: list[Item]) -> str:
        texts = [i.text or "" for i in items if i.image is None]
        return f"{system}\n{len(texts)} texts ({sum(map(len, texts))} characters), {len(items) - len(texts)} images"


MODELS = {"stub": Echo}


def create_model(name: str = "stub") -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; register it in MODELS")
    return MODELS[name]()


class Assistant:
    """Tasks for a model over results; code tasks take chunks of code only."""

    def __init__(self, model: Model):
        self.model = model

    def _ask(self, task: str, *texts: str) -> str:
        return self.model.ask(task, [Item(text=t) for t in texts])

    def analyze(self, query: str, results: DataFrame, min_score: float = 0.70, max_chunks: int = 20) -> str:
        return self._ask("Answer the query from the artifacts.", query, context(results, min_score, max_chunks).first()["context"])

    def enhance_query(self, query: str) -> str:
        return self._ask("Rephrase the query with terms of the domain.", query)

    def summarize(self, query: str, results: DataFrame, max_chunks: int = 5) -> str:
        return self._ask("Summarise what the artifacts say about the query.", query, context(results, 0.0, max_chunks).first()["context"])

    def explain_code(self, source_type: str, text: str) -> str:
        return self._ask("Explain the code.", text) if source_type == "code" else "Not code."

    def extract_rules(self, source_type: str, text: str) -> str:
        return self._ask("List the business rules in the code.", text) if source_type == "code" else ""
