"""Documents to sections: plain text, Markdown, HTML, DOCX and PDF. Input tables have ``path`` and ``text`` or ``content``."""

from __future__ import annotations

import importlib
import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as T

SECTION = "struct<title:string,content:string,page_number:int,section_level:int,element_type:string>"
SHORTEST, LONGEST, SIZE, OVERLAP = 20, 1500, 1200, 100


def _section(title: Column, content: Column, level: Column | None = None, kind: str = "paragraph") -> Column:
    return F.struct(
        title.alias("title"), content.alias("content"), F.lit(None).cast("int").alias("page_number"),
        (F.lit(0) if level is None else level).cast("int").alias("section_level"), F.lit(kind).alias("element_type"),
    )


def text_sections(text: Column, ascii: bool = False) -> Column:
    """Paragraphs under the heading before them; a heading without paragraphs is lost. A fold over the paragraphs of one row."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n+", -1), T.strip), lambda p: p != "")
    marked = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), (T.heads(p, ascii) & ~F.contains(p, F.lit("\n"))).alias("head")))
    empty = F.array().cast(f"array<{SECTION}>")
    state = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body"), empty.alias("out"))
    flush = lambda a: F.when(a["body"].isNotNull(), F.concat(a["out"], F.array(_section(a["title"], a["body"])))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        return F.when(x["head"], F.struct(x["p"].alias("title"), F.lit(None).cast("string").alias("body"), flush(a).alias("out"))).otherwise(
            F.struct(a["title"].alias("title"), F.concat_ws("\n\n", a["body"], x["p"]).alias("body"), a["out"].alias("out"))
        )

    return F.aggregate(marked, state, step, flush)


def markdown_sections(text: Column) -> Column:
    """What stands under each header; text before the first and headers with nothing under them are lost. Without headers the whole text."""
    plain = F.translate(text, "\x01\x02\x03", "   ")
    marked = F.regexp_replace(plain, r"(?dmU)^(#{1,6})\s+(.+)$", "\x01$1\x02$2\x03")
    pieces = F.slice(F.split(marked, "\x01", -1), 2, F.length(text) + 1)
    found = F.transform(
        pieces,
        lambda p: _section(F.regexp_extract(p, "(?s)\x02(.*?)\x03", 1), T.strip(F.regexp_extract(p, "(?s)\x03(.*)$", 1)), F.instr(p, "\x02") - 2, "section"),
    )
    whole = F.array(_section(F.lit(None).cast("string"), text))
    return F.when(F.size(pieces) == 0, whole).otherwise(F.filter(found, lambda s: s["content"] != ""))


class _Page(HTMLParser):
    """Headings with the text of the elements that follow them under the same parent."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    DROP = {"script", "style", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "kids": []}
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": []}
        self.open[-1]["kids"].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1]["kids"].append({"tag": tag, "kids": []})

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1]["kids"].append(data)

    def texts(self, node) -> Iterator[str]:
        stack = [node]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x["tag"] not in self.DROP:
                stack.extend(reversed(x["kids"]))

    def sections(self) -> list[dict]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            kids = [k for k in node["kids"] if not isinstance(k, str) and k["tag"] not in self.DROP]
            for i, k in enumerate(kids):
                if re.fullmatch("h[1-6]", k["tag"]):
                    parts = []
                    for s in kids[i + 1 :]:
                        if re.fullmatch("h[1-6]", s["tag"]):
                            break
                        parts.append("".join(self.texts(s)))
                    if parts:
                        out.append({"title": "".join(self.texts(k)), "content": "\n".join(parts), "page_number": None, "section_level": int(k["tag"][1]) - 1, "element_type": "section"})
            todo.extend(reversed(kids))
        return out or [{"title": None, "content": "\n".join(self.texts(self.root)), "page_number": None, "section_level": 0, "element_type": "paragraph"}]


def html_sections(html: Column | str) -> Column:
    """Headings of HTML with what follows them; scripts, styles, navigation, headers and footers are dropped."""

    def one(text: str | None) -> list[dict]:
        page = _Page()
        page.feed(text or "")
        page.close()
        return page.sections()

    @F.pandas_udf(f"array<{SECTION}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    return run(html)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes) -> list[dict]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    words = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t"))
    section = lambda title, content, level, kind: {"title": title, "content": content, "page_number": None, "section_level": level, "element_type": kind}
    out, title, level, held, tables = [], None, 0, [], []
    for x in body:
        if x.tag == f"{_W}p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(f"{_W}val", "")
            said = words(x).strip()
            if not said:
                continue
            if name.lower().startswith("heading"):
                if held:
                    out.append(section(title, "\n".join(held), level, "section"))
                title, held = said, []
                level = int(name[-1]) - 1 if name[-1:].isdigit() else 0
            else:
                held.append(said)
        elif x.tag == f"{_W}tbl":
            rows = [" | ".join(words(c).strip() for c in r.iter(f"{_W}tc")) for r in x.iter(f"{_W}tr")]
            tables.append(section(title, "\n".join(rows), level, "table"))
    if held:
        out.append(section(title, "\n".join(held), level, "section" if title else "paragraph"))
    return out + tables


def pdf_library() -> str | None:
    """The PDF library that is installed, the first of those that can be used."""
    return next((name for name in ("pdfplumber", "fitz", "pypdf") if importlib.util.find_spec(name)), None)


def _pdf(content: bytes) -> list[dict]:
    """Sections page by page, with whichever PDF library is installed: paragraphs under the heading before them and tables, blocks of text, or whole pages."""
    name = pdf_library()
    if name is None:
        raise RuntimeError("no PDF library is installed")
    library, out = importlib.import_module(name), []

    def add(title: str | None, said: str, page: int, kind: str = "paragraph") -> None:
        if said.strip():
            out.append({"title": title, "content": said.strip(), "page_number": page, "section_level": 0, "element_type": kind})

    if name == "pdfplumber":
        for i, page in enumerate(library.open(io.BytesIO(content)).pages, 1):
            title, held = None, []
            for line in (page.extract_text() or "").split("\n"):
                if _is_heading(line.strip()):
                    add(title, "\n".join(held), i)
                    title, held = line.strip(), []
                else:
                    held.append(line)
            add(title, "\n".join(held), i)
            for rows in page.extract_tables() or []:
                add(title, "\n".join(" | ".join(c or "" for c in row) for row in rows if row), i, "table")
    elif name == "fitz":
        for i, page in enumerate(library.open(stream=content, filetype="pdf"), 1):
            for block in page.get_text("blocks"):
                if len(block) < 7 or block[6] == 0:  # text, no image
                    add(None, block[4], i)
    else:
        for i, page in enumerate(library.PdfReader(io.BytesIO(content)).pages, 1):
            add(None, page.extract_text() or "", i)
    return out


def _is_heading(t: str) -> bool:
    """As ``text.heads``, outside of Spark."""
    if not 0 < len(t) < 100 or t[-1] in ".,;:":
        return False
    return t.isupper() or bool(re.match(r"\d+\.?\s+\w", t) or re.fullmatch(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", t) or (len(t) < 80 and re.fullmatch(r"[A-Z0-9\s\-:]+", t)))


def _binary_sections(parse, content: Column | str) -> Column:
    @F.pandas_udf(f"struct<sections:array<{SECTION}>,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch:
                try:
                    rows.append((parse(x), None))
                except Exception as e:  # a file that can't be read is reported with its row
                    rows.append(([], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["sections", "error"])

    return run(content)


def docx_sections(content: Column | str) -> Column:
    return _binary_sections(_docx, content)


def pdf_sections(content: Column | str) -> Column:
    return _binary_sections(_pdf, content)


def section_chunks(df: DataFrame, sections: str = "sections", path: str = "path") -> DataFrame:
    """A row for each chunk of the sections: path, text, title, page_number, section_level, element_type, semantic_type, chunk_index, chunk_id.

    Sections under SHORTEST characters are left out; those over LONGEST are split into overlapping chunks.
    """
    rest = [c for c in df.columns if c != sections]
    df = df.select(*rest, F.posexplode(sections).alias("_i", "_s")).withColumn("_content", T.strip(F.col("_s.content"))).where(F.length("_content") >= SHORTEST)
    long = F.length("_content") > LONGEST
    df = df.withColumn("_pieces", F.when(long, T.chunk_text(F.col("_content"), SIZE, OVERLAP)).otherwise(F.array("_content"))).withColumn("_long", long)
    df = df.select(*rest, "_i", "_s", "_long", F.posexplode("_pieces").alias("_j", "text"))
    index = F.when(F.col("_long"), F.concat_ws("_", F.col("_i").cast("string"), F.col("_j").cast("string"))).otherwise(F.col("_i").cast("string"))
    kind, titled = F.col("_s.element_type"), F.coalesce(F.col("_s.title"), F.lit("")) != ""
    semantic = F.when(kind.isin("table", "heading", "list"), kind).when(titled, "section").otherwise("paragraph")
    df = df.select(
        *rest, "text", F.col("_s.title").alias("title"), F.col("_s.page_number").alias("page_number"), F.col("_s.section_level").alias("section_level"),
        kind.alias("element_type"), semantic.alias("semantic_type"), index.alias("chunk_index"),
    )
    return df.withColumn("chunk_id", T.chunk_id(F.lit("document"), F.col(path), F.col("text"), F.col("chunk_index")))
