import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark import cli
from lexispark.plans import assist
from lexispark.plans.pipeline import Pipeline
from lexispark.plans.queries import VOCABULARY
from lexispark.sources import documents, files, logs, tal
from lexispark.streaming import logs as stream

TAL = "! preamble\nINT PROC first^one(a);\nBEGIN\n CALL helper^it;\n x := $LEN(a);\nEND;\n\n  proc SECOND_TWO;\n \"wire\" MAXVALUE\nEND;\nSTRING PROC third;\nEND;"


def rows(spark, text, sections):
    df = spark.createDataFrame([(text,)], "text string")
    return [(s.title, s.content, s.section_level) for s in df.select(sections(F.col("text")).alias("s")).first().s]


def test_text_sections(spark):
    text = "intro para\n\nOVERVIEW\n\nSecond Heading\n\nbody one\nline\n\n  body two  \n\n\nLAST"
    assert rows(spark, text, documents.text_sections) == [(None, "intro para", 0), ("Second Heading", "body one\nline\n\nbody two", 0)]
    assert rows(spark, "", documents.text_sections) == []


def test_markdown(spark):
    text = "lost\n# A\nx\n\n### B c\n## C\n y \n#D\n# E"
    assert rows(spark, text, documents.markdown_sections) == [("A", "x", 0), ("C", "y \n#D", 1)]
    assert rows(spark, "no headers", documents.markdown_sections) == [(None, "no headers", 0)]


def test_html(spark):
    html = "<html><head><title>t</title></head><body><nav>n</nav><h1>A <b>b</b></h1><p>one <i>two</i></p><script>x<y</script><p>three</p><h2>B</h2><div><h3>C</h3><p>four</p></div><h2>D</h2></body>"
    assert rows(spark, html, documents.html_sections) == [("Ab", "onetwo\nthree", 0), ("B", "Cfour", 1), ("C", "four", 2)]
    assert rows(spark, "<p>only <b>text</b></p>", documents.html_sections) == [(None, "only\ntext", 0)]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=%s/></w:pPr>" % json.dumps(s) if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_binary(spark):
    df = spark.createDataFrame([("a.docx", bytearray(docx([("Heading2", "T"), ("", "body")]))), ("b.docx", bytearray(b"no zip")), ("c.pdf", bytearray(b"%PDF"))], "path string, content binary")
    got = {r.path: r for r in files.sections(df).collect()}
    assert [(s.title, s.content, s.element_type) for s in got["a.docx"].sections] == [("T", "body", "section"), ("T", "a | b", "table")]
    assert "BadZipFile" in got["b.docx"].error and got["c.pdf"].error


def test_tal(spark):
    got = tal.chunks(spark.createDataFrame([("a.tal", TAL), ("b.tal", "x := 1;")], "path string, text string")).collect()
    assert [(r.procedure_name, r.return_type, r.line_start, r.line_end) for r in got if r.path == "a.tal"] == [("first^one", "INT", 2, 7), ("SECOND_TWO", None, 8, 10), ("third", "STRING", 11, 12)]
    assert got[1].text == "  proc SECOND_TWO;\n \"wire\" MAXVALUE\nEND;" and got[1]["keywords"] == ["MAXVALUE", "SECOND_TWO", "wire"]
    assert [r.semantic_type for r in got if r.path == "b.tal"] == ["unknown"]


def test_tal_of_a_large_file(spark):
    """A file is split once, not once for each of its procedures."""
    n = 20_000
    text = "! preamble\n" + "\n".join(f"PROC p^{i};\nBEGIN\n CALL q;\nEND;" for i in range(n))
    df = spark.createDataFrame([("a.tal", text)], "path string, text string")
    began = time.perf_counter()
    got = tal.chunks(df).agg(F.count("*"), F.max("line_end"), F.sum(F.length("text"))).first()
    assert tuple(got) == (n, 4 * n + 1, len(text) - len("! preamble\n") - (n - 1)) and time.perf_counter() - began < 60


LINES = [
    '{"timestamp": "2024-01-01T00:00:00", "level": "error", "trace_id": "t1", "message": "a", "error_code": "E1", "n": 0}',
    "not json trace_id=abcdefgh9 ERROR error_code=E2 amount: 12.50 MT103",
    '{"time": "t", "severity": "", "log_level": "warn", "spanId": "t1", "text": "b", "error_code": 0}',
    "",
    '{"level": "info", "txnId": "x9", "msg": ""}',
    "plain text with errors inside",
]


def test_records_are_parsed_once(spark):
    """What an entry takes from a record doesn't parse it anew, and columns that nobody reads aren't computed."""
    df = spark.createDataFrame([("a", "\n".join(LINES[:1] * 3))], "path string, text string")
    plan = logs.entries(df).select("line_number", "message", "is_error", "trace_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "omad" not in plan.lower()
    assert logs.line_entries(df.select("path", F.lit(1).alias("line_number"), F.col("text").alias("line")))._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_json_lines(spark):
    df = spark.createDataFrame([("a.jsonl", "\n".join(LINES))], "path string, text string")
    got = logs.entries(df).orderBy("line_number").collect()
    assert [(r.line_number, r.level, r.trace_id, r.is_error, r.error_code) for r in got] == [
        (1, "ERROR", "t1", True, "E1"), (2, "ERROR", "abcdefgh9", True, "E2"), (3, "WARN", "t1", False, None), (5, "INFO", None, False, None), (6, None, None, True, None),
    ]
    assert got[1].fields == {"amount": "12.50", "message_type": "MT103"} and got[2].message == "b" and got[3].message == LINES[4]
    traces = {r.trace_id: r for r in logs.traces(logs.entries(df)).collect()}
    assert set(traces) == {"t1", "abcdefgh9", "x9", "orphan_6"}
    assert traces["t1"].text == "a\nb" and traces["t1"].error_codes == ["E1"] and traces["t1"].has_error and traces["t1"].fields["error_code"] == "0"
    assert (traces["t1"].line_start, traces["t1"].line_end, traces["t1"].end_time) == (1, 3, "t")
    assert {r.trace_id: r.entry_count for r in logs.traces(logs.entries(df), limit=1).collect()}["t1"] == 1


def test_json_array(spark):
    df = spark.createDataFrame([("a.json", json.dumps([{"level": "fatal", "msg": "m", "requestId": "r1"}, {"msg": "n"}]))], "path string, text string")
    got = logs.entries(df).orderBy("line_number").collect()
    assert [(r.line_number, r.level, r.message, r.request_id, r.is_error) for r in got] == [(1, "FATAL", "m", "r1", True), (2, None, "n", None, False)]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.tal").write_text(TAL.replace("CALL helper^it", "CALL wire"))
    (d / "sub" / "b.md").write_text("# The And\nThe and settlement of the nation is explained in this section, with license.\n")
    (d / "c.log").write_text("\n".join(LINES) + "\n2024-01-01 10:00:00 INFO txn_id=abc123 wire sent and mail\n")
    (d / "skip.md").write_text("# x\nlong enough text for a section\n")
    (d / "z.bin").write_text("?")
    return d


def test_pipeline(spark, folder, tmp_path, capsys):
    p = Pipeline(spark, VOCABULARY, str(tmp_path / "index"), "hash", n_features=64)
    done = {r.path.rsplit("/", 1)[-1]: r.chunks for r in p.index_directory(str(folder), exclude=["*skip*"]).collect()}
    assert done == {"a.tal": 3, "b.md": 1, "c.log": 5}
    again = Pipeline.load(spark, str(tmp_path / "index"))
    got = again.search("wire license", 5).orderBy("rank").collect()
    assert got[0].retrieval_method == "hybrid" and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert {r.source_type for r in again.related_code("wire").collect()} == {"code"}
    assert all("Licensing" in r.matched_capabilities for r in again.by_capability("Licensing").collect())
    types = {r.result_type for r in again.search_cross_reference("wire", "code", ["log", "document"]).collect()}
    assert "code" in types and "log" in types
    assert {r.metric for r in again.statistics().collect()} >= {"total_chunks", "vector_store_size"}
    text = assist.context(again.search("wire license"), 0.0).first()["context"]
    assert "CODE ARTIFACTS" in text and "LOG ARTIFACTS" in text and "--- Document: " in text and "Procedure: " in text
    assert assist.context(again.search("wire"), 2.0).first()["context"] == "No results found with score >= 2.00"
    helper = assist.Assistant(assist.create_model())
    assert "texts" in helper.analyze("wire", again.search("wire"), 0.0) and helper.explain_code("log", "x") == "Not code."
    assert assist.Item.of_image("a.PNG", b"x").encoded == "eA=="
    p.index_content(b"# New\nsome more text about the nation and wire\n", "new.md")
    assert p.tables[0].count() == 10
    cli.main(["search", "wire", "--index", str(tmp_path / "index"), "--top", "3"], spark)
    cli.main(["capabilities", "--index", str(tmp_path / "index")], spark)
    cli.main(["stats", "--index", str(tmp_path / "index")], spark)
    assert "Transfers" in capsys.readouterr().out
    cli.shell(again, [":top 2", ":minscore 0.1", ":code wire", ":cap Licensing", ":analyze wire", ":what", "wire license", ":quit", "never"])
    said = capsys.readouterr().out
    assert cli.HELP in said and "texts" in said


@pytest.mark.parametrize("kind", ["tfidf", "hybrid", None])
def test_other_embedders(spark, folder, tmp_path, kind):
    p = Pipeline(spark, VOCABULARY, str(tmp_path / "index"), kind)
    p.index_directory(str(folder))
    assert Pipeline.load(spark, str(tmp_path / "index")).search("nation wire").count() > 0


def test_custom_embedding(spark, folder, tmp_path):
    p = Pipeline(spark, VOCABULARY, str(tmp_path / "index"), None, embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)))
    p.index_directory(str(folder))
    assert p.search("wire").first().vector_score > 0


def test_stream(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    (d / "1.txt").write_text("1\tERROR trace_id=aaaaaaaa1 x\n2\ttrace_id=aaaaaaaa1 y\n1500\ttrace_id=aaaaaaaa1 z\n")
    lines = stream.read_lines(spark, str(d)).select(F.lit("f").alias("path"), F.split("line", "\t")[0].cast("long").alias("line_number"), F.split("line", "\t")[1].alias("line"))
    found = []
    query = stream.write_chunks(lines, lambda df, n: found.extend(df.collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert sorted((r.batch, r.entry_count, r.has_error) for r in found) == [(0, 2, True), (1, 1, False)]
    sessions = stream.sessions(spark.createDataFrame([("2024-01-01 00:00:00 trace_id=aaaaaaaa1 x",), ("2024-01-01 00:05:00 trace_id=aaaaaaaa1 ERROR",), ("2024-01-01 01:00:00 trace_id=aaaaaaaa1",)], "line string"))
    assert sorted((r.entry_count, r.has_error) for r in sessions.collect()) == [(1, False), (2, True)]


def test_stream_of_files(spark, tmp_path):
    """Files to chunks, end to end: lines keep their numbers."""
    from lexispark.streaming import logs as S

    (tmp_path / "in").mkdir()
    lines = [f"2024-01-01 00:00:0{i % 10} INFO trace_id=trace-{i % 3:08d} said {i}" for i in range(25)]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.log").write_bytes(b"one\r\n\r\nERROR three")
    got = []
    q = S.write_chunks(S.read_lines(spark, str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    a = [r for r in got if r.path.endswith("a.log")]
    assert sorted((r.trace_id, r.entry_count, r.line_start, r.line_end) for r in a) == [("trace-00000000", 9, 1, 25), ("trace-00000001", 8, 2, 23), ("trace-00000002", 8, 3, 24)]
    b = [r for r in got if r.path.endswith("b.log")]
    assert sorted((r.line_start, r.text, r.has_error) for r in b) == [(1, "one", False), (3, "ERROR three", True)]


def test_corpus_and_hooks(spark, tmp_path):
    import zipfile

    d = tmp_path / "d"
    d.mkdir()
    with zipfile.ZipFile(d / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Wire transfer rules for everybody</w:t></w:r></w:p></w:body></w:document>')
    (d / "b.md").write_text("# Head\nsettlement of the wire\n")
    (d / "c.log").write_text('{"msg": "mail sent", "level": "info"}\n{"msg": "mail lost", "level": "error"}\n')
    (d / "e.tal").write_text("PROC p;\nEND;")
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.corpus_texts(files.read(spark, str(d))).collect()}
    assert texts["b.md"] == "Head\nsettlement of the wire" and texts["c.log"] == "mail sent\nmail lost" and texts["e.tal"] == "PROC p;\nEND;"
    assert "Wire transfer rules" in texts["a.docx"] and "PK" not in texts["a.docx"]
    before = {k: list(v) for k, v in files.EXTENSIONS.items()}
    try:
        files.register_parser("note", [".note"], lambda df, v: df.select("path", files.decoded(F.col("content")).alias("text"), F.concat(F.lit("note_"), F.md5("content")).alias("chunk_id"), F.lit("note").alias("semantic_type")))
        (d / "x.note").write_text("wire me")
        seen = []
        p = Pipeline(spark, VOCABULARY, str(tmp_path / "index"), "tfidf", progress=lambda *a: seen.append(a), max_features=50, n_features=7)
        p.index_directory(str(d)).collect()
        assert [s[1:] for s in seen] == [(1, 4), (2, 4), (3, 4), (4, 4)]
        assert any(i["kind"] == "note" and i["custom"] for i in p.parser_info())
        again = Pipeline.load(spark, str(tmp_path / "index"))
        rows = lambda x: [(r.chunk_id, round(r.combined_score, 9)) for r in x.search("wire mail", 5).orderBy("rank").collect()]
        assert rows(again) == rows(p) and any(k.startswith("note_") for k, _ in rows(p))
        assert sorted(again.embedder.terms.collect()) == sorted(p.embedder.terms.collect())
    finally:
        files.PARSERS.clear()
        files.EXTENSIONS.clear()
        files.EXTENSIONS.update(before)


def test_pdf_libraries(monkeypatch):
    """Against stand-ins for two of the optional libraries."""
    import types

    class Page:
        def extract_text(self):
            return "lost line\nOVERVIEW\nbody one\nbody two"

        def extract_tables(self):
            return [[["a", None], ["b", "c"]]]

        def get_text(self, kind):
            return [(0, 0, 1, 1, " first block ", 0, 0), (0, 0, 1, 1, "image", 1, 1)]

    monkeypatch.setattr(documents, "pdf_library", lambda: "pdfplumber")
    monkeypatch.setattr(documents.importlib, "import_module", lambda name: types.SimpleNamespace(open=lambda *a, **k: types.SimpleNamespace(pages=[Page()])))
    got = [(s["title"], s["content"], s["element_type"], s["page_number"]) for s in documents._pdf(b"")]
    assert got == [(None, "lost line", "paragraph", 1), ("OVERVIEW", "body one\nbody two", "paragraph", 1), ("OVERVIEW", "a | \nb | c", "table", 1)]
    monkeypatch.setattr(documents, "pdf_library", lambda: "fitz")
    monkeypatch.setattr(documents.importlib, "import_module", lambda name: types.SimpleNamespace(open=lambda **k: [Page()]))
    assert [(s["content"], s["page_number"]) for s in documents._pdf(b"")] == [("first block", 1)]
