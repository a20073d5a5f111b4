"""Tables of PDF files in Spark: layout, tables, rendering, modes, SQL and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import sql as sql_functions
from quire.kernel import layout
from quire.operators.extract import PdfFrames, page_texts, read_pdfs
from quire.operators.layout import fold_lines
from quire.operators.tables import add_grid, add_table, fill_cells, place_runs
from quire.sources import pdf, writer

TEXT = 'One <a & b> "c" \'d\'\nTwo'


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, writer.text_pdf(TEXT)), (2, b"junk"), (3, writer.text_pdf("\n".join(f"l{i}" for i in range(120)))), (4, None), (5, writer.image_pdf(2, 2, b"\0\1\2\3"))]
    return spark.createDataFrame(rows, "doc_id long, content binary")


def test_lines_and_errors(files):
    f = PdfFrames(files)
    got = {(r.doc_id, r.page_no, r.line_no): r.text for r in f.lines.collect()}
    assert got[1, 1, 2] == "Two" and got[3, 3, 20] == "l119" and len(got) == 122
    assert {(r.doc_id, r.error_code) for r in f.errors.collect()} == {(2, "InvalidHeader"), (4, "InvalidHeader")}
    assert {r.doc_id: r.page_count for r in f.docs.collect()} == {1: 1, 2: None, 3: 3, 4: None, 5: 1}


def test_modes(files):
    assert {r.doc_id for r in PdfFrames(files, mode="dropmalformed").texts.collect()} == {1, 3, 5}
    with pytest.raises(Exception, match="InvalidHeader"):
        PdfFrames(files, mode="FAILFAST").lines.collect()
    with pytest.raises(ValueError, match="mode"):
        pdf.read_pages(files, mode="maybe")


def test_page_choice(files):
    assert {r.page_no for r in PdfFrames(files.where("doc_id = 3"), pages_wanted=(2,)).lines.collect()} == {2}


def test_rendering(files):
    f = PdfFrames(files)
    text = {r.doc_id: r.text for r in f.rendered("text").collect()}
    assert text[1] == TEXT
    markdown = {r.doc_id: r.markdown for r in f.rendered("markdown").collect()}
    assert markdown[3].count("\n\n---\n\n") == 2 and markdown[5].startswith("_[scanned page")
    html = {r.doc_id: r.html for r in f.rendered("html").collect()}
    assert "<p>One &lt;a &amp; b&gt; &quot;c&quot; &#39;d&#39;</p>" in html[1] and 'data-needs-ocr="true"' in html[5] and "<img src=" in html[5]
    found = {r.doc_id: r.json for r in f.rendered("json").collect()}
    d = json.loads(found[1])
    assert list(d) == ["version", "pages"] and list(d["pages"][0]) == ["width", "height", "lines", "needs_ocr", "tables", "images"]
    assert '\n  "pages": [\n    {\n      "width": 612.0,' in found[1]


def test_sql_renderers_agree_with_the_columns(spark, files):
    """Text, tables, images and pages that need OCR, from content alone and from extracted pages."""
    more = [(6, writer.table_pdf([["name", "b|c"], ["dd", "ee & <f>"]], "cap")), (7, writer.image_pdf(2, 2, b"\0\1\2\3", "with text"))]
    every = files.unionAll(spark.createDataFrame(more, files.schema))
    sql_functions.register(spark)
    kinds = ("text", "markdown", "html", "json")
    got = {r.doc_id: r for r in every.selectExpr("doc_id", *[f"pdf_{k}(content) as `{k}`" for k in kinds]).collect()}
    assert got[2][1:] == got[4][1:] == (None,) * 4
    for k in kinds:
        want = {r.doc_id: r[k] for r in PdfFrames(every).rendered(k).collect()}
        assert want == {i: r[k] for i, r in got.items() if r[k] is not None}
    found = {r.doc_id: r for r in every.selectExpr("doc_id", "pdf_inspect(content) i", "pdf_lints(content) l", "pdf_error(content) e").collect()}
    assert (found[3].i.page_count, found[3].i.encrypted, found[3].i.error_code, found[3].l, found[3].e) == (3, False, None, [], None)
    assert (found[2].i.page_count, found[2].i.error_code, found[2].l, found[2].e) == (None, "InvalidHeader", None, "InvalidHeader")


def test_lints_are_columns(spark):
    good = writer.text_pdf("hello", filter="none")
    at = good.index(b"/Length ") + 8
    f = PdfFrames(spark.createDataFrame([(1, good), (2, good[:at] + b"9" + good[at + 1 :]), (3, b"junk")], "doc_id long, content binary"))
    assert [(r.doc_id, r.code) for r in f.lints.collect()] == [(2, "LengthMismatch")]
    assert {r.doc_id: r.lints for r in f.docs.collect()} == {1: [], 2: [], 3: []} and f.lines.count() == 2


def test_table_rendering(spark):
    files = spark.createDataFrame([(1, writer.table_pdf([["name", "b|c"], ["dd", "ee"]], "cap"))], "doc_id long, content binary")
    f = PdfFrames(files)
    assert f.rendered("markdown").first().markdown == "cap\n\n| name | b\\|c |\n| --- | --- |\n| dd | ee |"
    assert "<table>\n<tr><td>name</td><td>b|c</td></tr>\n" in f.rendered("html").first().html
    assert [r.text for r in f.lines.collect()] == ["cap"]


def page_row(rng, n, ruled):
    chars = ["ab", "x ", " y", "(", ")", "=", "long word", "", "≤"]
    runs = []
    for k in range(n):
        y = rng.choice([700.0, 700.5, 699.0, 686.0, 672.0, 671.0])
        runs.append((k, rng.choice(chars), round(rng.uniform(0, 300), 1), y, round(rng.uniform(0, 60), 1), rng.choice([8.0, 10.0, 24.0]), "F"))
    segments = []
    if ruled:
        segments = [("x", 100.0 * i + rng.choice([0, 0.5, 1.9])) for i in range(4)] + [("y", 660.0 + 15 * i) for i in range(4)] + [("y", 661.0)]
    return runs, segments


def test_columns_agree_with_the_kernel(spark):
    """The column expressions and the plain form give the same lines and tables."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(60):
        runs, segments = page_row(rng, rng.randint(0, 25), i % 2)
        rows.append((i, runs, segments))
        plain = [r[1:] for r in runs]
        cells, rest = layout.table(segments, plain)
        want[i] = (cells, layout.lines(rest))
    df = spark.createDataFrame(rows, f"doc_id long, runs array<{pdf.RUN}>, segments array<{pdf.SEGMENT}>")
    laid = add_table(fill_cells(place_runs(add_grid(df)))).select("doc_id", "table", fold_lines(F.col("outside")).alias("lines"))
    for r in laid.collect():
        cells, lines = want[r.doc_id]
        assert (r.table.cells if r.table else None) == cells, r.doc_id
        assert [tuple(x) for x in r.lines] == lines, r.doc_id


def test_large_pages_use_the_kernel(spark):
    text = " ".join(f"w{i}" for i in range(400))
    pages = pdf.read_pages(spark.createDataFrame([(1, writer.text_pdf(text, style="words"))], "doc_id long, content binary"))
    assert pages.where("big_lines is not null").count() == 1
    assert page_texts(pages).first().lines[0].text == text


def test_files_views_and_sql(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(writer.text_pdf(TEXT))
    (tmp_path / "note.txt").write_text("no")
    frames = read_pdfs(spark, str(tmp_path))
    frames.register(spark)
    assert spark.sql("select count(*) n from pdf_lines").first().n == 2
    sql_functions.register(spark)
    frames.files.createOrReplaceTempView("files")
    rows = spark.sql("select l.text, pdf_page_count(content) n, pdf_error(content) e, pdf_text(content) t from files, lateral pdf_lines(content) l").collect()
    assert [r.text for r in rows] == TEXT.split("\n") and rows[0].n == 1 and rows[0].e is None and rows[0].t == TEXT
    got = spark.sql("select pdf_decode_stream('AHx', cast('4869>' as binary)) b, pdf_decode_stream('Fl', cast('no' as binary)) c").first()
    assert bytes(got.b) == b"Hi" and got.c is None


def test_stream_equals_batch(spark, tmp_path):
    from quire.streaming.pdf import stream_pdfs, write_available

    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.pdf").write_bytes(writer.text_pdf(f"{TEXT}\n{i}"))
    lines = stream_pdfs(spark, str(source), max_files=1).lines
    write_available(lines, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.doc_id, r.line_no, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.doc_id, r.line_no, r.text) for r in read_pdfs(spark, str(source)).lines.collect()}
    assert got == want and len(got) == 9


def test_empty_input(spark):
    none = spark.createDataFrame([], "doc_id long, content binary")
    f = PdfFrames(none)
    assert f.lines.count() == f.docs.count() == f.rendered("json").count() == 0


def test_data_source(spark, tmp_path):
    from quire.sources import datasource

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(writer.text_pdf("\n".join(f"l{i}" for i in range(120))))
    (tmp_path / "sub" / "b.pdf").write_bytes(b"junk")
    datasource.register(spark)
    df = spark.read.format("pdf").option("filesPerPartition", 1).load(str(tmp_path))
    assert df.where("text is not null").count() == 120 and [r.error_code for r in df.where("error_code is not null").collect()] == ["InvalidHeader"]
    assert [r.text for r in df.where("page_no = 3 and line_no <= 2").orderBy("line_no").collect()] == ["l100", "l101"]
    by_uri = spark.read.format("pdf").load(f"file://{tmp_path}")
    assert by_uri.count() == 121 and by_uri.first().doc_id.startswith("file://")
    assert spark.read.format("pdf").load(str(tmp_path / "a.pdf")).count() == 120


def test_command_line_arguments(capsys):
    from quire.__main__ import main

    assert main([]) == 2 and main(["a", "pdf"]) == 2
    assert "PATH" in capsys.readouterr().err


def test_inner_tables(spark):
    pdf_bytes = writer.text_pdf("ab", structure="objstm")
    f = PdfFrames(spark.createDataFrame([(1, pdf_bytes), (2, b"junk"), (3, None)], "doc_id long, content binary"))
    objects = {r.obj_num: r for r in f.objects.collect()}
    assert objects[0].kind == "dict" and {r.storage for r in objects.values()} == {"trailer", "plain", "packed"}
    assert [(r.operator, r.operands) for r in f.operations.where("operator = 'Tj'").collect()] == [("Tj", ["(ab)"])]
    assert {(r.text, r.width, r.n) for r in f.glyphs.collect()} == {("a", 0.5, 1), ("b", 0.5, 1)}
