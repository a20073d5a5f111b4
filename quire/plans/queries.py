"""The reader's operators as queries over the driver's tables, with their SQL.

Each query makes PDFs of rows, reads them back and returns what was extracted;
the SQL states what the extraction must give from the rows alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import sql as sql_functions
from quire.operators.extract import PdfFrames
from quire.sources import writer
from quire.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: one small input file would otherwise be one task."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def texts(spark: SparkSession, sf_dir: str, password: str = "", **variant) -> PdfFrames:
    return PdfFrames(writer.write_texts(documents(spark, sf_dir), **variant), password)


LINES = """
  SELECT doc_id, ((i - 1) // 50 + 1)::INT AS page_no, ((i - 1) % 50 + 1)::INT AS line_no, line AS text
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
"""
PLACED = f"SELECT doc_id, page_no, line_no, text, 50.0::DOUBLE AS x, (760 - 14 * (line_no - 1))::DOUBLE AS y FROM ({LINES})"
PAGES = f"""SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS body FROM ({LINES}) GROUP BY doc_id, page_no"""
ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def lines_of(frames: PdfFrames) -> DataFrame:
    return frames.lines.select("doc_id", "page_no", "line_no", "text", "x", "y")


@query("pdf_lines", PLACED)
def pdf_lines(spark, sf_dir):
    return lines_of(texts(spark, sf_dir))


def variant(name: str, password: str = "", **how) -> None:
    QUERIES[name] = lambda spark, sf_dir: lines_of(texts(spark, sf_dir, password, **how))
    ORACLE[name] = PLACED


for _s in writer.STRUCTURES[1:]:
    variant(f"pdf_{ {'stream': 'xref_stream'}.get(_s, _s) }", structure=_s)
for _f in writer.FILTERS[1:]:
    variant(f"pdf_{ {'png': 'png_predictor', 'tiff': 'tiff_predictor', 'none': 'unfiltered'}.get(_f, _f) }", filter=_f)
for _t in writer.FONTS[1:]:
    variant(f"pdf_{_t}", font=_t)
for _o, _n in (("td", "text_moves"), ("quote", "text_quotes"), ("cm", "text_matrices"), ("words", "runs_words")):
    variant(f"pdf_{_n}", style=_o)
for _c in writer.CIPHERS:
    variant(f"pdf_{_c}", password="reader", cipher=_c, user="reader", owner="keeper")
variant("pdf_owner_password", password="keeper", cipher="aes128", user="reader", owner="keeper")
variant("pdf_aes256_r5", password="reader", cipher="aes256", user="reader", owner="keeper", revision=5)


@query("pdf_runs", f"""
SELECT doc_id, page_no, (line_no - 1)::INT AS run_no, text, x, y, (5.5 * length(text))::DOUBLE AS width, 11.0::DOUBLE AS font_size, 'F1' AS font
FROM ({PLACED})""")
def pdf_runs(spark, sf_dir):
    return texts(spark, sf_dir, font="type0").runs.select("doc_id", "page_no", "run_no", "text", "x", "y", "width", "font_size", "font")


@query("pdf_page_count", f"SELECT doc_id, max(page_no)::INT AS page_count FROM ({LINES}) GROUP BY doc_id")
def pdf_page_count(spark, sf_dir):
    return texts(spark, sf_dir).docs.select("doc_id", "page_count")


@query("pdf_inspect", f"""
SELECT doc_id, '1.7' AS version, max(page_no)::INT AS page_count, false AS encrypted, (2 * max(page_no) + 5)::BIGINT AS object_count,
       'Tïtle α' AS title, 'quire' AS creator, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0::INT AS rotate
FROM ({LINES}) GROUP BY doc_id""")
def pdf_inspect(spark, sf_dir):
    first = F.get("page_sizes", F.lit(0))
    return texts(spark, sf_dir, title="Tïtle α").docs.select(
        "doc_id", "version", "page_count", "encrypted", "object_count", "title", "creator",
        (first["x1"] - first["x0"]).alias("width"), (first["y1"] - first["y0"]).alias("height"), first["rotate"].alias("rotate"),
    )


@query("pdf_page_sizes", f"SELECT DISTINCT doc_id, page_no, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, false AS needs_ocr FROM ({LINES})")
def pdf_page_sizes(spark, sf_dir):
    return texts(spark, sf_dir).texts.select("doc_id", "page_no", "width", "height", "needs_ocr")


@query("pdf_page_range", f"SELECT * FROM ({PLACED}) WHERE page_no = 2")
def pdf_page_range(spark, sf_dir):
    files = writer.write_texts(documents(spark, sf_dir))
    return lines_of(PdfFrames(files, pages_wanted=(2,)))


@query("pdf_text", f"SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page_no) AS text FROM ({PAGES}) GROUP BY doc_id")
def pdf_text(spark, sf_dir):
    return texts(spark, sf_dir).rendered("text")


@query("pdf_markdown", f"SELECT doc_id, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no) AS markdown FROM ({PAGES}) GROUP BY doc_id")
def pdf_markdown(spark, sf_dir):
    return texts(spark, sf_dir).rendered("markdown")


@query("pdf_paged", f"""
SELECT doc_id, string_agg('--- page ' || page_no || ' (612x792) ---' || chr(10) || body || chr(10), '' ORDER BY page_no) AS paged FROM ({PAGES}) GROUP BY doc_id""")
def pdf_paged(spark, sf_dir):
    return texts(spark, sf_dir).rendered("paged")


@query("pdf_objects", f"""
WITH p AS (SELECT doc_id, max(page_no) AS n FROM ({LINES}) GROUP BY doc_id)
SELECT doc_id, t.type, t.kind, (CASE WHEN t.type IN ('Font', 'Pages', 'Catalog') THEN 1 ELSE n END)::BIGINT AS n_objects
FROM p, (VALUES ('Font', 'dict'), ('Pages', 'dict'), ('Catalog', 'dict'), ('Page', 'dict'), (NULL, 'stream')) t(type, kind)""")
def pdf_objects(spark, sf_dir):
    return texts(spark, sf_dir).objects.where("obj_num > 0").groupBy("doc_id", "type", "kind").agg(F.count("*").alias("n_objects"))


@query("pdf_operations", f"""
SELECT doc_id, page_no, operator, (CASE operator WHEN 'Tj' THEN count(*) WHEN 'Tm' THEN count(*) ELSE 1 END)::BIGINT AS n
FROM ({LINES}), (SELECT unnest(['BT', 'Tf', 'Tm', 'Tj', 'ET']) AS operator) GROUP BY doc_id, page_no, operator""")
def pdf_operations(spark, sf_dir):
    return texts(spark, sf_dir).operations.groupBy("doc_id", "page_no", "operator").agg(F.count("*").alias("n"))


@query("pdf_glyphs", f"""
SELECT doc_id, c AS text, 0.5::DOUBLE AS width, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM ({LINES})) WHERE c <> '' GROUP BY doc_id, c""")
def pdf_glyphs(spark, sf_dir):
    return texts(spark, sf_dir).glyphs.groupBy("doc_id", "text", "width").agg(F.sum("n").alias("n"))


@query("pdf_html", f"""
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><meta charset="utf-8"><title>quire</title></head>' || chr(10) || '<body>' || chr(10)
  || string_agg(body, '' ORDER BY page_no) || '</body>' || chr(10) || '</html>' || chr(10) AS html
FROM (SELECT doc_id, page_no, '<section class="page" style="width:612px;height:792px">' || chr(10)
        || string_agg('<p>' || {ESCAPED} || '</p>' || chr(10), '' ORDER BY line_no) || '</section>' || chr(10) AS body
      FROM ({LINES}) GROUP BY doc_id, page_no) GROUP BY doc_id""")
def pdf_html(spark, sf_dir):
    return texts(spark, sf_dir).rendered("html")


@query("pdf_json", PLACED)
def pdf_json(spark, sf_dir):
    """The JSON of every document, parsed again."""
    schema = "version string, pages array<struct<width:double,height:double,lines:array<struct<text:string,x:double,y:double>>>>"
    docs = texts(spark, sf_dir).rendered("json").select("doc_id", F.from_json("json", schema).alias("d"))
    pages = docs.select("doc_id", F.posexplode("d.pages").alias("p", "page"))
    lines = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), F.posexplode("page.lines").alias("k", "l"))
    return lines.select("doc_id", "page_no", (F.col("k") + 1).alias("line_no"), "l.text", "l.x", "l.y")


def nation_grids(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cell = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("r_name"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").cast("long").alias("doc_id"), F.col("r_name").alias("caption"))
    grids = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("cells")))), lambda x: x["cells"]).alias("grid"))
    return writer.as_files(spread(grids, "doc_id"), lambda grid, caption: writer.table_pdf(grid, caption), ["grid", "caption"])


@query("pdf_tables", """
SELECT r_regionkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS "row", c::INT AS col,
       CASE c WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name ELSE r_name END AS text
FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT 0 AS c) WHERE c = 0
UNION ALL SELECT r_regionkey::BIGINT, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT, 1, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey::BIGINT, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT, 2, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def pdf_tables(spark, sf_dir):
    return PdfFrames(nation_grids(spark, sf_dir)).cells.select("doc_id", "row", "col", "text")


@query("pdf_table_exclusion", "SELECT r_regionkey::BIGINT AS doc_id, r_name AS text, 50.0::DOUBLE AS x, 730.0::DOUBLE AS y FROM region")
def pdf_table_exclusion(spark, sf_dir):
    return PdfFrames(nation_grids(spark, sf_dir)).lines.select("doc_id", "text", "x", "y")


@query("pdf_segments", """
SELECT axis, pos::DOUBLE AS pos, sum(n)::BIGINT AS n_segments FROM (
  SELECT 'x' AS axis, 50 + 120 * (c + d) AS pos, k AS n FROM (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest([0, 1]) AS d), (SELECT count(*) AS k FROM nation)
  UNION ALL
  SELECT 'y', 700 - 20 * (r + d), 3 FROM (SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation), (SELECT unnest([0, 1]) AS d)
) GROUP BY axis, pos""")
def pdf_segments(spark, sf_dir):
    return PdfFrames(nation_grids(spark, sf_dir)).segments.groupBy("axis", "pos").agg(F.count("*").alias("n_segments"))


def part_grid(brand: str, size: int) -> bytes:
    return writer.table_pdf([[brand if size % 3 else "", "x" if size % 2 else "", ""], ["y", "", "z" if size % 5 else ""]], "part")


@query("pdf_table_validity", """
SELECT p_partkey AS doc_id, (n / 6.0 >= 0.3 AND chars / n >= 2)::INT AS n_tables
FROM (SELECT p_partkey, (1 + (p_size % 3 <> 0)::INT + (p_size % 2 <> 0)::INT + (p_size % 5 <> 0)::INT)::DOUBLE AS n,
             1 + (p_size % 3 <> 0)::INT * length(p_brand) + (p_size % 2 <> 0)::INT + (p_size % 5 <> 0)::INT AS chars FROM part)""")
def pdf_table_validity(spark, sf_dir):
    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    pages = PdfFrames(writer.as_files(parts, part_grid, ["p_brand", "p_size"], "p_partkey")).texts
    return pages.select("doc_id", F.size("tables").alias("n_tables"))


def vector_image(values: list[float]) -> bytes:
    samples = bytes(max(0, min(255, int((v + 1) * 127.5))) for v in values)
    return writer.image_pdf(8, len(samples) // 8, samples)


def vector_files(spark, sf_dir) -> DataFrame:
    rows = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    return writer.as_files(rows, vector_image, ["embedding"], "vec_id")


@query("pdf_images", """
SELECT vec_id AS doc_id, 'Im0' AS name, 'Raw' AS format, 8::BIGINT AS width, (len(embedding) // 8)::BIGINT AS height,
       8::BIGINT AS bits_per_component, 'DeviceGray' AS color_space, true AS needs_ocr FROM embeddings""")
def pdf_images(spark, sf_dir):
    pages = PdfFrames(vector_files(spark, sf_dir)).pages.select("doc_id", "needs_ocr", F.explode("images").alias("i"))
    return pages.select("doc_id", "i.name", "i.format", "i.width", "i.height", "i.bits_per_component", "i.color_space", "needs_ocr")


def _be(value: str) -> str:
    """The four bytes of a number, most significant first, in SQL."""
    return f"list_transform([24, 16, 8, 0], lambda k: ({value} >> k) & 255)"


def _chunk(kind: bytes, body: str) -> str:
    """A PNG chunk as a list of bytes in SQL; its check is a CRC-32 over ``crc``'s table."""
    named = f"list_concat({list(kind)}, {body})"
    crc = f"xor(list_reduce(list_prepend(4294967295, {named}), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"
    return f"list_concat({_be(f'len({body})')}, list_concat({named}, {_be(crc)}))"


#: The PNG of an 8-bit grey image whose rows are one stored block: built in SQL from the format's definition.
PNG = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), v AS (
  SELECT vec_id, len(embedding) // 8 AS h, list_transform(embedding, lambda x: greatest(0, least(255, trunc((x::DOUBLE + 1) * 127.5)))::BIGINT) AS s FROM embeddings
), z AS (
  SELECT vec_id, h, flatten(list_transform(range(h), lambda r: list_prepend(0, s[r * 8 + 1 : r * 8 + 8]))) AS raw FROM v
), a AS (
  SELECT *, len(raw) AS n, (1 + list_sum(raw)) % 65521 AS low, (len(raw) + list_sum(list_transform(raw, lambda x, i: x * (len(raw) - i + 1)))) % 65521 AS high FROM z
), d AS (
  SELECT vec_id, list_concat([120, 1, 1, n & 255, n >> 8, 255 - (n & 255), 255 - (n >> 8)], list_concat(raw, {_be('(high * 65536 + low)::BIGINT')})) AS data,
         list_concat([0, 0, 0, 8], list_concat({_be('h')}, [8, 0, 0, 0, 0])) AS head FROM a
), p AS (
  SELECT vec_id, list_concat([137, 80, 78, 71, 13, 10, 26, 10], list_concat({_chunk(b'IHDR', 'head')}, list_concat({_chunk(b'IDAT', 'data')}, {_chunk(b'IEND', '[]::BIGINT[]')}))) AS png FROM d, t
)
SELECT vec_id AS doc_id, 'Im0' AS name,
       'data:image/png;base64,' || to_base64(unhex(list_aggregate(list_transform(png, lambda x: format('{{:02x}}', x)), 'string_agg', ''))) AS data_url FROM p"""


@query("pdf_image_url", PNG)
def pdf_image_url(spark, sf_dir):
    return PdfFrames(vector_files(spark, sf_dir)).images.select("doc_id", "name", "data_url")


@query("pdf_needs_ocr", """
SELECT doc_id, doc_id % 7 = 0 AS needs_ocr, CASE WHEN doc_id % 7 = 0 THEN '_[scanned page — text extraction requires OCR]_' END AS note FROM documents""")
def pdf_needs_ocr(spark, sf_dir):
    def build(doc_id, text):
        return writer.image_pdf(2, 2, b"\x00\x55\xaa\xff", None if doc_id % 7 == 0 else text or "")

    frames = PdfFrames(writer.as_files(documents(spark, sf_dir), build, ["doc_id", "text"]))
    marked = frames.pages.groupBy("doc_id").agg(F.every("needs_ocr").alias("needs_ocr")).join(frames.rendered("markdown"), "doc_id")
    return marked.select("doc_id", "needs_ocr", F.when(F.col("needs_ocr"), F.col("markdown")).alias("note"))


def broken(doc_id: int, text: str) -> bytes:
    good = writer.text_pdf(text or "")
    kind = doc_id % 6
    if kind == 1:
        return b"not a pdf at all"
    if kind == 2:
        return good.replace(b"startxref", b"startxxxx")
    if kind == 3:
        return good.replace(b"/Root", b"/Rxxt")
    if kind == 4:
        return good.replace(b"/FlateDecode", b"/FlxteDecode")
    if kind == 5:
        return good.replace(b"stream\nx", b"stream\n\x00\xff\xff", 1)[: len(good) + 2].replace(b"\x78\x9c", b"\xff\xff")
    return good


@query("pdf_errors", """
SELECT doc_id, [NULL, 'InvalidHeader', 'InvalidXref', 'MissingTrailer', 'Unsupported'][doc_id % 6 + 1] AS error_code FROM documents WHERE doc_id % 6 BETWEEN 1 AND 4""")
def pdf_errors(spark, sf_dir):
    files = writer.as_files(documents(spark, sf_dir), lambda d, t: broken(d, t) if d % 6 != 5 else broken(0, t), ["doc_id", "text"])
    return PdfFrames(files).errors.select("doc_id", "error_code")


def readable_lines(spark, sf_dir) -> DataFrame:
    """All lines of the documents whose files are not broken."""
    files = writer.as_files(documents(spark, sf_dir), lambda d, t: broken(d, t) if d % 6 != 5 else broken(0, t), ["doc_id", "text"])
    return PdfFrames(files, mode="DROPMALFORMED").lines.select("doc_id", "page_no", "line_no", "text")


@query("pdf_dropmalformed", f"SELECT * FROM ({LINES}) WHERE doc_id % 6 IN (0, 5)")
def pdf_dropmalformed(spark, sf_dir):
    """All lines of every readable document."""
    return readable_lines(spark, sf_dir)


def faulty(doc_id: int, text: str) -> bytes:
    """A file that can be read in spite of a wrong /Length, or of an object that is no object."""
    kind = doc_id % 3
    good = writer.text_pdf(text or "", filter="none", title="t")
    if kind == 1:
        return re.sub(rb"/Length (\d+)", lambda m: b"/Length " + b"0" * len(m[1]), good, count=1)
    return good.replace(b"/Creator", b")Creator", 1) if kind == 2 else good


@query("pdf_lints", f"""
SELECT d.doc_id, CASE d.doc_id % 3 WHEN 1 THEN 'LengthMismatch' ELSE 'DroppedObject' END AS code, count(*)::BIGINT AS n_lines
FROM documents d JOIN ({LINES}) l ON l.doc_id = d.doc_id WHERE d.doc_id % 3 IN (1, 2) GROUP BY d.doc_id""")
def pdf_lints(spark, sf_dir):
    """The faults found, and the lines read in spite of them."""
    frames = PdfFrames(writer.as_files(documents(spark, sf_dir), faulty, ["doc_id", "text"]))
    lines = frames.lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return frames.lints.select("doc_id", "code").join(lines, "doc_id")


@query("pdf_password_table", f"SELECT doc_id, max(page_no)::INT AS page_count, true AS encrypted FROM ({LINES}) GROUP BY doc_id")
def pdf_password_table(spark, sf_dir):
    """Every file has a password of its own, joined in as a column."""
    docs = documents(spark, sf_dir)
    files = writer.as_files(docs, lambda d, t: writer.text_pdf(t or "", cipher="rc4", user=f"pw{d}"), ["doc_id", "text"])
    words = docs.select("doc_id", F.concat(F.lit("pw"), F.col("doc_id")).alias("password"))
    return PdfFrames(files.join(words, "doc_id")).docs.select("doc_id", "page_count", "encrypted")


@query("pdf_wordcount_by_lang", f"""
SELECT lang, count(*)::BIGINT AS n_lines, sum(len(regexp_extract_all(l.text, '[^ ]+')))::BIGINT AS n_words
FROM ({LINES}) l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang""")
def pdf_wordcount_by_lang(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = texts(spark, sf_dir).lines.select("doc_id", F.regexp_count("text", F.lit("[^ ]+")).alias("n")).join(lang, "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum("n").cast("long").alias("n_words"))


@query("pdf_quality_join", f"""
SELECT quality, count(DISTINCT l.doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_lines FROM ({LINES}) l JOIN labels b ON l.doc_id = b.doc_id GROUP BY quality""")
def pdf_quality_join(spark, sf_dir):
    per = texts(spark, sf_dir).lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return per.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))


@query("pdf_duplicate_lines", f"SELECT text, count(DISTINCT doc_id)::BIGINT AS n_docs FROM ({LINES}) GROUP BY text HAVING count(DISTINCT doc_id) >= 2")
def pdf_duplicate_lines(spark, sf_dir):
    seen = texts(spark, sf_dir).lines.select("text", "doc_id").distinct()
    return seen.groupBy("text").agg(F.count("*").alias("n_docs")).where("n_docs >= 2")


@query("pdf_longest_lines", f"SELECT doc_id, page_no, line_no, length(text)::INT AS n_chars FROM ({LINES}) ORDER BY n_chars DESC, doc_id, page_no, line_no LIMIT 20")
def pdf_longest_lines(spark, sf_dir):
    lines = texts(spark, sf_dir).lines.select("doc_id", "page_no", "line_no", F.char_length("text").alias("n_chars"))
    return lines.orderBy(F.col("n_chars").desc(), "doc_id", "page_no", "line_no").limit(20)


@query("pdf_sql_udtf", PLACED)
def pdf_sql_udtf(spark, sf_dir):
    sql_functions.register(spark)
    writer.write_texts(documents(spark, sf_dir)).createOrReplaceTempView("pdf_files")
    return spark.sql("SELECT doc_id, l.page_no, l.line_no, l.text, l.x, l.y FROM pdf_files, LATERAL pdf_lines(content) l")


def in_sql(spark, sf_dir, expression: str, **variant) -> DataFrame:
    sql_functions.register(spark)
    writer.write_texts(documents(spark, sf_dir), **variant).createOrReplaceTempView("pdf_files")
    return spark.sql(f"SELECT doc_id, {expression} FROM pdf_files")


@query("pdf_sql_text", ORACLE["pdf_text"])
def pdf_sql_text(spark, sf_dir):
    return in_sql(spark, sf_dir, "pdf_text(content) AS text")


@query("pdf_sql_markdown", ORACLE["pdf_markdown"])
def pdf_sql_markdown(spark, sf_dir):
    return in_sql(spark, sf_dir, "pdf_markdown(content) AS markdown")


@query("pdf_sql_html", ORACLE["pdf_html"])
def pdf_sql_html(spark, sf_dir):
    return in_sql(spark, sf_dir, "pdf_html(content) AS html")


@query("pdf_sql_json", PLACED)
def pdf_sql_json(spark, sf_dir):
    """The JSON of every document, parsed again."""
    kind = "'version string, pages array<struct<lines:array<struct<text:string,x:double,y:double>>>>'"
    docs = in_sql(spark, sf_dir, f"from_json(pdf_json(content), {kind}).pages AS pages")
    pages = docs.select("doc_id", F.posexplode("pages").alias("p", "page"))
    lines = pages.select("doc_id", (F.col("p") + 1).alias("page_no"), F.posexplode("page.lines").alias("k", "l"))
    return lines.select("doc_id", "page_no", (F.col("k") + 1).alias("line_no"), "l.text", "l.x", "l.y")


@query("pdf_sql_inspect", f"""
SELECT doc_id, '1.7' AS version, max(page_no)::INT AS page_count, false AS encrypted, (2 * max(page_no) + 5)::BIGINT AS object_count,
       'Tïtle α' AS title, 'quire' AS creator, NULL::VARCHAR AS error_code FROM ({LINES}) GROUP BY doc_id""")
def pdf_sql_inspect(spark, sf_dir):
    found = in_sql(spark, sf_dir, "pdf_inspect(content) AS i", title="Tïtle α")
    return found.select("doc_id", *[f"i.{c}" for c in ("version", "page_count", "encrypted", "object_count", "title", "creator", "error_code")])


@query("pdf_windows", f"""
SELECT 1704067200 + 600 * (doc_id // 10) AS window_start, count(*)::BIGINT AS files, sum(pages)::BIGINT AS pages
FROM (SELECT doc_id, max(page_no) AS pages FROM ({LINES}) GROUP BY doc_id) GROUP BY doc_id // 10""")
def pdf_windows(spark, sf_dir):
    """Files and pages in windows of ten minutes, from a stream in which a document arrives every minute."""
    from quire.streaming.pdf import pages_per_window

    folder = shared_folder(spark)
    files = writer.write_texts(documents(spark, sf_dir)).withColumn("modificationTime", F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("doc_id")))
    files.write.parquet(f"{folder}/files")
    found = pages_per_window(spark.readStream.schema(files.schema).parquet(f"{folder}/files"))
    lean = found.select(F.unix_timestamp("window.start").alias("window_start"), "files", "pages")
    query_ = (
        lean.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/windows")).start()
    )
    query_.awaitTermination()
    return spark.read.schema(lean.schema).parquet(f"{folder}/windows")


@query("pdf_stream", PLACED)
def pdf_stream(spark, sf_dir):
    """The lines of all documents through a stream, which reads what is there and ends."""
    from quire.streaming.pdf import write_available

    folder = shared_folder(spark)
    files = writer.write_texts(documents(spark, sf_dir))
    files.write.parquet(f"{folder}/files")
    stream = spark.readStream.schema(files.schema).parquet(f"{folder}/files")
    write_available(lines_of(PdfFrames(stream)), f"{folder}/lines", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(lines_of(PdfFrames(files)).schema).parquet(f"{folder}/lines")
