"""Conversion, extraction, scoring and templates over sheets and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import convert as cv
from broadsheet.operators import extract as ex
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import LINES_SQL, SHEET_SQL, lines, sheet_blocks, table
from broadsheet.plans.queries_text import _sql_escape

PAGE = ["doc_id", "page_no"]
PT = f"""{SHEET_SQL}, pt AS (SELECT doc_id, page_no, coalesce(string_agg(CASE WHEN {q.strip('text')} <> '' THEN {q.strip('text')} END, chr(10) ORDER BY seq), '') AS page_text FROM sheet GROUP BY 1, 2)"""


def sheet_articles(spark, sf_dir) -> DataFrame:
    """A simple article per title of pages 1, 3, 5, ...: the title and the line below it."""
    b = sheet_blocks(spark, sf_dir).where(F.col("page_no") % 2 == 1)
    titles = b.where(F.col("label") == "title").select(*PAGE, F.col("seq").alias("article_order"), F.col("text").alias("title"))
    below = b.where(F.col("label") != "header").select(*PAGE, (F.col("seq") - 1).alias("article_order"), F.col("text").alias("body_text"))
    return titles.join(below, [*PAGE, "article_order"], "left").withColumn("body_text", F.coalesce("body_text", F.lit("")))


def whole_articles(blocks: DataFrame) -> DataFrame:
    """An article per title of every page: the title and all lines below it up to the next title, without headers."""
    above = F.count_if(F.col("label") == "title").over(Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    b = blocks.select(*PAGE, "seq", "label", "text").withColumn("article_order", above).where("article_order > 0 AND label <> 'header'")
    line = F.when((F.col("label") != "title") & (tx.strip(F.col("text")) != ""), F.struct("seq", F.col("text").alias("text")))
    lines_below = F.sort_array(F.collect_list(line))
    return b.groupBy(*PAGE, "article_order").agg(
        F.max(F.when(F.col("label") == "title", F.col("text"))).alias("title"), F.array_join(F.transform(lines_below, lambda x: x["text"]), "\n").alias("body_text"))


ART = f"""{PT}, art AS (SELECT t.doc_id, t.page_no, t.seq AS article_order, t.text AS title, coalesce(b.text, '') AS body FROM sheet t LEFT JOIN sheet b
  ON b.doc_id = t.doc_id AND b.page_no = t.page_no AND b.seq = t.seq + 1 AND b.label <> 'header' WHERE t.label = 'title' AND t.page_no % 2 = 1)"""
MD = f"""{ART}, ap AS (SELECT doc_id, page_no, string_agg('## ' || title || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END, chr(10) || chr(10) ORDER BY article_order) AS pieces FROM art GROUP BY 1, 2),
md AS (SELECT doc_id, page_no, '# Page ' || page_no || chr(10) || chr(10) || coalesce(pieces, page_text) AS page_markdown FROM pt LEFT JOIN ap USING (doc_id, page_no))"""


ART_ALL = f"""{PT}, numbered AS (SELECT doc_id, page_no, seq, label, text, count(*) FILTER (WHERE label = 'title') OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS article_order FROM sheet),
art AS (SELECT doc_id, page_no, article_order, coalesce({q.strip("max(CASE WHEN label = 'title' THEN text END)")}, '') AS title,
  coalesce({q.strip(f"string_agg(CASE WHEN label <> 'title' AND {q.strip('text')} <> '' THEN text END, chr(10) ORDER BY seq)")}, '') AS body
  FROM numbered WHERE article_order > 0 AND label <> 'header' GROUP BY 1, 2, 3)"""
MD_ALL = f"""{ART_ALL}, ap AS (SELECT doc_id, page_no, string_agg(concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN '## ' || title END, nullif(body, '')), chr(10) || chr(10) ORDER BY article_order)
  FILTER (WHERE title <> '' OR body <> '') AS pieces FROM art GROUP BY 1, 2),
md AS (SELECT doc_id, page_no, '# Page ' || page_no || chr(10) || chr(10) || coalesce(pieces, page_text) AS page_markdown FROM pt LEFT JOIN ap USING (doc_id, page_no))"""


@query("page_text", f"WITH {PT} SELECT * FROM pt")
def q_page_text(spark, sf_dir):
    return cv.page_text(sheet_blocks(spark, sf_dir))


@query("document_text", f"WITH {PT} SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS full_text FROM pt GROUP BY doc_id")
def q_document_text(spark, sf_dir):
    return cv.document_text(cv.page_text(sheet_blocks(spark, sf_dir)))


@query("page_markdown", f"WITH {MD} SELECT * FROM md")
def q_page_markdown(spark, sf_dir):
    return cv.page_markdown(cv.page_text(sheet_blocks(spark, sf_dir)), sheet_articles(spark, sf_dir))


@query("page_markdown_all", f"WITH {MD_ALL} SELECT * FROM md")
def q_page_markdown_all(spark, sf_dir):
    return cv.page_markdown(cv.page_text(sheet_blocks(spark, sf_dir)), whole_articles(sheet_blocks(spark, sf_dir)))


HTML = f"""{SHEET_SQL}, hb AS (SELECT *, ' class=''block block-' || label || ''' data-block-id=''' || block_id || '''' AS attr, {_sql_escape('text')} AS e FROM sheet),
hp AS (SELECT doc_id, page_no, '<section data-page=''' || page_no || '''><h2>Page ' || page_no || '</h2>' || string_agg(CASE label WHEN 'title' THEN '<h3' || attr || '>' || e || '</h3>'
  WHEN 'image' THEN '<figure' || attr || '></figure>' ELSE '<p' || attr || '>' || e || '</p>' END, '' ORDER BY seq) || '</section>' AS page_html FROM hb GROUP BY 1, 2)"""


@query("page_html", f"WITH {HTML} SELECT * FROM hp")
def q_page_html(spark, sf_dir):
    return cv.page_html(sheet_blocks(spark, sf_dir), block_ids=True)


@query("join_pages_markdown", f"""WITH {MD} SELECT doc_id, string_agg(CASE WHEN page_no > 1 THEN page_no || repeat('-', 48) || chr(10) || chr(10) ELSE '' END || page_markdown, chr(10) || chr(10) ORDER BY page_no)
  AS document_markdown FROM md GROUP BY doc_id""")
def q_join_pages_markdown(spark, sf_dir):
    pages = cv.page_markdown(cv.page_text(sheet_blocks(spark, sf_dir)), sheet_articles(spark, sf_dir))
    return cv.join_pages(pages, "page_markdown", paginate=True)


@query("join_pages_markdown_all", f"""WITH {MD_ALL} SELECT doc_id, string_agg(CASE WHEN page_no > 1 THEN page_no || repeat('-', 48) || chr(10) || chr(10) ELSE '' END || page_markdown, chr(10) || chr(10) ORDER BY page_no)
  AS document_markdown FROM md GROUP BY doc_id""")
def q_join_pages_markdown_all(spark, sf_dir):
    pages = cv.page_markdown(cv.page_text(sheet_blocks(spark, sf_dir)), whole_articles(sheet_blocks(spark, sf_dir)))
    return cv.join_pages(pages, "page_markdown", paginate=True)


@query("join_pages_html", f"""WITH {HTML} SELECT doc_id, '<html><body>' || string_agg(CASE WHEN page_no > 1 THEN '<hr data-page-break=''' || page_no || '''/>' ELSE '' END || page_html, '' ORDER BY page_no)
  || '</body></html>' AS document_html FROM hp GROUP BY doc_id""")
def q_join_pages_html(spark, sf_dir):
    return cv.join_pages(cv.page_html(sheet_blocks(spark, sf_dir), block_ids=True), "page_html", paginate=True, html=True)


CHUNK_MD = "CASE label WHEN 'title' THEN '## ' || text WHEN 'caption' THEN '*' || text || '*' WHEN 'header' THEN '*' || text || '*' ELSE text END"


@query("chunks", f"WITH {SHEET_SQL} SELECT s.doc_id, page_no, block_id, label, s.text, {CHUNK_MD.replace('text', 's.text')} AS markdown, source || '.pdf' AS file_name FROM sheet s JOIN documents d USING (doc_id)")
def q_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("file_name"))
    return cv.chunks(sheet_blocks(spark, sf_dir), files, markdown=True).select(*PAGE, "block_id", "label", "text", "markdown", "file_name")


@query("convert", f"""WITH {MD}, c AS (SELECT doc_id, count(*) AS n_chunks FROM sheet GROUP BY 1)
SELECT doc_id, string_agg(page_markdown, chr(10) || chr(10) ORDER BY page_no) AS markdown, max(n_chunks) AS n_chunks FROM md JOIN c USING (doc_id) GROUP BY doc_id""")
def q_convert(spark, sf_dir):
    out = cv.convert(sheet_blocks(spark, sf_dir), sheet_articles(spark, sf_dir), "markdown, chunks")
    return out.select("doc_id", "markdown", F.json_array_length("chunks").alias("n_chunks"))


@query("convert_all", f"""WITH {MD_ALL}, c AS (SELECT doc_id, count(*) AS n_chunks FROM sheet GROUP BY 1)
SELECT doc_id, string_agg(page_markdown, chr(10) || chr(10) ORDER BY page_no) AS markdown, max(n_chunks) AS n_chunks FROM md JOIN c USING (doc_id) GROUP BY doc_id""")
def q_convert_all(spark, sf_dir):
    out = cv.convert(sheet_blocks(spark, sf_dir), whole_articles(sheet_blocks(spark, sf_dir)), "markdown, chunks")
    return out.select("doc_id", "markdown", F.json_array_length("chunks").alias("n_chunks"))


@query("ocr_lines", f"WITH {SHEET_SQL} SELECT doc_id, page_no, seq, text, x0, y0, x1, y1, label, confidence FROM sheet WHERE label <> 'image'")
def q_ocr_lines(spark, sf_dir):
    return cv.ocr_lines(sheet_blocks(spark, sf_dir))


def page_sizes(spark, sf_dir) -> DataFrame:
    return sheet_blocks(spark, sf_dir).select(*PAGE, "width", "height").distinct()


CROPS = f"""{SHEET_SQL}, crop AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS image_order, block_id, x0, y0, x1, least(y1, 3509) - y0 AS crop_height FROM sheet WHERE label = 'image'),
named AS (SELECT *, printf('page-%04d-image-%04d.png', page_no, image_order) AS name FROM crop)"""


@query("crop_manifest", f"""WITH {CROPS} SELECT doc_id, page_no, 'crop' AS kind, image_order, 500 AS crop_width, crop_height, name FROM named
UNION ALL SELECT DISTINCT doc_id, page_no, 'page', 0, 2480, 3509, printf('page-%04d.png', page_no) FROM sheet""")
def q_crop_manifest(spark, sf_dir):
    """Every picture is given twice; its crop counts once."""
    b = sheet_blocks(spark, sf_dir)
    twice = b.unionByName(b.where(F.col("label") == "image").withColumn("seq", F.col("seq") + 1000))
    return cv.crop_manifest(page_sizes(spark, sf_dir), twice).select(*PAGE, "kind", "image_order", "crop_width", "crop_height", "name")


@query("export_markdown", f"""WITH {CROPS}, r AS (SELECT s.*, n.name FROM sheet s LEFT JOIN named n USING (doc_id, page_no, block_id))
SELECT doc_id, page_no, '# Page ' || page_no || chr(10) || chr(10) || '![Page ' || page_no || '](images/' || printf('page-%04d.png', page_no) || ')' || chr(10) || chr(10)
  || string_agg(CASE label WHEN 'image' THEN '![Page ' || page_no || ' image](images/' || name || ')' ELSE {CHUNK_MD} END, chr(10) || chr(10) ORDER BY seq) AS export_markdown FROM r GROUP BY 1, 2""")
def q_export_markdown(spark, sf_dir):
    return cv.export_markdown(page_sizes(spark, sf_dir), sheet_blocks(spark, sf_dir))


@query("export_html", f"""WITH {CROPS}, r AS (SELECT s.*, n.name, {_sql_escape('text')} AS e, ' data-block-id="' || block_id || '">' AS attr FROM sheet s LEFT JOIN named n USING (doc_id, page_no, block_id))
SELECT doc_id, page_no, '<section class="page" data-page="' || page_no || '"><h1>Page ' || page_no || '</h1>' || string_agg(CASE label
  WHEN 'image' THEN '<figure class="block-image"><img src="images/' || name || '"></figure>' WHEN 'title' THEN '<h2 class="block block-title"' || attr || e || '</h2>'
  WHEN 'caption' THEN '<p class="block block-caption block-caption"' || attr || e || '</p>' WHEN 'header' THEN '<p class="block block-caption block-header"' || attr || e || '</p>'
  ELSE '<p class="block block-text"' || attr || e || '</p>' END, '' ORDER BY seq) || '</section>' AS export_html FROM r GROUP BY 1, 2""")
def q_export_html(spark, sf_dir):
    return cv.export_html(page_sizes(spark, sf_dir), sheet_blocks(spark, sf_dir))


@query("export_blocks_text", f"""WITH {SHEET_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS n FROM sheet)
SELECT doc_id, page_no, 'Page ' || page_no || chr(10) || string_agg('  ' || printf('%02d', n) || '. ' || label || ' bbox=[' || x0 || ', ' || y0 || ', ' || x1 || ', ' || y1 || '] ' || text, chr(10) ORDER BY seq) AS blocks_text
FROM n GROUP BY 1, 2""")
def q_export_blocks_text(spark, sf_dir):
    return cv.export_blocks_text(sheet_blocks(spark, sf_dir))


@query("segment_document", f"""WITH {ART}, p AS (SELECT doc_id, count(*) AS page_count, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS full_text FROM pt GROUP BY 1), a AS (SELECT doc_id, count(*) AS n FROM art GROUP BY 1)
SELECT doc_id, page_count, full_text, coalesce(n, 0) AS total_articles FROM p LEFT JOIN a USING (doc_id)""")
def q_segment_document(spark, sf_dir):
    return cv.segment_document(sheet_blocks(spark, sf_dir), sheet_articles(spark, sf_dir))


@query("segment_document_all", f"""WITH {ART_ALL}, p AS (SELECT doc_id, count(*) AS page_count, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) AS full_text FROM pt GROUP BY 1), a AS (SELECT doc_id, count(*) AS n FROM art GROUP BY 1)
SELECT doc_id, page_count, full_text, coalesce(n, 0) AS total_articles FROM p LEFT JOIN a USING (doc_id)""")
def q_segment_document_all(spark, sf_dir):
    return cv.segment_document(sheet_blocks(spark, sf_dir), whole_articles(sheet_blocks(spark, sf_dir)))


def collections(spark, sf_dir) -> DataFrame:
    """A collection per order: its parts and one file that does not exist."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("collection_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("file_ids")).withColumn(
        "file_ids", F.when(F.col("collection_id") % 4 == 0, F.concat("file_ids", F.array(F.lit(-1).cast("bigint")))).otherwise(F.col("file_ids")))


@query("batch_run", """WITH m AS (SELECT l_orderkey AS c, count(DISTINCT l_suppkey) AS n, count(DISTINCT CASE WHEN l_suppkey % 10 > 0 THEN l_suppkey END) AS ok FROM lineitem GROUP BY 1)
SELECT c AS collection_id, ok AS success_count, n - ok + CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS failure_count,
  CASE WHEN n - ok + CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM m""")
def q_batch_run(spark, sf_dir):
    results = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 10 > 0).select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("result"))
    return cv.batch_run(collections(spark, sf_dir), results)[1]


# -- schemas and extraction ------------------------------------------------------------------

@query("infer_schema", """SELECT 'o_custkey' AS name, 'o custkey' AS label, 'integer' AS type, true AS required UNION ALL SELECT 'price', 'Price', 'number', true
UNION ALL SELECT 'day', 'Day', 'date', true UNION ALL SELECT 'open', 'open', 'boolean', true UNION ALL SELECT 'status', 'status', 'string', true
UNION ALL SELECT 'rare', 'rare', 'integer', false WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) > 0""")
def q_infer_schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    opened = (F.col("o_orderstatus") == "O").cast("string")
    text = F.concat(
        F.lit('{"o custkey":'), F.col("o_custkey").cast("string"), F.lit(',"Price":'), F.format_string("%.2f", "o_totalprice"), F.lit(',"Day":"'), F.date_format("o_orderdate", "yyyy.M.d"),
        F.lit('","open":'), F.when(F.col("o_orderkey") % 5 == 0, "null").otherwise(opened), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"'),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(',"rare":'), F.col("o_orderkey").cast("string"))).otherwise(""), F.lit("}"))
    return ex.infer_schema(o.select(text.alias("json")))


@query("schema_from_names", f"""SELECT coalesce(nullif({q.sub(q.sub("lower(p_name || ' ' || p_brand)", '[^0-9a-z_]+', '_'), '^_+|_+$', '')}, ''), 'field') AS name, p_name || ' ' || p_brand AS label,
  'string' AS type, false AS required FROM part""")
def q_schema_from_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("label"))
    return ex.schema_from_names(names)


@query("schema_from_sample", f"""WITH {LINES_SQL}, f(name, k) AS (VALUES ('document_date', 0), ('unit_name', 1), ('document_id', 2), ('title', -1), ('summary', -1))
SELECT doc_id, line_no, name FROM lines, f WHERE k = -1 OR (k < 2 AND line_no % 3 = k) OR (k = 2 AND (line_no % 3 = 2 OR regexp_matches(line, '(?i)(문서번호|보고번호|ID)')))""")
def q_schema_from_sample(spark, sf_dir):
    n = F.col("line_no") % 3
    extra = F.when(n == 0, " 2024/5/6").when(n == 1, " 제3사단").otherwise(" 보고번호")
    # Digits that look like a date are not in the documents, other words may be.
    docs = lines(spark, sf_dir).select("doc_id", "line_no", F.concat("line", extra).alias("text"))
    return ex.schema_from_sample(docs).select("doc_id", "line_no", "name")


FIELDS = [
    {"name": "priority", "label": "우선순위", "type": "string"}, {"name": "total", "label": "합계", "type": "number"}, {"name": "customer", "label": "", "type": "integer", "pattern": r"cust=(\d+)"},
    {"name": "report_number", "label": "", "type": "integer"}, {"name": "issue_date", "label": "", "type": "date"}, {"name": "unit_name", "label": "", "type": "string"},
    {"name": "phone", "label": "", "type": "string"}, {"name": "author", "label": "", "type": "string"}, {"name": "title", "label": "", "type": "string"},
    {"name": "summary", "label": "", "type": "string"}, {"name": "approved", "label": "", "type": "boolean"}, {"name": "other", "label": "", "type": "string"}, {"name": "amount", "label": "", "type": "integer"}]


def records(spark, sf_dir) -> DataFrame:
    """Order forms as text, with gaps, from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.concat_ws(
        "\n", F.lit("  주문 기록"), F.concat(F.lit("우선순위: "), "o_orderpriority"), F.when(k % 2 == 0, F.concat(F.lit("합계 ： "), F.floor("o_totalprice").cast("string"), F.lit(".5"))),
        F.when(k % 3 == 0, F.concat(F.lit("CUST="), c)), F.when(k % 4 == 0, F.concat(F.lit("문서번호: A-"), c)), F.when(k % 5 == 0, F.concat(F.lit("일자 "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 접수"))),
        F.when(k % 3 == 1, F.concat(F.lit("제"), c, F.lit("사단 소속"))), F.when(k % 4 == 1, F.concat(F.lit("전화 02-555-"), F.format_string("%04d", k % 10000))),
        F.when(k % 5 == 1, F.concat(F.lit("작성자: 홍길동 "), c)), F.when(k % 4 == 2, F.lit("승인 yes 완료")))
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), text.alias("full_text"), F.when(k % 3 == 0, F.concat(F.lit("제목 "), c)).alias("article_title"), F.when(k % 3 == 1, F.concat(F.lit(" 표제 "), c)).alias("title_block"),
        F.when(k % 2 == 1, F.lit(" 본문 ")).alias("article_body"))


_TEXT = """concat_ws(chr(10), '  주문 기록', '우선순위: ' || o_orderpriority, CASE WHEN k % 2 = 0 THEN '합계 ： ' || CAST(floor(o_totalprice) AS BIGINT) || '.5' END, CASE WHEN k % 3 = 0 THEN 'CUST=' || o_custkey END,
  CASE WHEN k % 4 = 0 THEN '문서번호: A-' || o_custkey END, CASE WHEN k % 5 = 0 THEN '일자 ' || strftime(o_orderdate, '%Y-%m-%d') || ' 접수' END, CASE WHEN k % 3 = 1 THEN '제' || o_custkey || '사단 소속' END,
  CASE WHEN k % 4 = 1 THEN '전화 02-555-' || printf('%04d', k % 10000) END, CASE WHEN k % 5 = 1 THEN '작성자: 홍길동 ' || o_custkey END, CASE WHEN k % 4 = 2 THEN '승인 yes 완료' END)"""


def _row(name: str, *cases: str, last: str) -> str:
    whens = []
    for i in range(3):
        whens.append("CASE " + " ".join(f"WHEN {c.split(' => ')[0]} THEN {c.split(' => ')[1].split(' ; ')[i]}" for c in cases) + f" ELSE {last.split(' ; ')[i]} END")
    return f"SELECT k AS doc_id, '{name}' AS name, {whens[0]} AS value, {whens[1]} AS source, {whens[2]} AS confidence FROM o"


_LAST = "'주문 기록' ; 'first_line' ; 0.35"
_FIRST_NUMBER = "CAST(CAST(trunc(CAST(regexp_extract(t, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)) AS BIGINT) AS VARCHAR) ; 'number_regex' ; 0.76"
_EXTRACT = " UNION ALL ".join([
    _row("priority", "true => o_orderpriority ; 'label' ; 0.92", last=_LAST),
    _row("total", "k % 2 = 0 => 'total' ; 'label' ; 0.92", last="'total' ; 'number_regex' ; 0.76"),
    _row("customer", "k % 3 = 0 => CAST(o_custkey AS VARCHAR) ; 'pattern' ; 0.96", last=_FIRST_NUMBER),
    _row("report_number", "k % 4 = 0 => 'A-' || o_custkey ; 'id_regex' ; 0.88", last=_FIRST_NUMBER),
    _row("issue_date", "k % 5 = 0 => strftime(o_orderdate, '%Y-%m-%d') ; 'date_regex' ; 0.87", last=_LAST),
    _row("unit_name", "k % 3 = 1 => '제' || o_custkey || '사단' ; 'unit_regex' ; 0.82", last=_LAST),
    _row("phone", "k % 4 = 1 => '02-555-' || printf('%04d', k % 10000) ; 'phone_regex' ; 0.9", last=_LAST),
    _row("author", "k % 5 = 1 => '홍길동 ' || o_custkey ; 'author_regex' ; 0.84", last=_LAST),
    _row("title", "k % 3 = 0 => '제목 ' || o_custkey ; 'article_title' ; 0.9", "k % 3 = 1 => '표제 ' || o_custkey ; 'title_block' ; 0.88", last=_LAST),
    _row("summary", "k % 2 = 1 => '본문' ; 'article_body' ; 0.74", last=f"{q.strip('left(t, 500)')} ; 'full_text' ; 0.62"),
    _row("approved", "k % 4 = 2 => 'true' ; 'boolean_regex' ; 0.78", last="'false' ; 'first_line' ; 0.35"),
    _row("other", "false => '' ; '' ; 0", last=_LAST), _row("amount", "false => '' ; '' ; 0", last=_FIRST_NUMBER)])


@query("extract_fields", f"WITH o AS (SELECT *, o_orderkey AS k, replace({_TEXT.replace('k %', 'o_orderkey %')}, chr(13), '') AS t FROM orders) {_EXTRACT}")
def q_extract_fields(spark, sf_dir):
    out = ex.extract_fields(records(spark, sf_dir), FIELDS)
    # A number's printed form differs between engines; that it was read is what counts here.
    value = F.when((F.col("name") == "total") & F.col("value").try_cast("double").isNotNull(), "total").otherwise(F.col("value"))
    return out.select("doc_id", "name", value.alias("value"), "source", "confidence")


@query("cast_field", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN '1' END AS as_integer,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 0.5 WHEN 3 THEN 1 END AS as_number, CASE WHEN o_orderkey % 4 = 3 THEN 'true' ELSE 'false' END AS as_boolean FROM orders""")
def q_cast_field(spark, sf_dir):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" 0"), c)).when(k == 1, F.concat(c, F.lit(".5"))).when(k == 2, "n/a").otherwise(F.lit(" 1 "))
    return table(spark, sf_dir, "orders").select("o_orderkey", ex.cast_field(raw, "integer").alias("as_integer"),
                                                 ex.cast_field(raw, "number").cast("double").alias("as_number"), ex.cast_field(raw, "boolean").alias("as_boolean"))


# -- scoring, versions, templates ------------------------------------------------------------

def long_fields(spark, sf_dir, shift: int) -> DataFrame:
    """Fields of each customer in long form; another shift changes or drops some."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    fields = F.array(
        F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("nation").alias("field"), (F.col("c_nationkey") + F.when(k % 3 == 0, shift).otherwise(0)).cast("string").alias("value")),
        F.struct(F.lit("segment").alias("field"), F.when(k % 4 < 3 - shift, F.col("c_mktsegment")).alias("value")),
        F.struct(F.when((k % 5 == 0) & F.lit(shift == 1), "extra").otherwise("balance").alias("field"), F.col("c_acctbal").cast("string").alias("value")))
    return c.select(k.alias("record_id"), F.explode(fields).alias("f")).select("record_id", "f.*")


@query("score_extraction", """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN c_custkey % 4 = 2 THEN 0 ELSE 1 END AS g FROM customer)
SELECT k AS record_id, round(CASE WHEN k % 5 = 0 THEN (2 + n + g) / 6 ELSE (2 + n + g + 1) / 5 END, 4) AS overall_score FROM s""")
def q_score_extraction(spark, sf_dir):
    return ex.score_extraction(long_fields(spark, sf_dir, 0), long_fields(spark, sf_dir, 1), {"name": 2.0})


@query("score_extraction_text")
def q_score_extraction_text(spark, sf_dir):
    """Neighbouring turns of a conversation scored against each other by matching blocks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    left = c.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    right = c.select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("record_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return ex.score_extraction(left, right)


@query("field_similarity", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN o_custkey = o_orderkey THEN 1 ELSE 0 END WHEN 4 THEN 1 ELSE 0.5 END AS similarity FROM orders""")
def q_field_similarity(spark, sf_dir):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    left = F.when(k == 1, "x").when(k == 2, F.concat(c, F.lit(".0"))).when(k == 3, c).when(k == 4, F.concat(F.lit(" "), "o_orderpriority")).when(k == 5, "ABxx")
    right = F.when(k == 2, c).when(k == 3, F.col("o_orderkey").cast("string")).when(k == 4, F.col("o_orderpriority")).when(k == 5, "abyy")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", left.alias("l"), right.alias("r"))
    return pairs.select("o_orderkey", ex.field_similarity(F.col("l"), F.col("r")).alias("similarity"))


@query("changed_fields", """WITH s AS (SELECT c_custkey AS k, list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'balance' END, CASE WHEN c_custkey % 5 = 0 THEN 'extra' END, CASE WHEN c_custkey % 3 = 0 THEN 'nation' END,
  CASE WHEN c_custkey % 4 = 2 THEN 'segment' END], lambda x: x IS NOT NULL) AS f FROM customer) SELECT k AS record_id, array_to_string(f, ',') AS changed FROM s WHERE len(f) > 0""")
def q_changed_fields(spark, sf_dir):
    out = ex.changed_fields(long_fields(spark, sf_dir, 0), long_fields(spark, sf_dir, 1))
    return out.select("record_id", F.array_join("changed_fields", ",").alias("changed"))


@query("keys_union", """SELECT c_custkey AS record_id, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['name', 'nation', 'segment', 'balance', 'extra'] ELSE ['name', 'nation', 'segment', 'balance'] END) AS field FROM customer""")
def q_keys_union(spark, sf_dir):
    return ex.keys_union(long_fields(spark, sf_dir, 0), long_fields(spark, sf_dir, 1))


@query("text_diff")
def q_text_diff(spark, sf_dir):
    """Each turn of a conversation against the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("after"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("after").alias("before"))
    return ex.text_diff(c.join(before, ["conv_id", "turn"])).select("conv_id", "turn", "diff", "similarity")


@query("fill_template", """SELECT c_custkey AS record_id, 'Name=' || c_name || ' / ' || CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment ELSE 'None' END || ' {{ Missing Key }} '
  || c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' {{extra}}' END AS filled, CASE WHEN c_custkey % 5 = 0 THEN 'missing_key' ELSE 'extra,missing_key' END AS missing FROM customer""")
def q_fill_template(spark, sf_dir):
    v = long_fields(spark, sf_dir, 1).withColumn("position", F.lit(1))
    v = v.withColumn("value", F.when(F.col("field") == "extra", "").otherwise(F.col("value")))
    recs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.when(
        F.col("c_custkey") % 5 == 0, F.lit("Name={{ NAME }} / {{segment}} {{ Missing Key }} {{ nation }}{{extra}}")).otherwise(
        F.lit("Name={{ NAME }} / {{segment}} {{ Missing Key }} {{ nation }} {{extra}}")).alias("template"))
    return ex.fill_template(recs, v).select("record_id", "filled", F.array_join("missing_fields", ",").alias("missing"))
