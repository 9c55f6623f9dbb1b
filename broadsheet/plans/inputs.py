"""Inputs of the operators, derived from the driver's tables.

The tables hold no scanned pages, so lines of ``documents`` are laid out as newspaper sheets, and
``orders``, ``lineitem`` and ``events`` stand for jobs, pages and their log. Every derivation is a
row-wise expression (48 lines make a page, whatever the document's length), so it scales with the
tables and no page is large. The same derivations are given as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import SPACE, strip

PAGE_WIDTH, PAGE_HEIGHT = 2480, 3509
LINES_PER_PAGE = 48
PUBLICATIONS = ("한국일보", "국민일보", "서울신문", "news.example.com", "동네소식")
WEEKDAYS = ("월요일", "화요일", "수요일", "목요일", "금요일")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(({number}) % {len(values)} AS INT) + 1]"


# -- lines -----------------------------------------------------------------------------------

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty trimmed lines of the documents, numbered from 0."""
    split = F.filter(F.transform(F.split("text", "\n"), strip), lambda line: line != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", split.alias("ls"))
    return docs.select("doc_id", "lang", "source", F.posexplode("ls").alias("line_no", "line"))


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


LINES_SQL = f"""split_lines AS (
  SELECT doc_id, lang, source,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls
  FROM documents),
lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM split_lines)"""


# -- newspaper sheets ------------------------------------------------------------------------

def sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of newspaper sheets: four columns of twelve lines below a header."""
    src = lines(spark, sf_dir)
    d, n = F.col("doc_id"), F.col("line_no")
    page, slot = F.floor(n / LINES_PER_PAGE).cast("int") + 1, (n % LINES_PER_PAGE).cast("int")
    src = src.select("doc_id", "source", "line", "line_no", page.alias("page_no"), slot.alias("slot"),
                     F.floor(slot / 12).cast("int").alias("col"), (slot % 12).alias("row"))
    p, col, row = F.col("page_no"), F.col("col"), F.col("row")
    pictured = (d + p + col) % 3 == 0
    label = (F.when(row % 6 == 0, "title").when((row % 6 == 2) & pictured, "image")
             .when((row % 6 == 3) & pictured, "caption").otherwise("text"))
    x0 = (120 + col * 570 + (d + n * 7) % 15).cast("int")
    y0 = (420 + row * 250 + F.floor(row / 6) * 20).cast("int")
    height = F.when(label == "image", 180).otherwise(60 + F.least(F.length("line"), F.lit(120)))
    text = (F.when(label == "image", "")
            .when((row == 11) & ((d + col) % 2 == 0), F.concat(F.substring("line", 1, 12), F.lit(" 기자")))
            .otherwise(F.col("line")))
    confidence = F.round(0.5 + ((d * 13 + n * 7) % 50) / 100, 2)

    def block(seq, block_id, lab, box, words, conf) -> Column:
        parts = {"seq": seq.cast("int"), "block_id": block_id, "label": lab, "text": words, "confidence": conf}
        parts |= {side: v.cast("int") for side, v in zip(("x0", "y0", "x1", "y1"), box)}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    main = block(n + 2, F.concat(F.lit("b-"), n), label, (x0, y0, x0 + 500, y0 + height), text, confidence)
    fixed = [F.lit(v) for v in (120, 60, 520, 130, 900, 70, 1500, 125)]
    paper = block(F.lit(0), F.lit("h-0"), F.lit("header"), fixed[:4], _pick(PUBLICATIONS, d), F.lit(0.9))
    issue = block(F.lit(1), F.lit("h-1"), F.lit("header"), fixed[4:], issue_text(d, p), F.lit(0.9))
    blocks = F.when(F.col("slot") == 0, F.array(paper, issue, main)).otherwise(F.array(main))
    return src.select("doc_id", "page_no", F.explode(blocks).alias("b")).select(
        "doc_id", "page_no", F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), "b.*")


def issue_text(d: Column, p: Column) -> Column:
    """Issue lines in four shapes."""
    date = F.format_string("%d년 %d월 %d일", 2000 + d % 25, 1 + d % 12, 1 + (d + p) % 28)
    weekday = _pick(WEEKDAYS, d)
    number = p.cast("string")
    return (F.when((d + p) % 4 == 0, F.concat(date, F.lit(" "), weekday, F.lit(" "), number, F.lit("면 사회")))
            .when((d + p) % 4 == 1, date)
            .when((d + p) % 4 == 2, F.concat(F.lit("A"), number, F.lit("면 정치")))
            .otherwise(F.concat(date, F.lit(" "), weekday, F.lit(" "), number)))


def _sql_issue(d: str, p: str) -> str:
    date = f"printf('%d년 %d월 %d일', 2000 + {d} % 25, 1 + {d} % 12, 1 + ({d} + {p}) % 28)"
    weekday = _sql_pick(WEEKDAYS, d)
    return f"""CASE ({d} + {p}) % 4
      WHEN 0 THEN {date} || ' ' || {weekday} || ' ' || {p} || '면 사회'
      WHEN 1 THEN {date}
      WHEN 2 THEN 'A' || {p} || '면 정치'
      ELSE {date} || ' ' || {weekday} || ' ' || {p} END"""


SHEET_SQL = LINES_SQL + f""",
placed AS (
  SELECT doc_id, source, line, line_no, CAST(line_no // 48 + 1 AS INT) AS page_no, CAST(line_no % 48 AS INT) AS slot,
         CAST((line_no % 48) // 12 AS INT) AS col, CAST(line_no % 12 AS INT) AS row FROM lines),
labelled AS (
  SELECT *, CASE WHEN row % 6 = 0 THEN 'title'
                 WHEN row % 6 = 2 AND (doc_id + page_no + col) % 3 = 0 THEN 'image'
                 WHEN row % 6 = 3 AND (doc_id + page_no + col) % 3 = 0 THEN 'caption' ELSE 'text' END AS label,
         CAST(120 + col * 570 + (doc_id + line_no * 7) % 15 AS INT) AS x0,
         CAST(420 + row * 250 + (row // 6) * 20 AS INT) AS y0 FROM placed),
sheet AS (
  SELECT doc_id, page_no, CAST(line_no + 2 AS INT) AS seq, 'b-' || line_no AS block_id, label,
         CASE WHEN label = 'image' THEN ''
              WHEN row = 11 AND (doc_id + col) % 2 = 0 THEN left(line, 12) || ' 기자' ELSE line END AS text,
         round(0.5 + ((doc_id * 13 + line_no * 7) % 50) / 100, 2) AS confidence,
         x0, y0, x0 + 500 AS x1, CAST(y0 + CASE WHEN label = 'image' THEN 180 ELSE 60 + least(length(line), 120) END AS INT) AS y1,
         col, row
  FROM labelled
  UNION ALL
  SELECT doc_id, page_no, 0, 'h-0', 'header', {_sql_pick(PUBLICATIONS, 'doc_id')}, 0.9, 120, 60, 520, 130, -1, -1
  FROM placed WHERE slot = 0
  UNION ALL
  SELECT doc_id, page_no, 1, 'h-1', 'header', {_sql_issue('doc_id', 'page_no')}, 0.9, 900, 70, 1500, 125, -1, -1
  FROM placed WHERE slot = 0)"""


# -- jobs, files, pages, articles, logs ------------------------------------------------------

def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("job_"), (F.col("o_orderkey") % 5000).cast("string")).alias("job_key"),
        F.when(status == "F", "completed").when(status == "P", "completed_with_errors").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("requested_at"), F.col("o_orderpriority").alias("source_dir"),
        F.col("o_custkey").alias("owner_id"))


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, 'job_' || (o_orderkey % 5000) AS job_key,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'completed_with_errors' ELSE 'running' END AS status,
         o_orderdate AS requested_at, o_orderpriority AS source_dir, o_custkey AS owner_id FROM orders)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a page; its line number is the file within the job. The price makes its id unique."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("page_id"),
        (F.col("l_partkey") % 40 + 1).cast("int").alias("page_number"),
        F.when(line == "F", "parsed").when(flag == "R", "failed").otherwise("running").alias("status"),
        (F.col("l_quantity") % 4).cast("int").alias("n_articles"), F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("done_at"))


PAGES_SQL = """pages_t AS (
  SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS file_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS page_id,
         CAST(l_partkey % 40 + 1 AS INT) AS page_number,
         CASE WHEN l_linestatus = 'F' THEN 'parsed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'running' END AS status,
         CAST(l_quantity % 4 AS INT) AS n_articles, l_discount AS discount, l_extendedprice AS price,
         l_shipdate AS done_at FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file of a job; the status follows from its pages."""
    found = pages(spark, sf_dir).groupBy("job_id", "file_id").agg(
        F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "running").alias("open"),
        F.max("page_number").alias("page_count"), F.sum("price").alias("price"))
    status = (F.when(F.col("open") > 0, "running").when((F.col("bad") > 0), "completed_with_errors")
              .when(F.col("file_id") % 7 == 0, "skipped").otherwise("completed"))
    return found.select("job_id", "file_id", F.concat(F.lit("file-"), F.col("file_id"), F.lit(".pdf")).alias("file_name"),
                        status.alias("status"), "page_count")


FILES_SQL = PAGES_SQL + """,
files AS (
  SELECT job_id, file_id, 'file-' || file_id || '.pdf' AS file_name,
         CASE WHEN count(*) FILTER (WHERE status = 'running') > 0 THEN 'running'
              WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'completed_with_errors'
              WHEN file_id % 7 = 0 THEN 'skipped' ELSE 'completed' END AS status, max(page_number) AS page_count
  FROM pages_t GROUP BY job_id, file_id)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the pages, each with a score, a body length and up to two pictures."""
    p = pages(spark, sf_dir).where(F.col("n_articles") > 0)
    p = p.select("job_id", "file_id", "page_id", "page_number", "discount", "price", "n_articles",
                 F.explode(F.sequence(F.lit(1), F.col("n_articles"))).alias("article_order"))
    n = (F.floor(F.col("price")).cast("long") + F.col("article_order"))
    return p.select(
        "job_id", "file_id", "page_id", "page_number", "article_order",
        F.concat_ws("-", "page_id", "article_order").alias("article_id"),
        F.when(n % 9 == 0, F.lit("")).when(n % 9 == 1, F.lit("문화일보 사설")).otherwise(
            F.concat(F.lit("Article "), n.cast("string"))).alias("title"),
        (n % 700).cast("int").alias("body_length"), (n % 3).cast("int").alias("image_count"),
        F.when(n % 5 != 0, F.col("discount") * 10).alias("relevance_score"))


ARTICLES_SQL = PAGES_SQL + """,
article_numbers AS (
  SELECT *, unnest(range(1, n_articles + 1)) AS article_order FROM pages_t WHERE n_articles > 0),
articles AS (
  SELECT job_id, file_id, page_id, page_number, article_order, page_id || '-' || article_order AS article_id,
         CASE n % 9 WHEN 0 THEN '' WHEN 1 THEN '문화일보 사설' ELSE 'Article ' || n END AS title,
         CAST(n % 700 AS INT) AS body_length, CAST(n % 3 AS INT) AS image_count,
         CASE WHEN n % 5 <> 0 THEN discount * 10 END AS relevance_score
  FROM (SELECT *, CAST(floor(price) AS BIGINT) + article_order AS n FROM article_numbers))"""

# Processing stages in their order.
STAGES = ("scan", "render", "ocr_vl", "ocr_structure", "ocr_fallback", "ocr_retry", "cluster", "relevance", "crop", "persist")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a processing log: the user is the job, errors are failures."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind.isin("click", "view"), "running").otherwise("completed")
    step = F.when(F.col("event_id") % 11 == 10, "deliver").otherwise(_pick(STAGES, F.col("event_id")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("log_id"), F.col("ts").alias("created_at"),
        step.alias("step_name"), status.alias("status"), F.col("props").alias("message"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") * 10 + F.col("event_id") % 5).alias("file_id"), "value")


LOGS_SQL = f"""logs AS (
  SELECT user_id AS job_id, event_id AS log_id, ts AS created_at,
         CASE WHEN event_id % 11 = 10 THEN 'deliver' ELSE {_sql_pick(STAGES, 'event_id')} END AS step_name,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'completed' END AS status,
         props AS message, CASE WHEN event_id % 3 = 0 THEN user_id * 10 + event_id % 5 END AS file_id, value FROM events)"""
