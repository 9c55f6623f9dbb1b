"""Job, page, delivery and request reports over orders, line items, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.geometry import Box
from broadsheet.operators import delivery, reports
from broadsheet.operators import requests as rq
from broadsheet.plans import inputs
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import ARTICLES_SQL, FILES_SQL, JOBS_SQL, LOGS_SQL, PAGES_SQL, SHEET_SQL, articles, files, jobs, logs, pages, sheet_blocks, table
from broadsheet.plans.queries_text import _sql_display
from broadsheet.stages import staged

FINAL = "('completed', 'completed_with_errors', 'failed', 'skipped')"
FILE_FROM_PAGES = FILES_SQL[len(PAGES_SQL):]


@query("job_status", f"""WITH {JOBS_SQL}, {FILES_SQL}
SELECT j.job_id, j.status, count(f.file_id) FILTER (WHERE f.status IN {FINAL}) AS processed_files, count(f.file_id) AS total_files
FROM jobs j LEFT JOIN files f USING (job_id) GROUP BY 1, 2""")
def q_job_status(spark, sf_dir):
    return reports.job_status(jobs(spark, sf_dir), files(spark, sf_dir))


STATS_SQL = """stats AS (SELECT f.job_id, f.file_id, f.file_name, f.status, count(*) FILTER (WHERE p.status = 'parsed') AS parsed_pages,
  count(*) FILTER (WHERE p.status = 'failed') AS failed_pages, greatest(count(*), max(f.page_count)) AS page_count FROM files f JOIN pages_t p USING (file_id) GROUP BY 1, 2, 3, 4)"""


@query("file_page_stats", f"WITH {FILES_SQL}, {STATS_SQL} SELECT * FROM stats")
def q_file_page_stats(spark, sf_dir):
    return reports.file_page_stats(files(spark, sf_dir), pages(spark, sf_dir))


@query("article_counts_by_file", f"""WITH {ARTICLES_SQL}{FILE_FROM_PAGES}
SELECT f.file_id, count(a.article_id) AS article_count FROM files f LEFT JOIN articles a USING (file_id) GROUP BY 1""")
def q_article_counts_by_file(spark, sf_dir):
    return reports.article_counts(files(spark, sf_dir).select("file_id"), articles(spark, sf_dir), "file_id")


@query("article_counts_by_page", f"WITH {PAGES_SQL} SELECT page_id, n_articles AS article_count FROM pages_t")
def q_article_counts_by_page(spark, sf_dir):
    return reports.article_counts(pages(spark, sf_dir).select("page_id"), articles(spark, sf_dir), "page_id")


PERCENT = "CASE WHEN {t} > 0 THEN round({d} / {t} * 100, 1) WHEN {s} IN ('completed', 'completed_with_errors') THEN 100 ELSE 0 END"
ROLL_SQL = """roll AS (SELECT job_id, count(*) AS total_files, count(*) FILTER (WHERE status IN ('completed', 'skipped')) AS success_files,
  count(*) FILTER (WHERE status IN ('failed', 'completed_with_errors')) AS failed_files, count(*) FILTER (WHERE status <> 'running') AS processed_files FROM files GROUP BY job_id)"""


@query("job_rollup", f"""WITH {FILES_SQL}, {ROLL_SQL} SELECT job_id, success_files, failed_files, total_files,
  CASE WHEN failed_files > 0 AND success_files > 0 THEN 'completed_with_errors' WHEN failed_files > 0 THEN 'failed' ELSE 'completed' END AS status FROM roll""")
def q_job_rollup(spark, sf_dir):
    return reports.job_rollup(files(spark, sf_dir))


@query("job_detail", f"""WITH {JOBS_SQL}, {ARTICLES_SQL}{FILE_FROM_PAGES}, {STATS_SQL}, {ROLL_SQL},
st AS (SELECT job_id, sum(page_count) AS page_count, sum(parsed_pages) AS parsed_pages, sum(failed_pages) AS failed_pages FROM stats GROUP BY 1),
ac AS (SELECT job_id, count(*) AS article_count FROM articles GROUP BY 1)
SELECT j.job_id, j.status, coalesce(processed_files, 0) AS processed_files, coalesce(total_files, 0) AS total_files, coalesce(success_files, 0) AS success_files,
  coalesce(failed_files, 0) AS failed_files, coalesce(page_count, 0) AS page_count, coalesce(parsed_pages, 0) AS parsed_pages, coalesce(failed_pages, 0) AS failed_pages,
  coalesce(article_count, 0) AS article_count, {PERCENT.format(t='coalesce(total_files, 0)', d='processed_files', s='j.status')} AS progress_percent
FROM jobs j LEFT JOIN roll USING (job_id) LEFT JOIN st USING (job_id) LEFT JOIN ac USING (job_id)""")
def q_job_detail(spark, sf_dir):
    return reports.job_detail(jobs(spark, sf_dir), files(spark, sf_dir), pages(spark, sf_dir), articles(spark, sf_dir))


# -- article texts and sidecars --------------------------------------------------------------

def _n():
    return F.col("body_length")


def with_body(spark, sf_dir) -> DataFrame:
    return articles(spark, sf_dir).withColumn("body_text", F.concat(F.lit("body "), _n().cast("string")))


def sidecar(spark, sf_dir, k: int, name: str) -> DataFrame:
    """Corrections for every k-th body length, some of them blank."""
    a = articles(spark, sf_dir).where(_n() % k == 0)
    return a.select("article_id", F.when(_n() % (2 * k) == 0, F.lit("  ")).otherwise(F.concat(F.lit(name + " title "), _n().cast("string"))).alias("corrected_title"),
                    F.concat(F.lit(name + " body "), _n().cast("string")).alias("corrected_body_text"))


def _sql_side(k: int, name: str) -> str:
    return (f"(SELECT article_id, CASE WHEN body_length % {2 * k} = 0 THEN '  ' ELSE '{name} title ' || body_length END AS t, '{name} body ' || body_length AS b"
            f" FROM articles WHERE body_length % {k} = 0)")


def article_images(spark, sf_dir) -> DataFrame:
    a = articles(spark, sf_dir).where(F.col("image_count") > 0)
    rows = a.select("job_id", "article_id", "body_length", F.explode(F.sequence(F.lit(1), F.col("image_count"))).alias("image_order"))
    return rows.withColumn("image_path", F.concat_ws("/", "article_id", F.col("image_order").cast("string")))


def image_captions(spark, sf_dir) -> DataFrame:
    rows = article_images(spark, sf_dir).where(_n() % 4 > 0)
    rows = rows.withColumn("caption_order", F.explode(F.sequence(F.lit(1), _n() % 4)))
    return rows.select("article_id", "image_order", "caption_order", F.concat(F.lit("caption "), "caption_order", F.lit(" of "), _n().cast("string")).alias("caption"))


def states(spark, sf_dir) -> DataFrame:
    a = articles(spark, sf_dir).where(_n() % 5 < 3)
    return a.select(
        "article_id", F.when(_n() % 5 == 0, "failed").otherwise("delivered").alias("delivery_status"), F.when(_n() % 5 == 0, 400).otherwise(200).alias("response_code"),
        (_n() % 7 + 1).alias("request_batch_size"), F.when(_n() % 5 == 1, F.lit("{}")).alias("request_article"), _n().alias("attempted_at"))


STATES_SQL = """states AS (SELECT article_id, CASE WHEN body_length % 5 = 0 THEN 'failed' ELSE 'delivered' END AS delivery_status, CASE WHEN body_length % 5 = 0 THEN 400 ELSE 200 END AS response_code,
  body_length % 7 + 1 AS request_batch_size, CASE WHEN body_length % 5 = 1 THEN '{}' END AS request_article, body_length AS attempted_at FROM articles WHERE body_length % 5 < 3)"""


@query("job_result", f"""WITH {ARTICLES_SQL}, {STATES_SQL}, m AS {_sql_side(3, 'm')}
SELECT a.job_id, a.article_id, coalesce(nullif(trim(m.t), ''), a.title) AS title, coalesce(m.b, 'body ' || a.body_length) AS body_text, a.title AS original_title,
  nullif(trim(m.t), '') AS corrected_title, s.delivery_status, image_count AS n_images, CASE WHEN image_count > 0 THEN body_length % 4 * image_count ELSE 0 END AS n_captions
FROM articles a LEFT JOIN m USING (article_id) LEFT JOIN states s USING (article_id)""")
def q_job_result(spark, sf_dir):
    out = reports.job_result(with_body(spark, sf_dir), article_images(spark, sf_dir), image_captions(spark, sf_dir), sidecar(spark, sf_dir, 3, "m"),
                             states(spark, sf_dir).select("article_id", "delivery_status"))
    return out.select("job_id", "article_id", "title", "body_text", "original_title", "corrected_title", "delivery_status", F.size("images").alias("n_images"),
                      F.aggregate("images", F.lit(0), lambda acc, i: acc + F.size(i["captions"])).alias("n_captions"))


STAGE_ROWS = ", ".join(f"({i}, {q.lit(k)}, {q.lit(v)})" for i, (k, v) in enumerate(reports.STAGE_LABELS, start=1))
STAGE_SQL = f"""{LOGS_SQL}, stage(stage_no, stage_key, stage_label) AS (VALUES {STAGE_ROWS}), known AS (SELECT l.* FROM logs l JOIN stage ON stage_key = step_name),
latest AS (SELECT job_id, step_name, bool_or(status = 'failed') OVER (PARTITION BY job_id, step_name) AS ever, status, message, created_at FROM known
  QUALIFY row_number() OVER (PARTITION BY job_id, step_name ORDER BY created_at DESC, log_id DESC) = 1),
stages AS (SELECT j.job_id, stage_no, stage_key, stage_label, CASE WHEN l.status = 'completed' AND ever THEN 'completed_with_errors' ELSE coalesce(l.status, 'queued') END AS status,
  l.message, l.created_at AS updated_at FROM (SELECT DISTINCT job_id FROM known) j CROSS JOIN stage LEFT JOIN latest l ON l.job_id = j.job_id AND l.step_name = stage_key)"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("stage_progress", f"WITH {STAGE_SQL} SELECT * REPLACE ({STAMP.format('updated_at')} AS updated_at) FROM stages")
def q_stage_progress(spark, sf_dir):
    out = reports.stage_progress(logs(spark, sf_dir))
    return out.withColumn("updated_at", stamp("updated_at"))


def log_files(spark, sf_dir) -> DataFrame:
    """Files named in the log; the ones ending in 3 are running."""
    found = logs(spark, sf_dir).where(F.col("file_id").isNotNull()).select("job_id", "file_id").distinct()
    return found.select("job_id", "file_id", F.concat(F.lit("file-"), F.col("file_id"), F.lit(".pdf")).alias("file_name"),
                        F.when(F.col("file_id") % 10 == 3, "running").otherwise("completed").alias("status"))


LOG_FILES_SQL = """lf AS (SELECT DISTINCT job_id, file_id, 'file-' || file_id || '.pdf' AS file_name, CASE WHEN file_id % 10 = 3 THEN 'running' ELSE 'completed' END AS status
  FROM logs WHERE file_id IS NOT NULL)"""


@query("recent_logs", f"""WITH {LOGS_SQL}, {LOG_FILES_SQL}, top AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, log_id DESC) <= 20)
SELECT t.job_id, t.log_id, t.step_name, t.status, file_name, row_number() OVER (PARTITION BY t.job_id ORDER BY created_at, log_id) AS position FROM top t LEFT JOIN lf USING (file_id)""")
def q_recent_logs(spark, sf_dir):
    out = reports.recent_logs(logs(spark, sf_dir), log_files(spark, sf_dir), 20)
    return out.select("job_id", "log_id", "step_name", "status", "file_name", "position")


@query("job_activity", f"""WITH {STAGE_SQL}, {LOG_FILES_SQL},
act AS (SELECT * FROM logs WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, log_id DESC) = 1),
lat AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, log_id DESC) = 1),
stg AS (SELECT * FROM stages WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY stage_no) = 1),
run AS (SELECT job_id, arg_min(file_name, file_id) AS running_file FROM lf WHERE status = 'running' GROUP BY job_id)
SELECT lat.job_id, coalesce(act.status, CASE WHEN stg.job_id IS NOT NULL THEN 'running' END, lat.status) AS status,
  coalesce(act.step_name, stg.stage_key, lat.step_name) AS stage_key, CASE WHEN act.job_id IS NOT NULL THEN act.message WHEN stg.job_id IS NOT NULL THEN stg.message ELSE lat.message END AS message,
  coalesce(af.file_name, run.running_file, ltf.file_name) AS pdf_file
FROM lat LEFT JOIN act USING (job_id) LEFT JOIN stg USING (job_id) LEFT JOIN run USING (job_id) LEFT JOIN lf af ON af.file_id = act.file_id LEFT JOIN lf ltf ON ltf.file_id = lat.file_id""")
def q_job_activity(spark, sf_dir):
    log = logs(spark, sf_dir)
    return reports.job_activity(log, log_files(spark, sf_dir), reports.stage_progress(log)).drop("updated_at")


@query("recent_jobs", f"""WITH {JOBS_SQL}, {FILES_SQL}, {ROLL_SQL}, arts AS (SELECT DISTINCT job_key FROM jobs WHERE owner_id % 2 = 0),
vis AS (SELECT j.* FROM jobs j LEFT JOIN arts a USING (job_key) WHERE j.status = 'running' OR a.job_key IS NOT NULL),
top AS (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY job_key ORDER BY requested_at DESC, job_id DESC) = 1 ORDER BY requested_at DESC, job_id DESC LIMIT 12)
SELECT t.job_id, t.job_key, t.status, {PERCENT.format(t='coalesce(total_files, 0)', d='(success_files + failed_files)', s='t.status')} AS progress_percent FROM top t LEFT JOIN roll USING (job_id)""")
def q_recent_jobs(spark, sf_dir):
    j = jobs(spark, sf_dir)
    stored = j.where(F.col("owner_id") % 2 == 0).select("job_key")
    return reports.recent_jobs(j, files(spark, sf_dir), stored).select("job_id", "job_key", "status", "progress_percent")


@query("best_article", f"""WITH {ARTICLES_SQL}, d AS (SELECT *, {_sql_display('title')} AS shown FROM articles)
SELECT job_id, article_id FROM d QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY relevance_score IS NOT NULL DESC, floor(coalesce(relevance_score, -1) * 1000) DESC,
  body_length DESC, image_count DESC, CASE WHEN shown = '' OR (body_length <= 80 AND length(shown) <= 18) OR {q.has_any('lower(shown)', reports.HEADER_NAMES)} THEN -1 ELSE 0 END DESC,
  file_id, page_id, article_order) = 1""")
def q_best_article(spark, sf_dir):
    return reports.best_article(articles(spark, sf_dir), ["file_id", "page_id", "article_order"])


@query("job_browser", f"""WITH {ARTICLES_SQL}{FILE_FROM_PAGES}, a AS {_sql_side(5, 'a')}, e AS {_sql_side(3, 'e')},
s AS (SELECT x.*, coalesce(nullif({_sql_display("coalesce(a.t, '')")}, ''), nullif({_sql_display("coalesce(e.t, '')")}, ''), nullif({_sql_display('x.title')}, ''), 'Untitled') AS shown
  FROM articles x LEFT JOIN a USING (article_id) LEFT JOIN e USING (article_id))
SELECT s.job_id, s.file_id, f.file_name, f.status AS file_status, s.page_id, p.status AS page_status, count(*) AS article_count, string_agg(shown, '|' ORDER BY article_order) AS titles
FROM s JOIN files f USING (file_id) JOIN pages_t p USING (page_id) GROUP BY ALL""")
def q_job_browser(spark, sf_dir):
    out = reports.job_browser(files(spark, sf_dir).drop("job_id"), pages(spark, sf_dir), articles(spark, sf_dir), sidecar(spark, sf_dir, 5, "a"), sidecar(spark, sf_dir, 3, "e"), stage=staged)
    return out.select("job_id", "file_id", "file_name", "file_status", "page_id", "page_status", "article_count",
                      F.array_join(F.transform("articles", lambda a: a["title"]), "|").alias("titles"))


@query("article_detail", f"""WITH {ARTICLES_SQL}, m AS {_sql_side(7, 'm')}, a AS {_sql_side(5, 'a')}, e AS {_sql_side(3, 'e')},
l AS (SELECT page_id, lag(page_id) OVER w AS previous_page_id, lead(page_id) OVER w AS next_page_id FROM pages_t WINDOW w AS (PARTITION BY job_id ORDER BY file_id, page_number, page_id))
SELECT x.job_id, x.article_id, coalesce(nullif(trim(m.t), ''), nullif(trim(a.t), ''), nullif(trim(e.t), ''), x.title) AS corrected_title,
  coalesce(m.b, a.b, e.b, CASE WHEN x.body_length % 2 = 0 THEN 'body ' || x.body_length END, 'raw ' || x.body_length) AS corrected_body_text, previous_page_id, next_page_id
FROM articles x LEFT JOIN m USING (article_id) LEFT JOIN a USING (article_id) LEFT JOIN e USING (article_id) JOIN l USING (page_id)""")
def q_article_detail(spark, sf_dir):
    a = articles(spark, sf_dir)
    own = a.withColumn("body_text", F.when(_n() % 2 == 0, F.concat(F.lit("body "), _n().cast("string"))).otherwise(" "))
    raw = a.select("article_id", F.concat(F.lit("raw "), _n().cast("string")).alias("raw_text"))
    return reports.article_detail(own, pages(spark, sf_dir), sidecar(spark, sf_dir, 7, "m"), sidecar(spark, sf_dir, 5, "a"), sidecar(spark, sf_dir, 3, "e"), raw, stage=staged)


# -- pages -----------------------------------------------------------------------------------

def title_boxes(spark, sf_dir) -> DataFrame:
    """A tall box around each title, reaching over the blocks below it."""
    t = sheet_blocks(spark, sf_dir).where(F.col("label") == "title")
    return t.select("doc_id", "page_no", F.col("block_id").alias("article"), "x0", "y0", (F.col("x1") + 300).alias("x1"), (F.col("y1") + 700).alias("y1"))


@query("raw_text_in_box", f"""WITH {SHEET_SQL}, t AS (SELECT doc_id, page_no, block_id AS article, x0, y0, x1 + 300 AS x1, y1 + 700 AS y1 FROM sheet WHERE label = 'title')
SELECT t.doc_id, t.page_no, t.article, string_agg(s.text, chr(10) ORDER BY s.y0, s.x0, s.text) AS raw_text FROM t JOIN sheet s USING (doc_id, page_no)
WHERE s.text <> '' AND least(t.x1, s.x1) > greatest(t.x0, s.x0) AND least(t.y1, s.y1) > greatest(t.y0, s.y0) GROUP BY 1, 2, 3""")
def q_raw_text_in_box(spark, sf_dir):
    return reports.raw_text_in_box(sheet_blocks(spark, sf_dir), title_boxes(spark, sf_dir), "article")


@query("raw_items", f"WITH {SHEET_SQL} SELECT doc_id, page_no, x0, y0, x1, y1, text FROM sheet WHERE text <> ''")
def q_raw_items(spark, sf_dir):
    """Raw payloads: a parse list for even documents, parallel arrays for odd ones."""
    b = sheet_blocks(spark, sf_dir)
    listed = b.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("seq", F.array(*Box._fields).alias("box"), "text"))).alias("l"))
    items = F.transform("l", lambda i: F.struct(i["box"].alias("bbox"), i["text"].alias("content")))
    parallel = F.struct(F.transform("l", lambda i: i["text"]).alias("rec_texts"), F.transform("l", lambda i: i["box"]).alias("rec_boxes"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(items.alias("parsing_res_list")))).otherwise(F.to_json(F.struct(parallel.alias("overall_ocr_res"))))
    return reports.raw_items(listed.select("doc_id", "page_no", payload.alias("payload")))


@query("page_regions", f"""WITH {SHEET_SQL}, raw AS (
  SELECT doc_id, page_no, 'article' AS label, x0, y0, x1 + 300 AS x1, y1 + 700 AS y1, {q.squeeze(q.strip_markup('text'))} AS text, '#00B894' AS color FROM sheet WHERE label = 'title'
  UNION ALL SELECT doc_id, page_no, 'title', x0, y0, x1, y1, {q.squeeze(q.strip_markup('text'))}, '#FDCB6E' FROM sheet WHERE label = 'title'
  UNION ALL SELECT doc_id, page_no, 'image', x0, y0, x1, y1, 'article #1', '#0984E3' FROM sheet WHERE label = 'image'
  UNION ALL SELECT doc_id, page_no, label, x0, y0, x1, y1, text, '#E17055' FROM sheet WHERE label = 'header'),
k AS (SELECT *, x1 <= 1100 AND y1 <= 1100 AND x1 / 2480 <= 0.6 AND y1 / 3509 <= 0.6 AS s FROM raw)
SELECT doc_id, page_no, label, text, color, CAST(CASE WHEN s THEN round_even(x0 / 1000 * 2480, 0) ELSE x0 END AS INT) AS x0, CAST(CASE WHEN s THEN round_even(y0 / 1000 * 3509, 0) ELSE y0 END AS INT) AS y0,
  CAST(CASE WHEN s THEN least(2480, round_even(x1 / 1000 * 2480, 0)) ELSE least(2480, x1) END AS INT) AS x1,
  CAST(CASE WHEN s THEN least(3509, round_even(y1 / 1000 * 3509, 0)) ELSE least(3509, y1) END AS INT) AS y1 FROM k""")
def q_page_regions(spark, sf_dir):
    b = sheet_blocks(spark, sf_dir)
    t = b.where(F.col("label") == "title").withColumnsRenamed({"text": "title"} | {s: f"title_{s}" for s in Box._fields})
    arts = t.withColumns({"x0": F.col("title_x0"), "y0": F.col("title_y0"), "x1": F.col("title_x1") + 300, "y1": F.col("title_y1") + 700})
    out = reports.page_regions(arts, b.where(F.col("label") == "image").withColumn("article_order", F.lit("1")), b.where(F.col("label") == "header"))
    return out.drop("confidence")


# -- delivery --------------------------------------------------------------------------------

def sendable(spark, sf_dir) -> DataFrame:
    a = with_body(spark, sf_dir)
    return a.withColumns({
        "body_text": F.when(_n() % 10 == 0, " ").otherwise(F.repeat(F.concat("body_text", F.lit(" ")), 3)),
        "publication": F.when(_n() % 4 > 0, F.lit("  아주 긴 이름을 가진 지역 신문사의 발행물 이름")), "issue_date": F.when(_n() % 3 > 0, F.lit("2024-05-06")),
        "relevance_score": (F.col("relevance_score") * 100).cast("string")})


def image_sizes(spark, sf_dir) -> DataFrame:
    rows = article_images(spark, sf_dir).where(_n() % 6 > 0)
    return rows.select("image_path", F.when(_n() % 6 == 1, 11 * 1024 * 1024).otherwise(1000).alias("size_bytes"))


def captioned_images(spark, sf_dir) -> DataFrame:
    caps = F.array(F.lit("  a caption of some length "), F.lit(""), F.concat(F.lit("and more "), F.col("article_id")))
    return article_images(spark, sf_dir).withColumn("captions", caps)


IMAGES_SQL = """imgs AS (SELECT *, unnest(range(1, image_count + 1)) AS image_order FROM articles WHERE image_count > 0),
checked AS (SELECT article_id, image_order, CASE WHEN body_length % 6 = 0 THEN 'missing_file' WHEN body_length % 6 = 1 THEN 'too_large' END AS reason FROM imgs)"""
SEND_SQL = f"""{ARTICLES_SQL}, {IMAGES_SQL},
per AS (SELECT article_id, count(*) FILTER (WHERE reason IS NULL) AS inc, count(*) FILTER (WHERE reason IS NOT NULL) AS skip, max(reason) AS reason FROM checked GROUP BY 1),
p AS (SELECT a.*, trim(left(title, 30)) AS t, CASE WHEN body_length % 10 = 0 THEN '' ELSE trim(repeat('body ' || body_length || ' ', 3)) END AS b, body_length % 4 > 0 AS pub, body_length % 3 > 0 AS dated,
  coalesce(inc, 0) AS included_images, coalesce(skip, 0) AS skipped_images, reason FROM articles a LEFT JOIN per USING (article_id)),
v AS (SELECT *, list_filter([CASE WHEN t = '' THEN 'missing_title' END, CASE WHEN b = '' THEN 'missing_body' END, CASE WHEN NOT pub THEN 'missing_publication' END,
  CASE WHEN NOT dated THEN 'missing_issue_date' END, 'image_' || reason], lambda x: x IS NOT NULL) AS reasons FROM p),
sent AS (SELECT *, CASE WHEN t = '' OR b = '' THEN 'blocked' WHEN len(reasons) > 0 THEN 'warning' ELSE 'ready' END AS validation_status FROM v)"""


@query("prepare_delivery_images", f"""WITH {ARTICLES_SQL}, {IMAGES_SQL} SELECT article_id, image_order, reason IS NULL AS included, reason,
  trim(left('a caption of some length and more ' || article_id, 30)) AS caption, CASE WHEN reason IS NULL THEN image_order - 1 END AS included_index FROM checked""")
def q_prepare_delivery_images(spark, sf_dir):
    out = delivery.prepare_images(captioned_images(spark, sf_dir), image_sizes(spark, sf_dir))
    return out.select("article_id", "image_order", "included", "reason", "caption", "included_index")


def prepared(spark, sf_dir) -> DataFrame:
    return delivery.prepare_delivery(sendable(spark, sf_dir), captioned_images(spark, sf_dir), image_sizes(spark, sf_dir))


@query("prepare_delivery", f"""WITH {SEND_SQL} SELECT article_id, t AS title, b AS body_text, CASE WHEN pub THEN trim(left('아주 긴 이름을 가진 지역 신문사의 발행물 이름', 20)) ELSE '' END AS publication,
  CASE WHEN dated THEN '2024-05-06' ELSE '' END AS issue_date, included_images, skipped_images, validation_status, array_to_string(reasons, ',') AS reasons FROM sent""")
def q_prepare_delivery(spark, sf_dir):
    return prepared(spark, sf_dir).select("article_id", "title", "body_text", "publication", "issue_date", "included_images", "skipped_images", "validation_status",
                                          F.array_join("validation_reasons", ",").alias("reasons"))


@query("delivery_preview", f"""WITH {SEND_SQL}, s AS (SELECT job_id, count(*) FILTER (WHERE validation_status = 'ready') AS ready_count, count(*) FILTER (WHERE validation_status = 'warning') AS warning_count,
  count(*) FILTER (WHERE validation_status = 'blocked') AS blocked_count, count(*) AS article_count, sum(included_images) AS included_images, sum(skipped_images) AS skipped_images FROM sent GROUP BY 1),
r AS (SELECT job_id, string_agg(reason, ',' ORDER BY n DESC, reason) AS validation_summary FROM (SELECT job_id, reason, count(*) AS n FROM (SELECT job_id, unnest(reasons) AS reason FROM sent) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, reason) <= 8) GROUP BY 1)
SELECT s.*, CASE WHEN blocked_count > 0 THEN 'blocked' WHEN warning_count > 0 OR skipped_images > 0 THEN 'warning' ELSE 'ready' END AS delivery_status,
  coalesce(validation_summary, '') AS validation_summary FROM s LEFT JOIN r USING (job_id)""")
def q_delivery_preview(spark, sf_dir):
    return delivery.delivery_preview(prepared(spark, sf_dir)).withColumn("validation_summary", F.array_join("validation_summary", ","))


@query("delivery_request", f"""WITH {SEND_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_id, page_number, page_id, article_order) - 1 AS article_index FROM sent)
SELECT article_id, article_index, t AS title, included_images AS n_imgs, CASE WHEN included_images > 0 THEN 'file_' || article_index || '_' || (included_images - 1) END AS last_src FROM n""")
def q_delivery_request(spark, sf_dir):
    # Numbered before the pictures are joined, as files are counted from the articles alone.
    numbered = delivery.index_in_job(delivery.prepare_articles(sendable(spark, sf_dir)), ["page_number", "page_id", "article_order"])
    numbered = numbered.select("article_id", "article_index", "title", "body_text", "publication", "issue_date", "relevance_score")
    body = delivery.request_body(delivery.with_images(numbered, captioned_images(spark, sf_dir), image_sizes(spark, sf_dir), stage=staged))
    read = body.withColumn("read", F.from_json("request_article", "title string, imgs array<struct<src:string>>"))
    return read.select("article_id", "article_index", "read.title", F.size("read.imgs").alias("n_imgs"),
                       F.when(F.size("read.imgs") > 0, F.element_at("read.imgs", -1)["src"]).alias("last_src"))


def attempts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An attempt per page; batches of two or more get 400 for every third job and then single answers."""
    a = articles(spark, sf_dir)
    sizes = pages(spark, sf_dir).select("page_id", F.col("n_articles").alias("batch_size"))
    req = a.join(sizes, "page_id").select(
        F.col("page_id").alias("attempt_id"), "batch_size", (F.col("article_order") - 1).alias("article_index"), "article_id", F.lit("{}").alias("request_article"),
        F.col("job_id").alias("attempted_at"))
    code = F.when(F.col("job_id") % 3 == 0, 400).when(F.col("job_id") % 3 == 1, 500).otherwise(202)
    answered = pages(spark, sf_dir).where((F.col("n_articles") > 0) & (F.col("job_id") % 7 > 0))
    batch = answered.select(F.col("page_id").alias("attempt_id"), F.lit(None).cast("int").alias("article_index"), code.alias("response_code"),
                            F.when(F.col("job_id") % 3 == 0, "bad_title").alias("error_code"), F.lit("server busy").alias("response_text"))
    single = req.where((F.col("attempted_at") % 3 == 0) & (F.col("attempted_at") % 7 > 0) & (F.col("batch_size") > 1)).select(
        "attempt_id", "article_index", F.when(F.col("article_index") == 0, 200).otherwise(422).alias("response_code"), F.lit(None).cast("string").alias("error_code"), F.lit(" ").alias("response_text"))
    return req, batch.unionByName(single)


@query("delivery_ledger", f"""WITH {ARTICLES_SQL}, r AS (SELECT a.page_id AS attempt_id, a.n_articles, article_order - 1 AS idx, article_id, job_id FROM (SELECT x.*, y.n_articles FROM articles x JOIN pages_t y USING (page_id)) a),
c AS (SELECT *, job_id % 7 > 0 AND job_id % 3 = 0 AND n_articles > 1 AS alone, CASE WHEN job_id % 7 = 0 THEN 502 WHEN job_id % 3 = 0 AND n_articles > 1 THEN CASE WHEN idx = 0 THEN 200 ELSE 422 END
  WHEN job_id % 3 = 0 THEN 400 WHEN job_id % 3 = 1 THEN 500 ELSE 202 END AS code FROM r)
SELECT attempt_id, article_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'delivered' ELSE 'failed' END AS delivery_status, code AS response_code,
  CASE WHEN code BETWEEN 200 AND 299 THEN NULL WHEN code = 502 OR code = 422 THEN 'HTTP ' || code WHEN code = 400 THEN 'target rejected: bad_title' ELSE 'server busy' END AS last_error,
  CASE WHEN alone THEN 1 ELSE n_articles END AS request_batch_size, CASE WHEN alone THEN 0 ELSE idx END AS request_article_index FROM c""")
def q_delivery_ledger(spark, sf_dir):
    ledger = delivery.latest_delivery(delivery.delivery_ledger(*attempts(spark, sf_dir)))
    return ledger.select("attempt_id", "article_id", "delivery_status", "response_code", "last_error", "request_batch_size", "request_article_index")


@query("delivery_summary", f"""WITH {ARTICLES_SQL}, {STATES_SQL}, j AS (SELECT a.*, s.* EXCLUDE (article_id) FROM articles a LEFT JOIN states s USING (article_id)),
s AS (SELECT job_id, count(*) AS total_articles, count(*) FILTER (WHERE delivery_status = 'delivered') AS delivered_marks, count(*) FILTER (WHERE delivery_status = 'failed') AS failed_marks,
  count(request_article) AS verified_payload_count, max(request_batch_size) AS batch_size, max(attempted_at) AS updated_at FROM j GROUP BY 1)
SELECT *, total_articles - delivered_marks - failed_marks AS pending_marks, CASE WHEN delivered_marks = total_articles AND verified_payload_count = total_articles THEN 'stored payload is available for every article'
  WHEN delivered_marks = total_articles AND batch_size < total_articles AND verified_payload_count = 0 THEN 'legacy delivery record: articles are marked delivered, but the saved batch size is ' || batch_size
  WHEN failed_marks > 0 THEN failed_marks || ' article deliveries are marked failed' END AS note FROM s""")
def q_delivery_summary(spark, sf_dir):
    return delivery.delivery_summary(articles(spark, sf_dir), states(spark, sf_dir)).drop("response_code")


# -- requests --------------------------------------------------------------------------------

def requests(spark, sf_dir) -> DataFrame:
    """A conversation is a request; its turns are pages."""
    c, k = F.col("conv_id"), F.col("conv_id") % 8
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.timestamp_seconds(F.lit(1704067200) + c * 3600)
    return turns.select(
        F.format_string("r%06d", c).alias("request_id"), F.when(c % 2 == 0, "marker").otherwise("ocr").alias("request_kind"), (c % 3 == 0).alias("playground"),
        F.when(k == 0, "failed").when(k == 1, " Completed ").when(k == 7, "").otherwise("processing").alias("record_status"), F.when(k == 2, "processing").alias("result_status"),
        F.when(k == 3, True).when(k == 4, False).alias("success"), F.when(k == 5, "broken").alias("error"), (k == 6).alias("processing_complete"),
        F.lit(None).cast("string").alias("runtime_status"), F.lit(None).cast("string").alias("progress_status"), F.when(k == 2, F.col("n")).alias("processed_page_count"),
        F.col("n").alias("page_count"), F.when(c % 16 == 2, F.col("n")).otherwise(0).alias("stored_pages"), at.alias("created_at"),
        F.when(c % 5 > 0, at + F.expr("INTERVAL 10 MINUTES")).alias("updated_at"), F.when(c % 4 > 0, F.concat(F.lit("f"), c.cast("string"), F.lit(".pdf"))).alias("file_name"),
        F.concat(F.lit("src"), c.cast("string")).alias("source_file"))


REQ_SQL = """t AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY 1),
req AS (SELECT printf('r%06d', c) AS request_id, CASE WHEN c % 2 = 0 THEN 'marker' ELSE 'ocr' END AS request_kind, c, n,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c * 3600 + CASE WHEN c % 5 > 0 THEN 600 ELSE 0 END) AS touched,
  CASE c % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'complete' WHEN 3 THEN 'complete' WHEN 4 THEN 'failed' WHEN 5 THEN 'failed' WHEN 6 THEN 'complete'
    WHEN 2 THEN CASE WHEN c % 16 = 2 THEN 'complete' ELSE 'processing' END ELSE 'processing' END AS status FROM t)"""


@query("request_status", f"WITH {REQ_SQL} SELECT request_id, status FROM req")
def q_request_status(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("request_id", rq.request_status({f: F.col(f) for f in rq.STATUS_FIELDS}).alias("status"))


@query("request_history", f"""WITH {REQ_SQL} SELECT request_id, request_kind, status, CASE WHEN c % 4 > 0 THEN 'f' || c || '.pdf' ELSE 'src' || c END AS file_name, n AS page_count,
  (SELECT count(*) FROM req WHERE c % 2 = 0) AS total_count FROM req WHERE c % 2 = 0 ORDER BY touched DESC, request_id LIMIT 25""")
def q_request_history(spark, sf_dir):
    out = rq.request_history(requests(spark, sf_dir), limit=25, kind="marker")
    return out.select("request_id", "request_kind", "status", "file_name", "page_count", "total_count")


NOW = "2024-01-03 12:00:00"


@query("expired_requests", f"WITH {REQ_SQL} SELECT request_id FROM req WHERE touched <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND c % 8 IN (2, 3, 4, 5, 6)")
def q_expired_requests(spark, sf_dir):
    return rq.expired_requests(requests(spark, sf_dir), now=NOW, status="processing").select("request_id")


@query("remaining_requests", f"WITH {REQ_SQL} SELECT request_id FROM req WHERE touched > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def q_remaining_requests(spark, sf_dir):
    return rq.remaining_requests(requests(spark, sf_dir), now=NOW).select("request_id")


@query("progress_percent", f"""WITH {REQ_SQL} SELECT request_id, CASE WHEN n - c % 3 > 0 THEN round(least(c % 9, n - c % 3) / (n - c % 3) * 100, 1) WHEN status = 'complete' THEN 100 ELSE 0 END AS percent FROM req""")
def q_progress_percent(spark, sf_dir):
    r = requests(spark, sf_dir)
    c = F.substring("request_id", 2, 10).cast("long")
    status = rq.request_status({f: F.col(f) for f in rq.STATUS_FIELDS})
    return r.select("request_id", rq.progress_percent(c % 9, F.col("page_count") - c % 3, status).alias("percent"))


@query("list_jobs", f"WITH {JOBS_SQL} SELECT job_id, job_key, status FROM jobs")
def q_list_jobs(spark, sf_dir):
    return reports.list_jobs(jobs(spark, sf_dir).withColumnRenamed("requested_at", "created_at")).select("job_id", "job_key", "status")


@query("list_articles", f"WITH {ARTICLES_SQL} SELECT job_id, article_id, title FROM articles")
def q_list_articles(spark, sf_dir):
    a = articles(spark, sf_dir).join(jobs(spark, sf_dir).select("job_id", F.col("requested_at").alias("created_at")), "job_id")
    return reports.list_articles(a).select("job_id", "article_id", "title")
