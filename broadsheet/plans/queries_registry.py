"""Source files, registry, bundles, captions, annotations and the folder watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators import annotations as an
from broadsheet.operators import delivery, registry
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import ARTICLES_SQL, articles, table
from broadsheet.plans.queries_reports import _sql_side, article_images, image_captions, sidecar
from broadsheet.sources import bundles, captions, files, sinks

SUFFIXES = (".pdf", ".PNG", ".jpeg", ".tif", ".json", ".md", "", ".bin")


def source_files(spark, sf_dir) -> DataFrame:
    """A document is a file; its text are the bytes."""
    d = F.col("doc_id")
    name = F.concat(F.lit("doc"), F.format_string("%09d", d), F.coalesce(*[F.when(d % 8 == i, s) for i, s in enumerate(SUFFIXES)]))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), name).alias("path"), F.col("text").cast("binary").alias("content"), F.length("text").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + d * 3600).alias("mtime"))


FILES_SQL = f"""f AS (SELECT doc_id, text, '/in/' || source || '/doc' || printf('%09d', doc_id) || CASE doc_id % 8 {' '.join(f"WHEN {i} THEN {q.lit(s)}" for i, s in enumerate(SUFFIXES))} END AS path,
  sha256(text) AS content_hash, length(text) AS size, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 3600) AS mtime FROM documents)"""


@query("content_hash", f"WITH {FILES_SQL} SELECT doc_id, content_hash FROM f")
def q_content_hash(spark, sf_dir):
    return source_files(spark, sf_dir).select("doc_id", files.content_hash(F.col("content")).alias("content_hash"))


@query("file_checks", f"""WITH {FILES_SQL} SELECT doc_id, size, epoch_us(mtime) AS mtime_us, strftime(mtime, '%Y-%m-%d') AS file_date,
  CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'json' WHEN 5 THEN 'text' ELSE 'binary' END AS kind FROM f""")
def q_file_checks(spark, sf_dir):
    fp = files.file_fingerprint(F.col("size"), F.col("mtime"))
    return source_files(spark, sf_dir).select(
        "doc_id", fp["size"].alias("size"), fp["mtime_us"].alias("mtime_us"), files.resolve_file_date(F.col("mtime")).cast("string").alias("file_date"),
        files.detect_file_kind(F.col("path")).alias("kind"))


@query("validate_payload_header", f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'empty request body' WHEN doc_id % 8 = 0 AND doc_id % 5 > 1 THEN 'request body is not a PDF'
  WHEN doc_id % 8 > 2 THEN 'only these file types are supported: .jpeg, .jpg, .pdf, .png, .webp' END AS refused FROM f""")
def q_validate_payload_header(spark, sf_dir):
    """PDF marks at the start, within the probe, beyond it, nowhere; and empty files."""
    k = F.col("doc_id") % 5
    content = (F.when(k == 0, F.concat(F.lit("%PDF-1.7"), F.col("text"))).when(k == 1, F.concat(F.repeat(F.lit(" "), 900), F.lit("%PDF-"), F.col("text")))
               .when(k == 2, F.concat(F.repeat(F.lit(" "), 1100), F.lit("%PDF-"))).when(k == 3, F.col("text")).otherwise("").cast("binary"))
    f = source_files(spark, sf_dir).withColumn("text", F.col("content").cast("string"))
    return f.select("doc_id", files.validate_payload_header(F.col("path"), content).alias("refused"))


def hashed(spark, sf_dir) -> DataFrame:
    return source_files(spark, sf_dir).select("doc_id", "path", files.content_hash(F.col("content")).alias("content_hash"), F.col("size").alias("file_size"))


@query("plan_ingest", f"""WITH {FILES_SQL}, done AS (SELECT DISTINCT content_hash FROM f WHERE doc_id % 9 = 0)
SELECT doc_id, CASE WHEN f.content_hash IN (SELECT content_hash FROM done) OR row_number() OVER (PARTITION BY content_hash ORDER BY path) > 1 THEN 'duplicate_hash' END AS skip_reason FROM f""")
def q_plan_ingest(spark, sf_dir):
    f = hashed(spark, sf_dir)
    old = f.where(F.col("doc_id") % 9 == 0).withColumn("status", F.when(F.col("doc_id") % 2 == 0, "completed").otherwise("completed_with_errors"))
    return registry.plan_ingest(f, registry.completed_hashes(old)).select("doc_id", "skip_reason")


@query("register_files", f"""WITH {FILES_SQL}, n AS (SELECT DISTINCT '/in/' || source AS source_path, sha256(d.text) AS file_hash, min(doc_id % 4) = 0 AS known FROM documents d GROUP BY 1, 2)
SELECT source_path, file_hash, NOT known AS created FROM n""")
def q_register_files(spark, sf_dir):
    """A folder of a source keeps one row per text; every fourth document is known already."""
    found = hashed(spark, sf_dir).select(F.regexp_extract("path", "^(/in/[^/]+)/", 1).alias("source_path"), F.col("content_hash").alias("file_hash"), "file_size", "doc_id")
    known = found.where(F.col("doc_id") % 4 == 0)
    return registry.register_files(known, found).select("source_path", "file_hash", "created")


# -- status and placeholders -----------------------------------------------------------------

@query("update_job_status", """SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'queued' WHEN 3 THEN 'failed' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 10 WHEN o_orderkey % 5 = 0 THEN 99 END AS started_at, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 99 WHEN 2 THEN NULL WHEN 3 THEN 99 ELSE 50 END AS completed_at,
  CASE WHEN o_orderkey % 5 = 3 THEN 'boom' END AS error_message FROM orders""")
def q_update_job_status(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    state = o.select(k.alias("job_id"), F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, 10).alias("started_at"), F.lit(50).alias("completed_at"),
                     F.lit(50).alias("updated_at"), F.lit(None).cast("string").alias("error_message"))
    new = F.when(k % 5 == 0, "processing").when(k % 5 == 1, "completed").when(k % 5 == 2, "queued").otherwise("failed")
    changes = o.where(k % 5 < 4).select(k.alias("job_id"), new.alias("new_status"), F.when(k % 5 == 3, "boom").alias("error_message"), F.lit(99).alias("changed_at"))
    return registry.update_job_status(state, changes).drop("updated_at")


@query("update_article_status", """SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 4 < 3 THEN 'done' ELSE 'new' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'pending' WHEN 2 THEN 'sent' ELSE 'sent' END AS delivery_status, CASE o_orderkey % 4 WHEN 0 THEN 99 WHEN 1 THEN NULL WHEN 2 THEN 99 ELSE 10 END AS delivered_at FROM orders""")
def q_update_article_status(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    state = o.select(k.alias("article_id"), F.lit("new").alias("status"), F.lit("sent").alias("delivery_status"), F.lit(10).alias("delivered_at"))
    changes = o.where(k % 4 < 3).select(k.alias("article_id"), F.lit("done").alias("new_status"), F.when(k % 4 == 0, "sent").when(k % 4 == 1, "pending").alias("new_delivery_status"),
                                        F.lit(99).alias("changed_at"))
    return registry.update_article_status(state, changes)


@query("ensure_placeholders", """WITH w AS (SELECT o_orderkey AS job_id, unnest(range(1, o_orderkey % 4 + 1)) AS sequence_no FROM orders)
SELECT job_id, sequence_no, CASE WHEN sequence_no = 2 THEN 'ready' ELSE 'pending' END AS status, sequence_no <> 2 AS created FROM w""")
def q_ensure_placeholders(spark, sf_dir):
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    existing = j.select("job_id", F.lit(2).alias("sequence_no"), F.lit("ready").alias("status"))
    return registry.ensure_placeholders(j, (F.col("job_id") % 4).cast("int"), existing)


# -- folder watch ----------------------------------------------------------------------------

def scans(spark, sf_dir) -> DataFrame:
    """A user is a path, a six-hour slot a scan; the day's number of events gives the size."""
    e = table(spark, sf_dir, "events")
    slot = F.floor((F.unix_timestamp("ts") - 1704067200) / 21600)
    seen = e.select((F.col("user_id") % 40).alias("u"), slot.alias("scan_id"), "event_id").groupBy("u", "scan_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("scan_id", F.concat(F.lit("/watch/"), F.col("u").cast("string"), F.lit(".pdf")).alias("path"), (F.floor(F.col("scan_id") / (3 + F.col("u") % 5))).alias("size"),
                       F.lit(1).cast("long").alias("mtime_ns"))


@query("stable_files", """WITH s AS (SELECT DISTINCT user_id % 40 AS u, CAST(floor((epoch(ts) - 1704067200) / 21600) AS BIGINT) AS scan_id FROM events),
f AS (SELECT '/watch/' || u || '.pdf' AS path, scan_id, scan_id // (3 + u % 5) AS size FROM s),
g AS (SELECT *, lag(scan_id) OVER w AS ps, lag(size) OVER w AS pz FROM f WINDOW w AS (PARTITION BY path ORDER BY scan_id)),
r AS (SELECT *, sum(CASE WHEN ps = scan_id - 1 AND pz = size THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY scan_id) AS run FROM g)
SELECT scan_id, path, size, 1 AS mtime_ns FROM r QUALIFY row_number() OVER (PARTITION BY path, run ORDER BY scan_id) = 3""")
def q_stable_files(spark, sf_dir):
    return registry.stable_files(scans(spark, sf_dir))


# -- bundles ---------------------------------------------------------------------------------

def bundle_rows(spark, sf_dir) -> DataFrame:
    a = articles(spark, sf_dir)
    return a.select(
        (F.col("job_id") % 500).alias("_j"), F.concat(F.lit("job_2024"), F.format_string("%02d", 1 + F.col("job_id") % 12), F.lit("05_"), (F.col("job_id") % 500).cast("string")).alias("job_key"),
        F.concat(F.lit("file-"), F.col("file_id"), F.lit(".pdf")).alias("pdf_file"), (F.col("page_number") - 1).alias("page_number"), "article_order", "article_id", "title", F.col("job_id").alias("mtime"))


BUNDLE_SQL = f"""{ARTICLES_SQL}, b AS (SELECT job_id % 500 AS j, 'job_2024' || printf('%02d', 1 + job_id % 12) || '05_' || (job_id % 500) AS job_key, 'file-' || file_id || '.pdf' AS pdf_file,
  page_number - 1 AS page_number, article_order, article_id, title, job_id AS mtime FROM articles)"""


@query("import_archive", f"""WITH {BUNDLE_SQL}, dirs AS (SELECT job_key, max(mtime) AS m FROM b GROUP BY 1 ORDER BY m DESC, job_key LIMIT 24), fresh AS (SELECT * FROM dirs WHERE m % 3 > 0),
p AS (SELECT job_key, pdf_file, page_number, count(*) AS n FROM b JOIN fresh USING (job_key) WHERE page_number > 0 GROUP BY 1, 2, 3)
SELECT job_key, count(DISTINCT pdf_file) AS total_files, count(*) AS total_pages, sum(n) AS total_articles, substr(job_key, 5, 4) || '-' || substr(job_key, 9, 2) || '-05' AS requested_date FROM p GROUP BY 1""")
def q_import_archive(spark, sf_dir):
    b = bundle_rows(spark, sf_dir)
    known = b.groupBy("job_key").agg(F.max("mtime").alias("m")).where(F.col("m") % 3 == 0)
    found, _ = bundles.import_archive(b, known, limit=24)
    return found.select("job_key", "total_files", "total_pages", "total_articles", F.col("requested_date").cast("string").alias("requested_date"))


@query("import_archive_all", f"""WITH {BUNDLE_SQL}, dirs AS (SELECT job_key, max(mtime) AS m FROM b GROUP BY 1), fresh AS (SELECT * FROM dirs WHERE m % 3 > 0),
p AS (SELECT job_key, pdf_file, page_number, count(*) AS n FROM b JOIN fresh USING (job_key) WHERE page_number > 0 GROUP BY 1, 2, 3)
SELECT job_key, count(DISTINCT pdf_file) AS total_files, count(*) AS total_pages, sum(n) AS total_articles, substr(job_key, 5, 4) || '-' || substr(job_key, 9, 2) || '-05' AS requested_date FROM p GROUP BY 1""")
def q_import_archive_all(spark, sf_dir):
    b = bundle_rows(spark, sf_dir)
    known = b.groupBy("job_key").agg(F.max("mtime").alias("m")).where(F.col("m") % 3 == 0)
    found, _ = bundles.import_archive(b, known)
    return found.select("job_key", "total_files", "total_pages", "total_articles", F.col("requested_date").cast("string").alias("requested_date"))


@query("bundle_path", f"""WITH {BUNDLE_SQL} SELECT article_id, job_key || '/' || {q.slug("regexp_replace(pdf_file, '[.]pdf$', '')", '0-9A-Za-z._-', '-', '-._', 'document')} || printf('/parsed/page_%04d/article_%02d_', page_number, article_order)
  || {q.slug('left(title, 80)', '0-9A-Za-z._-', '-', '-._', 'document')} AS path FROM b""")
def q_bundle_path(spark, sf_dir):
    return bundle_rows(spark, sf_dir).select("article_id", sinks.bundle_path(
        F.col("job_key"), F.col("pdf_file"), F.col("page_number"), F.col("article_order"), F.col("title")).alias("path"))


@query("page_manifest", f"""WITH {BUNDLE_SQL} SELECT job_key, pdf_file, page_number, count(*) AS article_count, string_agg(article_id, ',' ORDER BY article_order, article_id) AS articles FROM b GROUP BY 1, 2, 3""")
def q_page_manifest(spark, sf_dir):
    out = sinks.page_manifest(bundle_rows(spark, sf_dir).withColumn("bundle_dir", F.lit("")))
    return out.select("job_key", "pdf_file", "page_number", "article_count", F.array_join(F.transform("articles", lambda a: a["article_id"]), ",").alias("articles"))


@query("article_markdown", f"""WITH {ARTICLES_SQL} SELECT article_id, '# ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || chr(10) || chr(10) || '- PDF: a.pdf' || chr(10) || '- Page: ' || page_number || chr(10) || '- Article: ' || article_order
  || chr(10) || chr(10) || 'first ' || body_length || chr(10) || chr(10) || 'second' || CASE WHEN image_count > 0 THEN chr(10) || chr(10) || '## Images' || chr(10) || chr(10) || '![i.png](images/' || body_length || '.png)'
    || chr(10) || 'Caption: c ' || body_length WHEN body_length % 2 = 0 THEN chr(10) || chr(10) || '## Captions' || chr(10) || chr(10) || 'c ' || body_length ELSE '' END || chr(10) AS markdown FROM articles""")
def q_article_markdown(spark, sf_dir):
    n = F.col("body_length").cast("string")
    caps = F.array(F.lit(" "), F.concat(F.lit(" c "), n))
    image = F.struct(F.lit("i.png").alias("file_name"), F.concat(F.lit("images\\"), n, F.lit(".png")).alias("relative_path"), caps.alias("captions"))
    a = articles(spark, sf_dir).select(
        "article_id", "page_number", "article_order", "title", F.concat(F.lit(" first "), n, F.lit("\r\n \n second\n")).alias("body"),
        F.when(F.col("image_count") > 0, F.array(image)).otherwise(F.filter(F.array(image), lambda i: F.lit(False))).alias("images"),
        F.when(F.col("body_length") % 2 == 0, caps).otherwise(F.array().cast("array<string>")).alias("captions"))
    return a.select("article_id", sinks.article_markdown(F.lit("a.pdf"), F.col("page_number"), F.col("article_order"), F.col("title"), F.col("body"), F.col("images"), F.col("captions")).alias("markdown"))


@query("load_article_metadata", f"""WITH {ARTICLES_SQL}, e AS {_sql_side(3, 'e')} SELECT article_id, coalesce(CASE WHEN body_length % 2 = 0 THEN 'own' END, e.t) AS corrected_title, e.b AS corrected_body_text FROM articles LEFT JOIN e USING (article_id)""")
def q_load_article_metadata(spark, sf_dir):
    own = articles(spark, sf_dir).select("article_id", F.when(F.col("body_length") % 2 == 0, "own").alias("corrected_title"), F.lit(None).cast("string").alias("corrected_body_text"))
    return bundles.load_article_metadata(own, sidecar(spark, sf_dir, 3, "e"), ("corrected_title", "corrected_body_text"))


@query("read_state_sidecars", f"""WITH {ARTICLES_SQL} SELECT article_id, CASE WHEN body_length % 4 = 0 THEN 'demo' WHEN body_length % 3 = 0 THEN 'live' END AS delivery_status,
  CASE WHEN body_length % 5 = 0 THEN 'annotation' WHEN body_length % 6 = 0 THEN 'model' WHEN body_length % 7 = 0 THEN 'bundle' ELSE 'ocr' END AS correction_source FROM articles""")
def q_read_state_sidecars(spark, sf_dir):
    a, n = articles(spark, sf_dir), F.col("body_length")

    def part(k: int, value: str, name: str) -> DataFrame:
        return a.where(n % k == 0).select("article_id", F.lit(value).alias(name))

    meta = a.select("article_id", F.when(n % 7 == 0, "bundle").otherwise(" ").alias("correction_source"))
    out = bundles.read_state_sidecars(meta, part(6, "model", "correction_source"), part(4, "demo", "delivery_status"), part(3, "live", "delivery_status"), part(5, "x", "note"))
    return out.select("article_id", "delivery_status", "correction_source")


# -- captions --------------------------------------------------------------------------------

def raw_captions(spark, sf_dir) -> DataFrame:
    """Captions of pictures as stored: one under another name, one twice, one blank."""
    n = F.col("body_length").cast("string")
    box = F.concat(F.lit("["), F.concat_ws(",", n, F.lit("10"), (F.col("body_length") + 50).cast("string"), F.lit("60")), F.lit("]"))
    text = F.concat(F.lit('[{"text":" a '), n, F.lit(' ","bbox":'), box, F.lit(',"confidence":0.5},{"content":"a '), n, F.lit('","bbox":'), box,
                    F.lit('},{"text":"","content":"b"},{"text":" "}]'))
    return article_images(spark, sf_dir).select("article_id", F.col("image_order").alias("position"), F.when(F.col("image_order") == 1, 0).otherwise(F.col("image_order")).alias("image_order"), text.alias("captions"))


IMGS = f"{ARTICLES_SQL}, i AS (SELECT article_id, body_length AS n, unnest(range(1, image_count + 1)) AS image_order FROM articles WHERE image_count > 0)"


@query("normalize_captions", f"""WITH {IMGS} SELECT article_id, image_order, 'a ' || n AS caption, CAST(round_even(n / 1000 * 2480, 0) AS INT) AS x0, CAST(round_even((n + 50) / 1000 * 2480, 0) AS INT) AS x1, 0.5 AS confidence FROM i
UNION ALL SELECT article_id, image_order, 'b', NULL, NULL, NULL FROM i""")
def q_normalize_captions(spark, sf_dir):
    out = captions.normalize_captions(raw_captions(spark, sf_dir), F.lit(2480), F.lit(3509))
    return out.select("article_id", "image_order", "caption", "x0", "x1", "confidence")


@query("captions_by_image", f"WITH {IMGS} SELECT article_id, image_order, 'a ' || n || '|b' AS captions FROM i")
def q_captions_by_image(spark, sf_dir):
    maps = captions.captions_by_image(captions.normalize_captions(raw_captions(spark, sf_dir)))
    return maps.select("article_id", F.explode("captions").alias("image_order", "c")).select("article_id", "image_order", F.array_join("c", "|").alias("captions"))


@query("flatten_captions", f"WITH {IMGS} SELECT DISTINCT article_id, 'a ' || n AS caption FROM i UNION ALL SELECT DISTINCT article_id, 'b' FROM i")
def q_flatten_captions(spark, sf_dir):
    return captions.flatten_captions(captions.normalize_captions(raw_captions(spark, sf_dir))).select("article_id", "caption")


@query("join_captions", f"""WITH {ARTICLES_SQL}, i AS (SELECT article_id, body_length AS n, unnest(range(1, image_count + 1)) AS image_order FROM articles WHERE image_count > 0 AND body_length % 4 > 0)
SELECT article_id, image_order, trim(left(array_to_string(list_transform(range(1, n % 4 + 1), lambda x: 'caption ' || x || ' of ' || n), ' '), 30)) AS caption FROM i""")
def q_join_captions(spark, sf_dir):
    per = image_captions(spark, sf_dir).groupBy("article_id", "image_order").agg(F.sort_array(F.collect_list(F.struct("caption_order", "caption"))).alias("c"))
    return per.select("article_id", "image_order", delivery.join_captions(F.transform("c", lambda c: c["caption"])).alias("caption"))


# -- annotations -----------------------------------------------------------------------------

def annotated(spark, sf_dir) -> DataFrame:
    """Labelled documents as articles with review payloads in six shapes."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("title "), d.cast("string")).alias("title"), F.concat(F.lit("body "), d.cast("string")).alias("body_text"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    n = d.cast("string")
    status = F.when(F.col("quality") == 1, "accepted").otherwise("rejected")
    payload = (
        F.when(d % 6 == 0, F.concat(F.lit('{"status":"'), status, F.lit('"}')))
        .when(d % 6 == 1, F.concat(F.lit('{"status":"'), status, F.lit('","corrected_title":null,"title_bbox":null,"tags":" a, b ,"}')))
        .when(d % 6 == 2, F.concat(F.lit('{"status":"'), status, F.lit('","article_regions":[{"bbox":[1,2,'), n, F.lit(',40],"text":" p1 "},[5,1,9,99],{"text":"p2"},{"text":" "}],"tags":["x"," "]}')))
        .when(d % 6 == 3, F.lit('{"status":"odd","corrected_title":" new ","title_regions":[]}'))
        .when(d % 6 == 4, F.concat(F.lit('{"status":"'), status, F.lit('","corrected_body_text":"fixed","article_bbox":[9,8,7,6]}'))))
    return rows.select(d.alias("article_id"), "source", F.col("title"), "body_text", F.lit("[10,10,110,30]").alias("title_bbox"), F.concat(F.lit("[10,10,"), n, F.lit(".9,500]")).alias("article_bbox"),
                       F.lit(" Kim/Lee ").alias("reviewer"), payload.alias("payload"))


ANN_SQL = """x AS (SELECT d.doc_id AS d, source, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS st FROM labels l JOIN documents d USING (doc_id)),
ann AS (SELECT d AS article_id, source, CASE WHEN d % 6 IN (3, 5) THEN 'pending' ELSE st END AS status, CASE d % 6 WHEN 1 THEN '' WHEN 3 THEN 'new' ELSE 'title ' || d END AS corrected_title,
  CASE d % 6 WHEN 2 THEN 'p1' || chr(10) || chr(10) || 'p2' WHEN 4 THEN 'fixed' ELSE 'body ' || d END AS corrected_body_text, CASE d % 6 WHEN 1 THEN NULL ELSE '10,10,110,30' END AS title_bbox,
  CASE d % 6 WHEN 2 THEN least(1, d) || ',1,' || greatest(d, 9, 1) || ',99' WHEN 4 THEN '7,6,9,8' ELSE least(10, d) || ',10,' || greatest(10, d) || ',500' END AS article_bbox,
  CASE d % 6 WHEN 1 THEN 'a|b' WHEN 2 THEN 'x' ELSE '' END AS tags FROM x)"""


@query("normalize_annotations", f"WITH {ANN_SQL} SELECT article_id, 'Kim_Lee' AS reviewer, status, corrected_title, corrected_body_text, title_bbox, article_bbox, tags FROM ann")
def q_normalize_annotations(spark, sf_dir):
    out = an.normalize_annotations(annotated(spark, sf_dir))
    return out.select("article_id", "reviewer", "status", "corrected_title", "corrected_body_text", F.array_join("title_bbox", ",").alias("title_bbox"),
                      F.array_join("article_bbox", ",").alias("article_bbox"), F.array_join("tags", "|").alias("tags"))


@query("latest_annotation", """SELECT event_type AS reviewer, user_id AS article_id, arg_max(event_id, event_id) AS payload FROM events GROUP BY 1, 2""")
def q_latest_annotation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("reviewer"), F.col("user_id").alias("article_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("payload"))
    return an.latest_annotation(e).select("reviewer", "article_id", "payload")


def label_records(spark, sf_dir) -> DataFrame:
    a = annotated(spark, sf_dir)
    d = F.col("article_id")
    return a.select("article_id", F.concat(F.lit("job_202401"), F.format_string("%02d", 1 + d % 20), F.lit("_"), (d % 3).cast("string")).alias("job_key"), F.col("source").alias("pdf_slug"),
                    F.col("article_id").alias("page_number"), F.lit(1).alias("article_order"))


@query("training_rows", f"""WITH {ANN_SQL}, r AS (SELECT *, 'job_202401' || printf('%02d', 1 + article_id % 20) || '_' || (article_id % 3) AS job_key FROM ann),
n AS (SELECT *, row_number() OVER (ORDER BY job_key, source, article_id) AS position FROM r)
SELECT article_id, position, CASE WHEN corrected_title <> '' AND title_bbox IS NOT NULL THEN 'recognition_title/title_' || printf('%06d', position) || '.png' END AS title_path,
  'document_article/article_' || printf('%06d', position) || '.png' AS article_path FROM n WHERE status = 'accepted'""")
def q_training_rows(spark, sf_dir):
    out = an.training_rows(label_records(spark, sf_dir), an.normalize_annotations(annotated(spark, sf_dir)))
    return out.select("article_id", "position", "title_path", "article_path")


# -- collections -----------------------------------------------------------------------------

def _collections(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("collection_id"), F.array(c, c + 1, c + 2).alias("file_ids"))


@query("collection_add", "SELECT c_custkey AS collection_id, c_custkey || ',' || (c_custkey + 1) || ',' || (c_custkey + 2) || ',' || (c_custkey + 9) AS files FROM customer")
def q_collection_add(spark, sf_dir):
    c = F.col("collection_id")
    out = an.collection_add(_collections(spark, sf_dir), F.array(c + 2, c + 9, c + 9))
    return out.select("collection_id", F.array_join("file_ids", ",").alias("files"))


@query("collection_remove", "SELECT c_custkey AS collection_id, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey) || ',' || (c_custkey + 2) ELSE c_custkey || ',' || (c_custkey + 1) || ',' || (c_custkey + 2) END AS files FROM customer")
def q_collection_remove(spark, sf_dir):
    c = F.col("collection_id")
    out = an.collection_remove(_collections(spark, sf_dir), F.when(c % 2 == 0, c + 1).otherwise(F.lit(-1)))
    return out.select("collection_id", F.array_join("file_ids", ",").alias("files"))
