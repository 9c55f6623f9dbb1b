"""Job, file, page and article reports over the registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import geometry as geo
from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box
from broadsheet.functions.newspaper import contains_any
from broadsheet.stages import lazy

# Final file states; stages with their display names; colours of page regions.
FINAL_STATES = ("completed", "completed_with_errors", "failed", "skipped")
STAGE_LABELS = (
    ("scan", "입력 파일 탐색 / 해시"), ("render", "PDF 렌더링 / 이미지 정규화"), ("ocr_vl", "Page OCR"),
    ("ocr_structure", "보조 레이아웃 (미사용)"), ("ocr_fallback", "Fallback OCR (미사용)"), ("ocr_retry", "저품질 재시도"),
    ("cluster", "기사 군집화"), ("relevance", "국회 유사도 판단 / 문맥 보정"), ("crop", "이미지 crop"), ("persist", "DB 저장"),
)
REGION_COLORS = {
    "article": "#00B894", "title": "#FDCB6E", "image": "#0984E3",
    "unassigned": "#E17055", "layout": "#6C5CE7", "text": "#00CEC9",
}
HEADER_NAMES = ("문화일보", "아시아경제", "헤럴드", "내일신문", "중앙일보", "조선일보", "동아일보")


def percent(done: Column, total: Column, status: Column) -> Column:
    """Progress in percent; without a total it is all or nothing by status."""
    finished = status.isin("completed", "completed_with_errors")
    return F.when(total > 0, F.round(done / total * 100, 1)).when(finished, 100.0).otherwise(0.0)


def job_status(jobs: DataFrame, files: DataFrame) -> DataFrame:
    done = files.groupBy("job_id").agg(
        F.count_if(F.col("status").isin(*FINAL_STATES)).alias("processed_files"), F.count(F.lit(1)).alias("total_files"))
    return jobs.select("job_id", "status").join(done, "job_id", "left").na.fill(0, ["processed_files", "total_files"])


def file_page_stats(files: DataFrame, pages: DataFrame) -> DataFrame:
    stats = pages.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "parsed").alias("parsed_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"))
    out = files.join(stats, "file_id", "left").na.fill(0, ["rows", "parsed_pages", "failed_pages"])
    return out.select("job_id", "file_id", "file_name", "status", "parsed_pages", "failed_pages",
                      F.greatest("rows", F.coalesce("page_count", F.lit(0))).alias("page_count"))


def article_counts(parents: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """Articles per file or page; 0 where there is none."""
    counted = articles.groupBy(key).agg(F.count(F.lit(1)).alias("article_count"))
    return parents.join(counted, key, "left").na.fill(0, ["article_count"])


def stage_progress(logs: DataFrame) -> DataFrame:
    """Latest state of each of the ten stages per job; a stage never logged is queued.

    A stage that finished after ever failing is completed with errors.
    """
    known = logs.where(F.col("step_name").isin(*[k for k, _ in STAGE_LABELS]))
    latest = known.groupBy("job_id", "step_name").agg(
        F.max_by(F.struct("status", "message", "created_at"), F.struct("created_at", "log_id")).alias("l"),
        F.bool_or(F.col("status") == "failed").alias("failed"))
    return fill_stages(latest)


def fill_stages(latest: DataFrame) -> DataFrame:
    """Stage rows of every job in their order from ``(job_id, step_name, l, failed)``."""
    per_job = latest.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("step_name", F.struct("l", "failed")))).alias("m"))
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(k).alias("stage_key"), F.lit(v).alias("stage_label"))
                       for i, (k, v) in enumerate(STAGE_LABELS, start=1)])
    rows = per_job.select("job_id", "m", F.explode(stages).alias("s")).select("job_id", "s.*", F.col("m")[F.col("s.stage_key")].alias("e"))
    status = F.when((F.col("e.l.status") == "completed") & F.col("e.failed"), "completed_with_errors").otherwise(
        F.coalesce("e.l.status", F.lit("queued")))
    return rows.select("job_id", "stage_no", "stage_key", "stage_label", status.alias("status"),
                       F.col("e.l.message").alias("message"), F.col("e.l.created_at").alias("updated_at"))


def with_file_name(rows: DataFrame, files: DataFrame, file_id: Column, name: str, spread: str) -> DataFrame:
    """``rows`` with the ``name`` of their file, null where ``file_id`` is null.

    Most log rows have no file: they meet nothing, and are dealt out by ``spread`` instead of all by one null key.
    """
    rows = rows.withColumns({"_id": file_id, "_key": F.coalesce(file_id.cast("long"), F.xxhash64(spread))})
    named = files.select(F.col("file_id").cast("long").alias("_file"), F.col("file_name").alias(name))
    return rows.join(named, (F.col("_key") == F.col("_file")) & F.col("_id").isNotNull(), "left").drop("_id", "_key", "_file")


def recent_logs(logs: DataFrame, files: DataFrame | None = None, n: int = 200) -> DataFrame:
    """The newest ``n`` log rows of each job, numbered oldest first, with their file's name.

    ``row_number() <= n`` is cut down per input partition before the shuffle.
    """
    newest = Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("log_id"))
    top = logs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    oldest = Window.partitionBy("job_id").orderBy("created_at", "log_id")
    top = top.withColumn("position", F.row_number().over(oldest)).drop("_n")
    return top if files is None else with_file_name(top, files, F.col("file_id"), "file_name", "log_id")


def job_rollup(files: DataFrame) -> DataFrame:
    """Job status from its files: skipped files are successes, partly failed ones failures."""
    ok = F.col("status").isin("completed", "skipped")
    sums = files.groupBy("job_id").agg(
        F.count_if(ok).alias("success_files"), F.count_if(F.col("status").isin("failed", "completed_with_errors")).alias("failed_files"),
        F.count(F.lit(1)).alias("total_files"))
    status = (F.when((F.col("failed_files") > 0) & (F.col("success_files") > 0), "completed_with_errors")
              .when(F.col("failed_files") > 0, "failed").otherwise("completed"))
    return sums.withColumn("status", status)


def job_detail(jobs: DataFrame, files: DataFrame, pages: DataFrame, articles: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row per job: progress, page and article counts and (given page grades) quality."""
    stats = file_page_stats(files, pages).groupBy("job_id").agg(
        F.sum("page_count").alias("page_count"), F.sum("parsed_pages").alias("parsed_pages"), F.sum("failed_pages").alias("failed_pages"))
    counted = articles.groupBy("job_id").agg(F.count(F.lit(1)).alias("article_count"))
    rolled = job_rollup(files).drop("status", "total_files")
    out = job_status(jobs, files)
    for part in (rolled, stats, counted):
        out = out.join(part, "job_id", "left")
    out = out.na.fill(0).withColumn("progress_percent", percent(F.col("processed_files"), F.col("total_files"), F.col("status")))
    return out if quality is None else out.join(quality.withColumnRenamed("status", "quality_status"), "job_id", "left")


def job_result(articles: DataFrame, images: DataFrame, captions: DataFrame, metadata: DataFrame, delivery: DataFrame) -> DataFrame:
    """Articles with corrected text over their own, pictures in order with captions, delivery state."""
    # Pictures and captions meet dealt out by article, as the joins need them, so that each is shuffled once.
    pictures = images.select("article_id", "image_order", F.struct("image_path").alias("picture"), F.lit(None).alias("caption"))
    words = captions.where(F.col("image_order").isNotNull()).select(
        "article_id", "image_order", F.lit(None).alias("picture"), F.struct("caption_order", "caption").alias("caption"))
    each = pictures.unionByName(words).repartition("article_id").groupBy("article_id", "image_order").agg(
        F.collect_list("picture").alias("pictures"), F.transform(F.sort_array(F.collect_list("caption")), lambda c: c["caption"]).alias("captions"))
    listed = F.transform("pictures", lambda p: F.struct(F.col("image_order").alias("image_order"), p["image_path"].alias("image_path"), F.col("captions").alias("captions")))
    pics = each.where(F.size("pictures") > 0).groupBy("article_id").agg(F.sort_array(F.flatten(F.collect_list(listed))).alias("images"))
    out = articles.join(metadata, "article_id", "left").join(delivery, "article_id", "left").join(pics, "article_id", "left")
    title, body = tx.blank_to_null(F.col("corrected_title")), tx.blank_to_null(F.col("corrected_body_text"))
    return out.select(
        "job_id", "article_id", F.coalesce(title, F.col("title")).alias("title"), F.coalesce(body, F.col("body_text")).alias("body_text"),
        F.col("title").alias("original_title"), title.alias("corrected_title"), body.alias("corrected_body_text"),
        "delivery_status", F.coalesce("images", F.array()).alias("images"))


def recent_jobs(jobs: DataFrame, files: DataFrame, artifacts: DataFrame, n: int = 12) -> DataFrame:
    """The newest jobs, one per key: running and queued ones, others only with stored artifacts."""
    stored = artifacts.select("job_key").distinct().withColumn("stored", F.lit(True))
    visible = jobs.join(stored, "job_key", "left").where(F.col("status").isin("queued", "running") | F.col("stored"))
    cols = [c for c in jobs.columns if c != "job_key"]
    newest = visible.groupBy("job_key").agg(F.max_by(F.struct(*cols), F.struct("requested_at", "job_id")).alias("j"))
    top = newest.select("job_key", "j.*").orderBy(F.desc("requested_at"), F.desc("job_id")).limit(n)
    out = top.join(job_rollup(files).drop("status"), "job_id", "left").na.fill(0, ["success_files", "failed_files", "total_files"])
    done = F.col("success_files") + F.col("failed_files")
    return out.withColumn("progress_percent", percent(done, F.col("total_files"), F.col("status")))


def job_activity(logs: DataFrame, files: DataFrame, stages: DataFrame) -> DataFrame:
    """What a job is doing: its newest running log, else its running stage, else its newest log."""
    at = F.struct("created_at", "log_id")
    entry = F.struct("step_name", "status", "message", "file_id", "created_at")
    seen = logs.groupBy("job_id").agg(
        F.max_by(F.when(F.col("status") == "running", entry), F.when(F.col("status") == "running", at)).alias("active"),
        F.max_by(entry, at).alias("latest"))
    stage = stages.where(F.col("status") == "running").groupBy("job_id").agg(
        F.min_by(F.struct("stage_key", "message", "updated_at"), "stage_no").alias("stage"))
    running = files.where(F.col("status") == "running").groupBy("job_id").agg(F.min_by("file_name", "file_id").alias("running_file"))
    out = seen.join(stage, "job_id", "left").join(running, "job_id", "left")
    out = with_file_name(out, files, F.col("active.file_id"), "active_name", "job_id")
    out = with_file_name(out, files, F.col("latest.file_id"), "latest_name", "job_id")
    active, in_stage = F.col("active").isNotNull(), F.col("stage").isNotNull()

    def choose(a: str, s: str | Column, latest: str | Column) -> Column:
        return F.when(active, F.col(a)).when(in_stage, F.col(s) if isinstance(s, str) else s).otherwise(
            F.col(latest) if isinstance(latest, str) else latest)

    return out.select(
        "job_id", choose("active.status", F.lit("running"), "latest.status").alias("status"),
        choose("active.step_name", "stage.stage_key", "latest.step_name").alias("stage_key"),
        choose("active.message", "stage.message", "latest.message").alias("message"),
        F.coalesce("active_name", "running_file", "latest_name").alias("pdf_file"),
        choose("active.created_at", "stage.updated_at", "latest.created_at").alias("updated_at"))


def is_header_title(title: Column, body_length: Column) -> Column:
    """A title that rather looks like a page header; ``title`` is display text."""
    return (title == "") | ((body_length <= 80) & (F.length(title) <= 18)) | contains_any(F.lower(title), HEADER_NAMES)


def best_article(articles: DataFrame, order: list[str]) -> DataFrame:
    """The article to open first per job: scored, relevant, long, with pictures, not a header."""
    out = articles.withColumn("shown", tx.display_text(F.col("title")))
    score = F.col("relevance_score")
    header = F.when(is_header_title(F.col("shown"), F.col("body_length")), 1).otherwise(0)
    # The best first, so that one minimum per job decides both rank and order; what is null comes last.
    lengths = [f(F.col(c)) for c in ("body_length", "image_count") for f in (F.isnull, F.negative)]
    rank = F.struct(score.isNull(), -F.floor(F.coalesce(score, F.lit(-1.0)) * 1000), *lengths, header, *order)
    return out.groupBy("job_id").agg(F.min_by("article_id", rank).alias("article_id"))


def job_browser(files: DataFrame, pages: DataFrame, articles: DataFrame, annotations: DataFrame, enrichments: DataFrame, stage=lazy) -> DataFrame:
    """Pages of each file with their articles; titles by annotation, enrichment, then article. Titles and pages are a ``stage`` each."""
    titled = articles.join(annotations.select("article_id", F.col("corrected_title").alias("a_title")), "article_id", "left")
    titled = titled.join(enrichments.select("article_id", F.col("corrected_title").alias("e_title")), "article_id", "left")
    titled = titled.withColumn("shown", tx.display_title(F.col("a_title"), F.col("e_title"), F.col("title")))
    link = F.struct("article_order", F.col("shown").alias("title"), "article_id", F.col("a_title").isNotNull().alias("annotated"))
    titled = stage(titled.select("job_id", "file_id", "page_number", "page_id", link.alias("link")), "article-titles")
    # Dealt out by page alone, as the join with the pages needs them.
    titled = titled.repartition("page_id")
    links = F.sort_array(F.collect_list("link"))
    grouped = titled.groupBy("job_id", "file_id", "page_number", "page_id").agg(links.alias("articles"), F.count(F.lit(1)).alias("article_count"))
    out = stage(grouped.join(pages.select("page_id", F.col("status").alias("page_status")), "page_id", "left"), "browser-pages")
    return out.join(files.select("file_id", "file_name", F.col("status").alias("file_status")), "file_id", "left")


def page_links(pages: DataFrame) -> DataFrame:
    """The pages before and after each page of a job, across its files.

    Pages are only ordered within their file; files are linked by their first and last pages.
    """
    order = ["page_number", "page_id"]
    own = Window.partitionBy("file_id").orderBy(*order)
    linked = pages.where(F.col("file_id").isNotNull()).select(
        "job_id", "file_id", *order, F.lag("page_id").over(own).alias("p"), F.lead("page_id").over(own).alias("n"))
    # Pages inside a file are done; they go along alone, dealt out by their own ids.
    end = F.col("p").isNull() | F.col("n").isNull()
    linked = linked.withColumns({"_end": end, "_job": F.when(end, F.col("job_id")).otherwise(F.xxhash64("page_id"))})
    ends = Window.partitionBy("_job", "_end").orderBy("file_id", *order)
    before, after = (F.when(F.col("_end"), f("page_id").over(ends)) for f in (F.lag, F.lead))
    return linked.select("page_id", F.coalesce("p", before).alias("previous_page_id"), F.coalesce("n", after).alias("next_page_id"))


def article_detail(articles: DataFrame, pages: DataFrame, metadata: DataFrame, annotations: DataFrame, enrichments: DataFrame, raw: DataFrame, stage=lazy) -> DataFrame:
    """Article texts by precedence and links to the pages before and after its own.

    ``raw`` holds the page text found in the article's box (``raw_text_in_box``). Texts and links are a ``stage`` each.
    """
    out = articles
    for prefix, part in (("m", metadata), ("a", annotations), ("e", enrichments)):
        out = out.join(part.select("article_id", F.col("corrected_title").alias(f"{prefix}_title"),
                                   F.col("corrected_body_text").alias(f"{prefix}_body")), "article_id", "left")
    out = out.join(raw.select("article_id", "raw_text"), "article_id", "left")
    raw_text = tx.first_non_blank(F.col("raw_text"), F.col("body_text"))
    # The texts are chosen before the pages are joined, so that only those chosen are shuffled on.
    out = out.select(
        "job_id", "article_id", "page_id", tx.first_non_blank(*[F.col(c) for c in ("m_title", "a_title", "e_title", "title")], default="").alias("corrected_title"),
        tx.first_non_blank(*[F.col(c) for c in ("m_body", "a_body", "e_body", "body_text")], raw_text, default="").alias("corrected_body_text"))
    # Chosen once a row: a projection above the join would take the choice along, with all its texts.
    out = out.select(F.explode(F.array(F.struct(*out.columns))).alias("o")).select("o.*")
    out = stage(out, "article-texts")
    return out.join(stage(page_links(pages), "page-links"), "page_id", "left").drop("page_id")


BAND = 256


def raw_text_in_box(items: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Page text inside each box: items sharing area with it, by y, x and text.

    Items and boxes meet on bands down the page; an item is kept on the first band they share.
    """
    box, item = Box.named("b_"), Box.named("i_")
    left = boxes.select("doc_id", "page_no", key, *Box.named().columns("b_"),
                        F.explode(F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))).alias("band"))
    right = items.where(tx.strip(F.col("text")) != "").select(
        "doc_id", "page_no", tx.strip(F.col("text")).alias("t"), *Box.named().columns("i_"),
        F.explode(F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))).alias("band"))
    first = F.floor(F.greatest(F.col("b_y0"), F.col("i_y0")) / BAND)
    hits = left.join(right, ["doc_id", "page_no", "band"]).where((geo.intersection_area(box, item) > 0) & (F.col("band") == first))
    texts = F.sort_array(F.collect_list(F.struct("i_y0", "i_x0", "t")))
    return hits.groupBy("doc_id", "page_no", key).agg(F.array_join(F.transform(texts, lambda t: t["t"]), "\n").alias("raw_text"))


def raw_items(payloads: DataFrame) -> DataFrame:
    """Text items of a raw page payload: its parse list, else its parallel text and box arrays."""
    item = "array<struct<bbox:string,polygon_points:string,ori_bbox:string,content:string>>"
    parsed = payloads.select("doc_id", "page_no", "payload", F.from_json(F.get_json_object("payload", "$.parsing_res_list"), item).alias("items"))
    listed = F.transform("items", lambda i: F.struct(F.coalesce(i["bbox"], i["polygon_points"], i["ori_bbox"]).alias("bbox"), i["content"].alias("text")))

    def array(*paths: str) -> Column:
        found = [F.from_json(F.get_json_object("payload", p), "array<string>") for p in paths]
        return F.coalesce(*[F.when(F.size(f) > 0, f) for f in found])

    roots = ("$.overall_ocr_res.", "$.")
    texts = array(*[r + "rec_texts" for r in roots])
    boxes = array(*[r + k for k in ("rec_boxes", "rec_polys", "dt_polys") for r in roots])
    parallel = F.transform(texts, lambda t, i: F.struct(F.get(boxes, i).alias("bbox"), t.alias("text")))
    rows = parsed.select("doc_id", "page_no", F.explode(F.when(F.size("items") > 0, listed).otherwise(parallel)).alias("i"))
    rows = geo.split_box(rows, geo.bbox_array_from_any(F.col("i.bbox"))).select("doc_id", "page_no", *Box._fields, tx.strip(F.coalesce("i.text", F.lit(""))).alias("text"))
    return rows.where(F.col("x0").isNotNull() & (F.col("text") != ""))


def page_regions(articles: DataFrame, images: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Everything drawn on a page as one list: articles, titles, pictures, left-over blocks."""

    def part(df: DataFrame, label: Column, prefix: str, text: Column, confidence: Column, color: str) -> DataFrame:
        box = geo.normalize_bbox(Box.named(prefix), F.col("width"), F.col("height"))
        return df.where(F.col(prefix + "x0").isNotNull()).select(
            "doc_id", "page_no", label.alias("label"), *box.columns(), text.alias("text"), confidence.cast("double").alias("confidence"),
            F.lit(REGION_COLORS[color]).alias("color"))

    title = tx.squeeze(tx.strip_markup(F.col("title")))
    return (
        part(articles, F.lit("article"), "", title, F.col("confidence"), "article")
        .unionByName(part(articles, F.lit("title"), "title_", title, F.col("confidence"), "title"))
        .unionByName(part(images, F.lit("image"), "", F.concat(F.lit("article #"), F.col("article_order")), F.lit(None), "image"))
        .unionByName(part(unassigned, F.coalesce("label", F.lit("unassigned")), "", F.col("text"), F.col("confidence"), "unassigned"))
    )


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def list_articles(articles: DataFrame, job_id: int | None = None) -> DataFrame:
    chosen = articles if job_id is None else articles.where(F.col("job_id") == job_id)
    return chosen.orderBy(F.desc("created_at"), F.desc("article_id"))
