"""Review annotations of articles, file collections, and the export of accepted annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.geometry import bbox_array_from_any

# States of an annotation.
STATUSES = ("pending", "accepted", "needs_review", "rejected")


def _box(raw: Column) -> Column:
    """``array<int>`` of a JSON box, null where it is none."""
    return bbox_array_from_any(raw, depth=1)


def _regions(raw: Column, given: Column, box: Column, text: Column) -> Column:
    """Regions of a JSON list of objects or boxes; one from box and text if none was given."""
    listed = F.transform(F.from_json(raw, "array<string>"), lambda r: F.struct(
        _box(F.when(F.startswith(r, F.lit("{")), F.get_json_object(r, "$.bbox")).otherwise(r)).alias("bbox"),
        tx.strip(F.coalesce(F.when(F.startswith(r, F.lit("{")), F.get_json_object(r, "$.text")), F.lit(""))).alias("text")))
    kept = F.filter(F.coalesce(listed, F.filter(F.array(F.struct(box.alias("bbox"), text.alias("text"))), lambda r: F.lit(False))),
                    lambda r: r["bbox"].isNotNull() | (r["text"] != ""))
    fallback = F.filter(F.array(F.struct(box.alias("bbox"), text.alias("text"))), lambda r: r["bbox"].isNotNull() | (r["text"] != ""))
    return F.when(~given & (F.size(kept) == 0), fallback).otherwise(kept)


def _region_text(regions: Column, fallback: Column, separator: str) -> Column:
    texts = F.filter(F.transform(regions, lambda r: r["text"]), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, separator)).otherwise(fallback)


def _region_hull(regions: Column, fallback: Column) -> Column:
    boxes = F.filter(F.transform(regions, lambda r: r["bbox"]), F.isnotnull)

    def side(i: int, pick) -> Column:
        return pick(F.transform(boxes, lambda b: F.get(b, F.lit(i))))

    hull = F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
    return F.when(F.size(boxes) > 0, hull).otherwise(fallback)


def normalize_annotations(records: DataFrame) -> DataFrame:
    """Annotations of articles made whole: an absent key takes the article's value, null does not.

    ``records`` holds article_id, title, body_text, title_bbox and article_bbox (JSON), reviewer,
    and ``payload``, the annotation as JSON (null where the article has none).
    """
    payload = F.coalesce("payload", F.lit("{}"))
    out = records.withColumns({"_p": payload, "_k": F.json_object_keys(payload)})

    def given(key: str) -> Column:
        return F.array_contains("_k", key)

    def value(key: str) -> Column:
        return F.get_json_object("_p", f"$.{key}")

    for part, own in (("title", "title"), ("article", "body_text")):
        corrected = "corrected_title" if part == "title" else "corrected_body_text"
        out = out.withColumns({
            f"_{part}_text": tx.strip(F.coalesce(F.when(given(corrected), value(corrected)).otherwise(F.col(own)), F.lit(""))),
            f"_{part}_box": _box(F.when(given(f"{part}_bbox"), value(f"{part}_bbox")).otherwise(F.col(f"{part}_bbox")))})
        out = out.withColumn(f"_{part}_regions", _regions(
            value(f"{part}_regions"), given(f"{part}_regions"), F.col(f"_{part}_box"), F.col(f"_{part}_text")))
    tags = F.from_json(value("tags"), "array<string>")
    tags = F.when(F.startswith(value("tags"), F.lit("[")), tags).otherwise(F.split(value("tags"), ","))
    status = value("status")
    return out.select(
        "article_id", tx.normalize_reviewer(F.col("reviewer")).alias("reviewer"),
        F.when(status.isin(*STATUSES), status).otherwise("pending").alias("status"),
        _region_text(F.col("_title_regions"), F.col("_title_text"), "\n").alias("corrected_title"),
        _region_text(F.col("_article_regions"), F.col("_article_text"), "\n\n").alias("corrected_body_text"),
        _region_hull(F.col("_title_regions"), F.col("_title_box")).alias("title_bbox"),
        _region_hull(F.col("_article_regions"), F.col("_article_box")).alias("article_bbox"),
        F.col("_title_regions").alias("title_regions"), F.col("_article_regions").alias("article_regions"),
        tx.strip(F.coalesce(value("notes"), F.lit(""))).alias("notes"),
        F.coalesce(F.filter(F.transform(tags, tx.strip), lambda t: t != ""), F.array().cast("array<string>")).alias("tags"))


def latest_annotation(annotations: DataFrame) -> DataFrame:
    """The last annotation per reviewer and article."""
    key = ["reviewer", "article_id"]
    cols = [c for c in annotations.columns if c not in key]
    last = annotations.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("updated_at", "payload")).alias("a"))
    return last.select(*key, "a.*")


# -- collections -----------------------------------------------------------------------------

def collection_add(collections: DataFrame, file_ids: Column) -> DataFrame:
    """Files appended in order, each kept once."""
    return collections.withColumn("file_ids", F.array_union("file_ids", file_ids))


def collection_remove(collections: DataFrame, file_id: Column) -> DataFrame:
    return collections.withColumn("file_ids", F.array_remove("file_ids", file_id))


# -- export ----------------------------------------------------------------------------------

def number_records(records: DataFrame) -> DataFrame:
    """Adds ``position``: the place in the whole record list, from 1.

    Records are numbered within their file, files within their job, jobs within their day (the
    first twelve characters of a job key, ``job_20240131``) and days among all days, each level on
    the counts of the one below; only the list of days is ever ordered as a whole.
    """

    def offsets(counts: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0)))

    day = F.substring("job_key", 1, 12).alias("day")
    files = records.groupBy(day, "job_key", "pdf_slug").agg(F.count(F.lit(1)).alias("n"))
    jobs = files.groupBy("day", "job_key").agg(F.sum("n").alias("n"))
    days = jobs.groupBy("day").agg(F.sum("n").alias("n"))
    files = offsets(files, ["job_key"], "pdf_slug", "in_job").drop("n")
    jobs = offsets(jobs, ["day"], "job_key", "in_day").drop("n", "day")
    days = offsets(days, [], "day", "in_all").drop("n")
    placed = files.join(jobs, "job_key").join(days, "day").select(
        "job_key", "pdf_slug", (F.col("in_job") + F.col("in_day") + F.col("in_all")).alias("offset"))
    own = Window.partitionBy("job_key", "pdf_slug").orderBy("page_number", "article_order")
    numbered = records.withColumn("_n", F.row_number().over(own))
    return numbered.join(placed, ["job_key", "pdf_slug"]).withColumn("position", F.col("offset") + F.col("_n")).drop("_n", "offset")


def training_rows(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Accepted annotations with the crops they give; numbers follow the whole list, so with holes."""
    out = number_records(records).join(annotations.where(F.col("status") == "accepted"), "article_id")
    title, body = tx.strip(F.col("corrected_title")), tx.strip(F.col("corrected_body_text"))
    return out.select(
        "article_id", "position", "job_key", "pdf_slug", "page_number", "article_order", title.alias("title"), body.alias("body_text"),
        "title_bbox", "article_bbox",
        F.when((title != "") & F.col("title_bbox").isNotNull(), F.format_string("recognition_title/title_%06d.png", F.col("position"))).alias("title_path"),
        F.when(((title != "") | (body != "")) & F.col("article_bbox").isNotNull(),
               F.format_string("document_article/article_%06d.png", F.col("position"))).alias("article_path"))


def export_training_set(records: DataFrame, annotations: DataFrame, root: str) -> DataFrame:
    """Writes title TSV, article JSON lines and layout JSON lines below ``root``; returns the counts."""
    rows = training_rows(records, annotations).persist()
    try:
        titles = rows.where(F.col("title_path").isNotNull())
        titles.select(F.concat_ws("\t", "title_path", "title").alias("value")).write.mode("overwrite").text(f"{root}/recognition_title")
        crops = rows.where(F.col("article_path").isNotNull()).drop("title_path", "title_bbox", "article_bbox")
        crops.withColumnRenamed("article_path", "image_path").write.mode("overwrite").json(f"{root}/document_article")
        rows.drop("title_path", "article_path").write.mode("overwrite").json(f"{root}/layout_annotations")
        counts = rows.agg(F.count(F.lit(1)).alias("accepted_count"), F.count("title_path").alias("title_crop_count"),
                          F.count("article_path").alias("article_crop_count"))
        return counts.sparkSession.createDataFrame([tuple(counts.first())], counts.schema)
    finally:
        rows.unpersist()
