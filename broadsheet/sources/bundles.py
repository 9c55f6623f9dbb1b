"""Stored page payloads and article bundles: reading, joining, importing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as tx

ARTICLE_SCHEMA = (
    "job_id string, pdf_file string, page_number int, article_order int, article_id string, title string, body_text string, "
    "title_bbox array<int>, article_bbox array<int>, confidence double, layout_type string, "
    "images array<struct<image_order:int,image_path:string,relative_path:string,bbox:array<int>,"
    "captions:array<struct<text:string,bbox:array<int>,confidence:double>>>>, "
    "relevance_score double, relevance_reason string, relevance_label string, corrected_title string, corrected_body_text string, "
    "correction_source string"
)


def read_page_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file: its page number from the name and the JSON as text and variant."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return raw.select(name.alias("path"), F.regexp_extract(name, r"(\d+)[^/\d]*\.json$", 1).try_cast("int").alias("page_no"),
                      F.col("value").alias("payload"), F.try_parse_json("value").alias("variant"))


def read_article_bundles(spark: SparkSession, root: str) -> DataFrame:
    """``article.json`` records; what a record lacks of its keys comes from its path.

    Corrupt files are dropped. Rows are in job, file, page, article order.
    """
    raw = spark.read.option("pathGlobFilter", "article.json").option("recursiveFileLookup", "true").option("multiLine", "true").option(
        "mode", "DROPMALFORMED").schema(ARTICLE_SCHEMA).json(root)
    return with_path_keys(raw.withColumn("path", F.col("_metadata.file_path"))).orderBy("job_key", "pdf_slug", "page_number", "article_order")


BUNDLE_PATH = r"([^/]+)/([^/]+)/parsed/page_(\d+)/article_(\d+)[^/]*/article\.json$"


def with_path_keys(records: DataFrame) -> DataFrame:
    def part(i: int) -> Column:
        return F.regexp_extract("path", BUNDLE_PATH, i)

    return records.withColumns({
        "job_key": part(1), "pdf_slug": part(2),
        "page_number": F.coalesce("page_number", part(3).try_cast("int"), F.lit(0)),
        "article_order": F.coalesce("article_order", part(4).try_cast("int"), F.lit(0)),
        "pdf_file": F.coalesce(F.nullif("pdf_file", F.lit("")), part(2)),
        "title": F.coalesce("title", F.lit("")), "body_text": F.coalesce("body_text", F.lit(""))})


def import_archive(bundles: DataFrame, existing_jobs: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs and pages of the newest stored jobs that are not in the registry yet.

    ``bundles`` has job_key, pdf_file, page_number, article_order and mtime. With a ``limit``,
    only the newest stored jobs are looked at, known ones among them included. ``total_articles`` counts articles.
    """
    dirs = bundles.groupBy("job_key").agg(F.max("mtime").alias("mtime"))
    newest = dirs if limit is None else dirs.orderBy(F.desc("mtime"), "job_key").limit(limit)
    fresh = newest.join(existing_jobs.select("job_key").distinct(), "job_key", "left_anti")
    rows = bundles.where(F.col("page_number") > 0).join(fresh.select("job_key", F.col("mtime").alias("requested_at")), "job_key")
    pages = rows.groupBy("job_key", "requested_at", "pdf_file", "page_number").agg(F.count(F.lit(1)).alias("article_count"))
    jobs = pages.groupBy("job_key", "requested_at").agg(
        F.count_distinct("pdf_file").alias("total_files"), F.count(F.lit(1)).alias("total_pages"), F.sum("article_count").alias("total_articles"))
    day = F.try_to_date(F.regexp_extract("job_key", r"^job_(\d{8})_", 1), "yyyyMMdd")
    return jobs.withColumns({"status": F.lit("completed"), "requested_date": day}), pages.drop("requested_at")


ENRICHMENT_KEYS = ("relevance_score", "relevance_reason", "relevance_label", "corrected_title", "corrected_body_text", "correction_source")


def load_article_metadata(articles: DataFrame, enrichments: DataFrame, keys: tuple[str, ...] = ENRICHMENT_KEYS) -> DataFrame:
    """Article records with enrichment values where their own are missing."""
    extra = enrichments.select("article_id", *[F.col(k).alias(f"e_{k}") for k in keys])
    out = articles.join(extra, "article_id", "left")
    return out.withColumns({k: F.coalesce(k, f"e_{k}") for k in keys}).drop(*[f"e_{k}" for k in keys])


def read_state_sidecars(metadata: DataFrame, enrichments: DataFrame, demo_delivery: DataFrame, delivery: DataFrame, annotations: DataFrame) -> DataFrame:
    """State of each article: delivery (the demo file first) and where its correction comes from."""
    out = metadata.select("article_id", F.col("correction_source").alias("m_source"))
    out = out.join(enrichments.select("article_id", F.col("correction_source").alias("e_source")), "article_id", "left")
    for prefix, part in (("demo", demo_delivery), ("live", delivery)):
        out = out.join(part.select("article_id", F.col("delivery_status").alias(f"{prefix}_status"), F.lit(True).alias(prefix)), "article_id", "left")
    out = out.join(annotations.select("article_id", F.lit(True).alias("annotated")).distinct(), "article_id", "left")
    source = F.when(F.col("annotated"), "annotation").otherwise(tx.first_non_blank(F.col("e_source"), F.col("m_source"), default="ocr"))
    status = F.when(F.col("demo"), F.col("demo_status")).otherwise(F.col("live_status"))
    return out.select("article_id", status.alias("delivery_status"), source.alias("correction_source"), F.coalesce("annotated", F.lit(False)).alias("annotated"))
