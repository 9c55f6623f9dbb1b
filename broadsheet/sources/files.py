"""Source files: scanning, hashing, kinds and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes taken in, and kinds by suffix.
SOURCE_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".webp")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
HEADER_PROBE_BYTES = 1024


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot, blank if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def scan_source_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Files below ``root`` with a known suffix; bytes are only read if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(suffix(F.col("path")).isin(*SOURCE_SUFFIXES))
    cols = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), suffix(F.col("path")).alias("suffix"),
            F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*cols, *(["content", content_hash(F.col("content")).alias("content_hash")] if with_content else [])).orderBy("path")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_fingerprint(size: Column, mtime: Column) -> Column:
    """Change detector: size and modification time."""
    return F.struct(size.cast("long").alias("size"), F.unix_micros(mtime).alias("mtime_us"))


def resolve_file_date(mtime: Column, requested: dt.date | str | None = None) -> Column:
    return F.coalesce(F.lit(requested).cast("date"), F.to_date(mtime))


def detect_file_kind(path: Column) -> Column:
    s = suffix(path)
    return (F.when(s == ".pdf", "pdf").when(s.isin(*IMAGE_SUFFIXES), "image").when(s == ".json", "json")
            .when(s.isin(".txt", ".md"), "text").otherwise("binary"))


def validate_payload_header(path: Column, content: Column) -> Column:
    """Why a payload is refused, null where it is fine."""
    s = suffix(path)
    probe = F.substring(content, 1, HEADER_PROBE_BYTES).cast("string")
    return (
        F.when(F.octet_length(content) == 0, "empty request body")
        .when((s == ".pdf") & ~F.contains(probe, F.lit("%PDF-")), "request body is not a PDF")
        .when(~s.isin(*SOURCE_SUFFIXES), "only these file types are supported: " + ", ".join(sorted(SOURCE_SUFFIXES))))
