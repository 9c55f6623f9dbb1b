"""Conversion requests: status repair, history, expiry, progress."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import strip

DONE = ("complete", "completed", "success")


def _status(value: Column) -> Column:
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def request_status(r: dict[str, Column]) -> Column:
    """Repaired status: failures first, then any evidence of completion, else as recorded.

    ``r`` holds result_status, record_status, success, error, processing_complete,
    runtime_status, progress_status, processed_page_count, page_count and stored_pages.
    """
    raw = F.coalesce(F.nullif(_status(r["result_status"]), F.lit("")), F.nullif(_status(r["record_status"]), F.lit("")), F.lit("processing"))
    failed = raw.isin("failed", "error") | F.coalesce(~r["success"], F.lit(False)) | (F.coalesce(r["error"], F.lit("")) != "")
    done = (
        raw.isin(*DONE) | _status(r["record_status"]).isin(*DONE) | F.coalesce(r["success"], F.lit(False))
        | F.coalesce(r["processing_complete"], F.lit(False)) | _status(r["runtime_status"]).isin(*DONE)
        | _status(r["progress_status"]).isin(*DONE))
    positive = (r["processed_page_count"] > 0) & (r["page_count"] > 0) & (r["stored_pages"] > 0)
    counted = F.coalesce(positive & (r["processed_page_count"] >= r["page_count"]), F.lit(False))
    return F.when(failed, "failed").when(done | counted, "complete").otherwise(raw)


STATUS_FIELDS = ("result_status", "record_status", "success", "error", "processing_complete", "runtime_status",
                 "progress_status", "processed_page_count", "page_count", "stored_pages")


def request_history(requests: DataFrame, limit: int = 50, kind: str | None = None, playground_only: bool = False) -> DataFrame:
    """The newest requests with repaired status; ``total_count`` tells how many there are."""
    limit = max(1, min(int(limit), 500))
    found = requests
    if playground_only:
        found = found.where(F.col("playground"))
    if kind:
        found = found.where(F.col("request_kind") == kind)
    total = found.agg(F.count(F.lit(1))).scalar()
    status = request_status({f: F.col(f) for f in STATUS_FIELDS})
    shown = found.orderBy(F.desc_nulls_last(F.coalesce("updated_at", "created_at")), "request_id").limit(limit)
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.nullif("source_file", F.lit("")), F.lit(""))
    items = shown.select("request_id", "request_kind", status.alias("status"), "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"),
                         name.alias("file_name"), "page_count", "processed_page_count", F.coalesce("error", F.lit("")).alias("error"))
    return items.withColumn("total_count", total)


def expired_requests(requests: DataFrame, now: dt.datetime | str, older_than_hours: float = 24.0, status: str | None = None) -> DataFrame:
    """Requests last touched at or before the cutoff: what a dry run lists."""
    if older_than_hours <= 0:
        raise ValueError("older_than_hours must be positive")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(older_than_hours * 3600).cast("decimal(18,6)"))
    found = requests.where(F.coalesce("updated_at", "created_at") <= cutoff)
    return found if status is None else found.where(F.col("record_status") == status)


def remaining_requests(requests: DataFrame, **cleanup) -> DataFrame:
    """Requests left after a real cleanup run."""
    return requests.join(expired_requests(requests, **cleanup).select("request_id"), "request_id", "left_anti")


def progress_percent(processed: Column, total: Column, status: Column) -> Column:
    """Percent of pages done; without pages a finished request is at 100."""
    done = F.greatest(F.coalesce(processed, F.lit(0)), F.lit(0))
    pages = F.greatest(F.coalesce(total, F.lit(0)), F.lit(0))
    return F.when(pages > 0, F.round(F.least(done, pages) / pages * 100, 1)).when(status == "complete", 100.0).otherwise(0.0)
