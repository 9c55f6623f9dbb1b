"""Registry of source files and jobs: ingest planning, registration, status, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_ingest(files: DataFrame, done_hashes: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``skip_reason``: a hash already completed, or seen at an earlier path.

    The first path of a hash is found by aggregation and joined back by path, never by hash, so
    copies of one file may make up any share of the table. Completed hashes are cut down to those
    present, and lead to their files through the aggregated hashes as well.
    """
    if force:
        return files.withColumn("skip_reason", F.lit(None).cast("string"))
    firsts = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    fresh = firsts.join(done_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
    fresh = fresh.select("path", F.lit(True).alias("fresh"))
    return files.join(fresh, "path", "left").withColumn(
        "skip_reason", F.when(F.col("fresh").isNull(), "duplicate_hash")).drop("fresh")


def completed_hashes(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin("completed", "completed_with_errors") & F.col("content_hash").isNotNull()).select(
        "content_hash").distinct()


def register_files(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Files found, once per path and hash, with ``created`` true where the registry had none."""
    key = ["source_path", "file_hash"]
    unique = found.groupBy(*key).agg(F.max("file_size").alias("file_size"))
    known = registry.select(*key).distinct().withColumn("known", F.lit(True))
    return unique.join(known, key, "left").withColumn("created", F.col("known").isNull()).drop("known")


def update_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes applied: start set once on processing, end on finishing, cleared on requeue.

    ``changes`` is ``(job_id, new_status, error_message, changed_at)``, one row per job.
    """
    out = jobs.drop("error_message").join(changes, "job_id", "left")
    hit, new, at = F.col("new_status").isNotNull(), F.col("new_status"), F.col("changed_at")
    started = F.when(hit & (new == "processing"), F.coalesce("started_at", at)).otherwise(F.col("started_at"))
    ended = (F.when(hit & new.isin("completed", "failed"), at).when(hit & new.isin("queued", "processing"), None)
             .otherwise(F.col("completed_at")))
    return out.withColumns({"status": F.coalesce(new, "status"), "started_at": started, "completed_at": ended,
                            "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}).drop("new_status", "changed_at")


def update_article_status(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """Article changes applied; the delivery time stands only while the delivery is sent."""
    out = articles.join(changes, "article_id", "left")
    hit = F.col("new_status").isNotNull()
    delivery = F.coalesce("new_delivery_status", "delivery_status")
    delivered = F.when(hit, F.when(delivery == "sent", F.col("changed_at"))).otherwise(F.col("delivered_at"))
    return out.withColumns({
        "status": F.coalesce("new_status", "status"), "delivered_at": delivered,
        "delivery_status": F.when(hit, delivery).otherwise(F.col("delivery_status"))}).drop("new_status", "new_delivery_status", "changed_at")


def ensure_placeholders(jobs: DataFrame, count: Column, existing: DataFrame) -> DataFrame:
    """Rows 1..count per job: existing ones as they are, the others queued."""
    count = F.when(count < 0, F.raise_error(F.lit("article_count must be non-negative")).cast("int")).otherwise(count)
    numbers = F.filter(F.sequence(F.lit(0), count), lambda n: n > 0)
    wanted = jobs.select("job_id", F.explode(numbers).alias("sequence_no"))
    return wanted.join(existing, ["job_id", "sequence_no"], "left").withColumns({
        "created": F.col("status").isNull(), "status": F.coalesce("status", F.lit("pending"))})


def stable_files(scans: DataFrame, stable_scans: int = 2) -> DataFrame:
    """Files released by a folder watch: at the scan where a fingerprint has lasted long enough.

    ``scans`` is ``(scan_id, path, size, mtime_ns)`` with consecutive scan ids. A file is released
    once, at its (n+1)-th consecutive scan with one fingerprint. Every row is sent to the n+2 scans
    it bears on; a group is one path at one scan, so no path is ever gathered as a whole.
    """
    n = stable_scans
    sent = scans.select("path", F.struct("size", "mtime_ns").alias("fp"),
                        F.explode(F.array(*[F.struct((F.col("scan_id") + k).alias("scan_id"), F.lit(k).alias("back")) for k in range(n + 2)])).alias("t"))
    seen = sent.groupBy("path", F.col("t.scan_id").alias("scan_id")).agg(
        *[F.max(F.when(F.col("t.back") == k, F.col("fp"))).alias(f"f{k}") for k in range(n + 2)])
    lasting = F.col("f0").isNotNull()
    for k in range(1, n + 1):
        lasting = lasting & F.col(f"f{k}").eqNullSafe(F.col("f0"))
    return seen.where(lasting & ~F.col(f"f{n + 1}").eqNullSafe(F.col("f0"))).select(
        "scan_id", "path", F.col("f0.size").alias("size"), F.col("f0.mtime_ns").alias("mtime_ns"))
