"""Layout, page and job quality. Everything is sums and counts, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.labels import QUALITY_TEXT_LABELS

PAGE = ["doc_id", "page_no"]
MIN_CHARS, MIN_HANGUL_RATIO = 80, 0.35


def layout_text(blocks: DataFrame) -> DataFrame:
    """Text of a page: its textual blocks in list order, one per line."""
    counts = F.col("label").isin(*QUALITY_TEXT_LABELS) & (tx.strip(F.col("text")) != "")
    listed = F.sort_array(F.collect_list(F.when(counts, F.struct("seq", "text"))))
    return blocks.groupBy(*PAGE).agg(tx.strip(F.array_join(F.transform(listed, lambda b: b["text"]), "\n")).alias("layout_text"))


def duplicate_line_penalty(blocks: DataFrame) -> DataFrame:
    """Per page a penalty for repeated lines of its textual blocks, 0 below three lines."""
    lines = blocks.where(F.col("label").isin(*QUALITY_TEXT_LABELS)).select(
        *PAGE, F.explode(F.split("text", r"\r\n|[\n\r]")).alias("line")).withColumn("line", tx.compact(F.col("line")))
    counted = lines.where(F.col("line") != "").groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("n"))
    pages = counted.groupBy(*PAGE).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("repeats"),
        F.count_if((F.col("n") >= 3) & (F.length("line") <= 40)).alias("short_hits"))
    penalty = F.least(F.lit(0.35), F.col("repeats") / F.col("total") * 0.45 + F.col("short_hits") * 0.05)
    return pages.select(*PAGE, F.when(F.col("total") < 3, 0.0).otherwise(penalty).alias("duplicate_penalty"))


def structure_penalty(blocks: DataFrame) -> DataFrame:
    """Per page a penalty for too many or too long titles, or captions without any title."""
    textual = F.col("label").isin(*QUALITY_TEXT_LABELS)
    title = F.col("label") == "title"
    sums = blocks.groupBy(*PAGE).agg(
        F.count_if(textual).alias("n"), F.count_if(title).alias("titles"),
        F.count_if(title & (tx.compact_len(F.col("text")) >= 60)).alias("long_titles"),
        F.count_if(F.col("label") == "caption").alias("captions"))
    share = F.col("titles") / F.col("n")
    many = F.when((F.col("titles") >= 2) & (share > 0.35), F.least(F.lit(0.14), (share - 0.35) * 0.45)).otherwise(0.0)
    long = F.when(F.col("titles") >= 2, F.least(F.lit(0.12), F.col("long_titles") * 0.04)).otherwise(0.0)
    orphans = F.when((F.col("captions") >= 3) & (F.col("titles") == 0), 0.06).otherwise(0.0)
    total = F.when(F.col("n") < 3, 0.0).otherwise(F.least(F.lit(0.22), many + long + orphans))
    return sums.select(*PAGE, total.alias("structure_penalty"))


def layout_quality(blocks: DataFrame, min_chars: int = MIN_CHARS, min_ratio: float = MIN_HANGUL_RATIO) -> DataFrame:
    """Score and acceptability of each page layout."""
    text = F.when(F.col("label").isin(*QUALITY_TEXT_LABELS), F.col("text")).otherwise("")
    sums = blocks.groupBy(*PAGE).agg(
        F.sum(tx.compact_len(text)).alias("chars"), F.sum(tx.hangul_count(text)).alias("hangul"),
        F.sum(tx.count_matches(text, "[A-Za-z]") + tx.count_matches(text, r"[\x{4e00}-\x{9fff}]")).alias("others"),
        F.bool_or(F.col("label") == "image").alias("has_image"))
    letters = F.col("hangul") + F.col("others")
    ratio = F.when(letters > 0, F.col("hangul") / letters).otherwise(0.0)
    out = sums.withColumn("ratio", ratio).join(duplicate_line_penalty(blocks), PAGE, "left").join(structure_penalty(blocks), PAGE)
    score = (F.least(F.col("chars") / max(min_chars, 1), F.lit(2.0)) / 2.0 * 0.55 + F.col("ratio") * 0.35
             + F.when(F.col("has_image"), 0.1).otherwise(0.0)
             - F.coalesce("duplicate_penalty", F.lit(0.0)) - F.col("structure_penalty"))
    return out.select(*PAGE, F.round(F.greatest(F.lit(0.0), score), 4).alias("score"),
                      ((F.col("chars") >= min_chars) & (F.col("ratio") >= min_ratio)).alias("acceptable"))


def page_quality(blocks: DataFrame, article_counts: DataFrame, min_chars: int = MIN_CHARS,
                 min_ratio: float = MIN_HANGUL_RATIO) -> DataFrame:
    """Grade of each page: score, status and reasons. ``article_counts`` has ``article_count`` per page."""
    sums = blocks.groupBy(*PAGE).agg(
        F.sum(tx.compact_len(F.col("text"))).alias("char_count"), F.sum(tx.hangul_count(F.col("text"))).alias("hangul"),
        F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("block_count"),
        F.count_if(F.col("label") == "image").alias("image_count"))
    out = sums.join(article_counts, PAGE, "left").withColumns({
        "article_count": F.coalesce("article_count", F.lit(0)),
        "korean_ratio": F.when(F.col("char_count") > 0, F.round(F.col("hangul") / F.col("char_count"), 4)).otherwise(0.0),
        "average_confidence": F.round("mean", 4),
    })
    chars, confidence = F.col("char_count"), F.col("average_confidence")
    score = F.least(chars / max(min_chars, 1), F.lit(2.0)) / 2.0 * 0.45 + F.col("korean_ratio") * 0.3 + confidence * 0.25
    reasons = F.array_compact(F.array(
        F.when(chars == 0, "empty_text").when(chars < min_chars, "low_text"),
        F.when((chars > 0) & (F.col("korean_ratio") < min_ratio), "low_korean_ratio"),
        F.when((confidence != 0) & (confidence < 0.75), "low_confidence"),
        F.when(F.col("article_count") == 0, "no_articles"),
        F.when((F.col("image_count") > 0) & (chars < 20), "image_only")))
    out = out.withColumns({"score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4), "reasons": reasons})
    blocked = (F.col("score") < 0.45) | F.arrays_overlap("reasons", F.array(F.lit("empty_text"), F.lit("no_articles")))
    status = F.when(blocked, "blocked").when((F.col("score") < 0.7) | (F.size("reasons") > 0), "warning").otherwise("ready")
    return out.select(
        *PAGE, status.alias("status"), "score", "char_count", "korean_ratio", "average_confidence", "block_count",
        "image_count", "article_count", (status != "ready").alias("needs_review"), "reasons")


def job_quality(pages: DataFrame, key: str = "job_id") -> DataFrame:
    """Roll-up of page grades: counts by status, mean score, worst status, five commonest reasons."""

    def number(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    out = with_top_reasons(pages, key, "reasons", 5, [
        number("ready").alias("ready_pages"), number("warning").alias("warning_pages"),
        number("blocked").alias("blocked_pages"), F.count(F.lit(1)).alias("measured_pages"),
        F.round(F.avg("score"), 4).alias("average_score")])
    status = F.when(F.col("blocked_pages") > 0, "blocked").when(F.col("warning_pages") > 0, "warning").otherwise("ready")
    return out.select(
        key, status.alias("status"), "average_score", "ready_pages", "warning_pages", "blocked_pages",
        (F.col("warning_pages") + F.col("blocked_pages")).alias("review_pages"), "measured_pages", F.col("top").alias("top_reasons"))


def with_top_reasons(rows: DataFrame, key: str, reasons: str, top: int, sums: list[Column], also: tuple[str, ...] = ()) -> DataFrame:
    """``sums`` per key, and ``top``, its commonest reasons, in one pass over ``rows``.

    Each row is counted under its reasons and once under none, where the sums are made; ``also`` are reasons that each key has once.
    """
    each = rows.withColumn("_reason", F.explode(F.concat(reasons, F.array(F.lit(None).cast("string")))))
    counted = each.groupBy(key, "_reason").agg(F.count(F.lit(1)).alias("_n"), *sums)
    names = [c for c in counted.columns if c not in (key, "_reason", "_n")]
    whole = F.col("_reason").isNull()
    # At most one row per kind of reason and key: a handful.
    named = F.collect_list(F.when(~whole, F.struct((-F.col("_n")).alias("n"), F.col("_reason").alias("reason"))))
    named = F.concat(named, *[F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit(r).alias("reason"))) for r in also])
    out = counted.groupBy(key).agg(*[F.max(F.when(whole, F.col(n))).alias(n) for n in names], F.slice(F.sort_array(named), 1, top).alias("top"))
    return out.withColumn("top", F.transform("top", lambda t: t["reason"]))


def parse_quality_score(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.round(F.avg("confidence"), 4).alias("parse_quality_score"))
