"""Caption entries of stored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box, bbox_array_from_any, needs_scaling, normalize_bboxes, split_box


def normalize_captions(images: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Captions of stored pictures: trimmed, boxes scaled to the page, repeats of a picture dropped.

    ``images`` is ``(article_id, position, image_order, captions)`` with captions a JSON list of
    ``{text|content, bbox, confidence}``; a picture without a positive order goes by its position.
    """
    order = F.when(F.col("image_order") > 0, F.col("image_order")).otherwise(F.col("position"))
    # Dealt out by article before anything is parsed: what the stored captions hold is grouped without a further shuffle.
    images = images.repartition("article_id")
    listed = F.from_json("captions", "array<struct<text:string,content:string,bbox:string,confidence:double>>")
    sizes = [width.alias("_w"), height.alias("_h")] if width is not None and height is not None else []
    rows = images.select("article_id", order.alias("image_order"), *sizes, F.posexplode(listed).alias("caption_order", "c"))
    # A filter on the caption itself would have it computed twice.
    rows = rows.where(F.col("c.text").rlike(tx.NOT_BLANK) | F.col("c.content").rlike(tx.NOT_BLANK))
    rows = rows.withColumn("caption", tx.first_non_blank(F.col("c.text"), F.col("c.content")))
    rows = split_box(rows, bbox_array_from_any(F.col("c.bbox"))).withColumn("confidence", F.col("c.confidence")).drop("c")
    if sizes:
        rows = rows.withColumn("_scale", needs_scaling(F.col("x1"), F.col("y1"), F.col("_w"), F.col("_h")))
        scaled = normalize_bboxes(Box.named(), F.col("_w"), F.col("_h"), F.col("_scale"))
        present = F.col("x0").isNotNull()
        rows = rows.withColumns({f"n_{s}": F.when(present, v) for s, v in scaled._asdict().items()}).drop(*Box._fields, "_w", "_h", "_scale")
        rows = rows.withColumnsRenamed({f"n_{s}": s for s in Box._fields})
    key = ["article_id", "image_order", "caption", *Box._fields]
    # Single values, which Spark aggregates by hash; a struct of both would be sorted by all the keys, twice.
    return rows.groupBy(*key).agg(F.min("caption_order").alias("caption_order"), F.min_by("confidence", "caption_order").alias("confidence"))


def captions_by_image(captions: DataFrame) -> DataFrame:
    """Map of picture order to its captions in order, per article."""
    per_image = captions.groupBy("article_id", "image_order").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("caption_order", "caption"))), lambda c: c["caption"]).alias("captions"))
    return per_image.groupBy("article_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("image_order", "captions")))).alias("captions"))


def flatten_captions(captions: DataFrame) -> DataFrame:
    """Distinct captions of an article over all its pictures, at the place of their first one.

    ``captions`` are those of ``normalize_captions``: one row per picture, caption and box, so that no two places tie.
    """
    key = ["article_id", "caption", *Box._fields]
    # A picture without any order comes before the others.
    unplaced = F.min(F.when(F.col("image_order").isNull(), F.col("caption_order")))
    at = F.coalesce(unplaced, F.min_by("caption_order", "image_order"))
    return captions.groupBy(*key).agg(F.when(unplaced.isNull(), F.min("image_order")).alias("image_order"), at.alias("caption_order"))
