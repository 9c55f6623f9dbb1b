"""Column-wise segmentation: float boxes to columns to articles broken at headlines and gaps.

Blocks are ``(doc_id, page_no, width, height, block_id, kind, x0, y0, x1, y1, text)``. The page
rows are hash-partitioned by page once; the windows and groupings below reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.geometry import Box, bbox_union, expand_bbox
from broadsheet.functions.text import SPACE, count_matches, let, strip

PAGE = ["doc_id", "page_no"]
READING = ["y0", "x0", "block_id"]

# Block kinds with a meaning of their own.
HEADLINE_KINDS = ("headline", "title", "header", "section_header", "subheadline")
IMAGE_KINDS = ("image", "figure", "photo", "graphic", "diagram")
CAPTION_KINDS = ("caption", "image_caption")


def _width(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c["x1"] - c["x0"])


def _overlap(a: Column, b: Column) -> Column:
    narrow = F.least(_width(a), _width(b))
    shared = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return shared / F.when(narrow == 0, 1.0).otherwise(narrow)


def seed_columns(blocks: Column, page_width: Column) -> Column:
    """Column hulls ``[(x0, x1)]`` in seeding order.

    Blocks (full-width ones aside) come from the left and join the first column that starts near
    them or overlaps them; the column grows with every block.
    """
    narrow = F.filter(blocks, lambda b: _width(b) <= page_width * 0.78)
    usable = F.when(F.size(narrow) > 0, narrow).otherwise(blocks)
    ordered = F.array_sort(F.transform(usable, lambda b: F.struct(
        *[b[n].alias(n) for n in ("x0", "y0", "block_id", "x1")])))
    tolerance = F.greatest(F.lit(24.0), page_width * 0.06)

    def step(columns: Column, b: Column) -> Column:
        near = F.transform(columns, lambda c, i: F.when(
            (F.abs(b["x0"] - c["x0"]) <= tolerance) | (_overlap(b, c) >= 0.35), i))
        own = F.struct(b["x0"].alias("x0"), b["x1"].alias("x1"))

        def place(first: Column) -> Column:
            grown = F.transform(columns, lambda c, i: F.when(i == first, F.struct(
                F.least(c["x0"], b["x0"]).alias("x0"), F.greatest(c["x1"], b["x1"]).alias("x1"))).otherwise(c))
            return F.when(first.isNull(), F.concat(columns, F.array(own))).otherwise(grown)

        return let(F.array_min(near), place)

    return F.aggregate(ordered, F.array().cast("array<struct<x0:double,x1:double>>"), step)


def best_column(block: Column, columns: Column) -> Column:
    """Index of the column with the best overlap less centre distance; ties to the first."""

    def score(c: Column) -> Column:
        away = F.abs(block["x0"] + _width(block) / 2.0 - (c["x0"] + _width(c) / 2.0)) / F.greatest(_width(c), F.lit(1.0))
        return _overlap(block, c) - away

    best = F.array_max(F.transform(columns, lambda c, i: F.struct(score(c).alias("s"), (-i).alias("i"))))
    return let(best, lambda top: F.when(top["s"] > -1.0, -top["i"]).otherwise(F.lit(0)))


def build_columns(blocks: DataFrame) -> DataFrame:
    """Blocks with ``column_index`` (seeding order) and ``column_x0`` (left edge of its blocks)."""
    item = F.struct(*READING, "x1", "y1", "kind", "text")
    pages = blocks.groupBy(*PAGE).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.sort_array(F.collect_list(item)).alias("bs"))
    pages = pages.withColumn("columns", seed_columns(F.col("bs"), F.col("width")))
    # Bound by let: standing once inside the lambda, the columns would be inlined there and seeded anew for every block.
    placed = let(F.col("columns"), lambda columns: F.transform("bs", lambda b: F.struct(b.alias("b"), best_column(b, columns).alias("column_index"))))
    rows = pages.select(*PAGE, "width", "height", F.explode(placed).alias("r"))
    rows = rows.select(*PAGE, "width", "height", "r.column_index", "r.b.*")
    return rows.withColumn("column_x0", F.min("x0").over(Window.partitionBy(*PAGE, "column_index")))


def column_boxes(columned: DataFrame) -> DataFrame:
    return columned.groupBy(*PAGE, "column_index").agg(
        *bbox_union(Box.named()).columns(), F.count(F.lit(1)).alias("n_blocks"))


def headline_score(kind: Column, text: Column, height: Column, median_height: Column) -> Column:
    words = F.filter(F.split(strip(text), f"{SPACE}+"), lambda w: w != "")
    n = F.size(words)
    upper = count_matches(text, r"\p{Lu}") / F.greatest(F.length(strip(text)), F.lit(1))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / F.greatest(n, F.lit(1))
    score = (F.lit(0.6) + F.when(height >= median_height * 1.35, 0.8).otherwise(0.0)
             + F.when(upper >= 0.4, 0.4).otherwise(0.0) + F.when(capital >= 0.5, 0.3).otherwise(0.0))
    none = (n == 0) | strip(text).rlike("[.!?;]$") | (n > 10)
    return F.when(kind.isin(*HEADLINE_KINDS), 2.0).when(none, 0.0).otherwise(score)


def is_headline(kind: Column, score: Column) -> Column:
    return ~kind.isin(*IMAGE_KINDS) & (score >= 1.0)


def column_stats(columned: DataFrame) -> DataFrame:
    """Adds the column's median text height and median positive gap, and the gap above each block."""
    column = Window.partitionBy(*PAGE, "column_index")
    down = column.orderBy(*READING)
    tall = F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(down))
    out = columned.withColumns({"block_height": tall, "gap": gap})
    return out.withColumns({
        "median_height": F.coalesce(F.median(F.when(F.col("text") != "", F.col("block_height"))).over(column), F.lit(24.0)),
        "median_gap": F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(column), F.col("height") * 0.01),
    })


def break_groups(stats: DataFrame) -> DataFrame:
    """Adds ``part``: a new one starts at a headline once the part has text, or at a wide gap."""
    score = headline_score(F.col("kind"), F.col("text"), F.col("block_height"), F.col("median_height"))
    wide = F.col("gap") > F.greatest(F.col("median_gap") * 1.8, F.col("height") * 0.035)
    flagged = stats.withColumn("headline_score", score).withColumns({
        "headline": is_headline(F.col("kind"), F.col("headline_score")),
        "wide": F.coalesce(wide & (F.col("text") != "") & ~F.col("kind").isin(*CAPTION_KINDS), F.lit(False)),
        "has_text": F.col("text") != "",
    })
    rest = [c for c in flagged.columns if c not in (*PAGE, "column_index", *READING)]
    columns = flagged.groupBy(*PAGE, "column_index").agg(
        F.sort_array(F.collect_list(F.struct(*READING, *rest))).alias("bs"))

    def step(acc: Column, b: Column) -> Column:
        cut = (F.size(acc["parts"]) > 0) & ((b["headline"] & acc["text"]) | b["wide"])
        part = F.coalesce(F.get(acc["parts"], F.size(acc["parts"]) - 1), F.lit(0)) + F.when(cut, 1).otherwise(0)
        return F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"),
                        (F.when(cut, b["has_text"]).otherwise(acc["text"] | b["has_text"])).alias("text"))

    start = F.struct(F.array().cast("array<int>").alias("parts"), F.lit(False).alias("text"))
    parts = columns.withColumn("parts", F.aggregate("bs", start, step)["parts"])
    return parts.select(*PAGE, "column_index", F.explode(F.arrays_zip("bs", "parts")).alias("z")).select(
        *PAGE, "column_index", "z.parts", "z.bs.*").withColumnRenamed("parts", "part")


def merge_small_parts(parts: DataFrame) -> DataFrame:
    """Adds ``group``: a part with at most one text block and few words joins the part before it."""
    textual = F.col("has_text") & ~F.col("kind").isin(*IMAGE_KINDS)
    words = F.when(textual, F.size(F.filter(F.split(strip(F.col("text")), f"{SPACE}+"), lambda w: w != ""))).otherwise(0)
    own = Window.partitionBy(*PAGE, "column_index", "part")
    out = parts.withColumns({"n_textual": F.sum(F.when(textual, 1).otherwise(0)).over(own), "n_words": F.sum(words).over(own)})
    small = (F.col("n_textual") <= 1) & (F.col("n_words") < 12) & (F.col("part") > 0)
    first = F.row_number().over(own.orderBy(*READING)) == 1
    out = out.withColumn("starts", F.when(first & ~small, 1).otherwise(0))
    down = Window.partitionBy(*PAGE, "column_index").orderBy("part", *READING)
    return out.withColumn("group", F.sum("starts").over(down)).drop("starts", "n_textual", "n_words")


def emit_articles(groups: DataFrame) -> DataFrame:
    """One row per group that holds text or a picture, numbered column by column, left to right."""
    own = headline_score(F.col("kind"), F.col("text"), F.col("block_height"), F.greatest(F.col("block_height"), F.lit(1.0)))
    hull = bbox_union(Box.named())
    texts = F.sort_array(F.collect_list(F.when(F.col("has_text"), F.struct(*READING, "text"))))
    found = groups.groupBy(*PAGE, "column_index", "group").agg(
        F.min("column_x0").alias("column_x0"), F.max("width").alias("width"), F.max("height").alias("height"),
        *hull.columns(), F.count(F.lit(1)).alias("block_count"),
        F.count_if(is_headline(F.col("kind"), own)).alias("headline_count"),
        F.count_if(F.col("has_text") | F.col("kind").isin(*IMAGE_KINDS)).alias("n_content"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n\n").alias("article_text"))
    found = found.where(F.col("n_content") > 0)
    order = Window.partitionBy(*PAGE).orderBy("column_x0", "column_index", "group")
    box = expand_bbox(Box.named(), F.col("width"), F.col("height"))
    numbered = found.withColumn("article_index", F.row_number().over(order))
    return numbered.select(
        *PAGE, "article_index",
        F.format_string("page-%04d-article-%04d", F.col("page_no"), F.col("article_index")).alias("article_id"),
        "column_index", *box.columns(), strip(F.col("article_text")).alias("article_text"), "block_count", "headline_count")


def segment_pages(blocks: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Articles of all pages, or of those that were also rendered (have a row in ``rendered``)."""
    if rendered is not None:
        blocks = blocks.join(rendered.select(*PAGE).distinct(), PAGE, "left_semi")
    return emit_articles(merge_small_parts(break_groups(column_stats(build_columns(blocks)))))
