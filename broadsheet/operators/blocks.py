"""Page payloads, markup and plain text to blocks; and small block-level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import geometry as geo
from broadsheet.functions import newspaper as news
from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box
from broadsheet.functions.labels import is_image_label, normalize_label

PAGE = ["doc_id", "page_no"]


# -- blocks from markup and text -------------------------------------------------------------

def blocks_from_markup(pages: DataFrame, column: str = "markup") -> DataFrame:
    """``<div data-bbox data-label>`` fragments as blocks, tables as rows, repeats dropped."""
    fragments = F.regexp_extract_all(tx.unescape(F.col(column)), F.lit(r"(?is)<div\b[^>]*>.*?</div>"), F.lit(0))
    found = pages.select(*PAGE, F.posexplode(fragments).alias("i", "fragment"))
    head = F.regexp_extract("fragment", r"(?is)^<div\b([^>]*)>", 1)
    found = found.select(
        *PAGE, "i", F.regexp_extract(head, '(?i)data-bbox="([^"]+)"', 1).alias("bbox"),
        tx.strip(tx.unescape(F.regexp_extract(head, '(?i)data-label="([^"]+)"', 1))).alias("raw_label"),
        F.regexp_extract("fragment", r"(?is)^<div\b[^>]*>(.*?)</div>$", 1).alias("body"))
    found = found.where(F.col("raw_label") != "").select(
        *PAGE, "i", "raw_label", *geo.parse_bbox_text(F.col("bbox")).columns(), "body",
        tx.table_rows_from_html(F.col("body"), tx.fragment_to_text).alias("table_rows"))
    found = found.where(F.col("x0").isNotNull()).select(
        *PAGE, F.format_string("block-%04d", F.col("i") + 1).alias("block_id"), F.col("i").alias("seq"),
        normalize_label(F.col("raw_label"), "text").alias("label"), "raw_label", "x0", "y0", "x1", "y1",
        F.when(F.size("table_rows") > 0, tx.strip(tx.rows_to_tsv(F.col("table_rows"))))
        .otherwise(tx.fragment_to_text(F.col("body"))).alias("text"), "table_rows")
    found = found.where((F.col("text") != "") | (F.col("label") == "image"))
    return _first_by(found, ["label", "x0", "y0", "x1", "y1", "text"])


def _first_by(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The first block in list order of each distinct key of a page, without a window."""
    rest = [c for c in blocks.columns if c not in (*PAGE, *key)]
    first = blocks.groupBy(*PAGE, *key).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in blocks.columns])


def synthetic_layout(docs: DataFrame, width: int, height: int, text: str = "text") -> DataFrame:
    """Boxes for text without any: one line per step down the page, the first one the title."""
    left, top = max(int(width * 0.05), 24), max(int(height * 0.05), 32)
    right, step = min(width - left, width - 24), max(int(height * 0.08), 72)
    keep = [c for c in docs.columns if c != text]
    found = docs.select(*keep, F.posexplode(tx.non_empty_lines(F.col(text))).alias("i", "line"))
    first = F.col("i") == 0
    tall = F.when(first, max(int(height * 0.05), 42)).otherwise(max(int(height * 0.04), 42))
    y0 = F.lit(top) + F.col("i") * step
    return found.select(
        *keep, F.col("i").alias("seq"), F.when(first, "title").otherwise("text").alias("label"),
        F.lit(left).alias("x0"), y0.alias("y0"), F.lit(right).alias("x1"),
        F.least(F.lit(height - 24), y0 + tall).alias("y1"),
        tx.strip(F.regexp_replace("line", "^#+", "")).alias("text"), F.lit(0.0).alias("confidence"))


# -- regions and lines -----------------------------------------------------------------------

BAND = 256


def _bands(box: Box) -> Column:
    return F.sequence(F.floor(box.y0 / BAND), F.floor(F.greatest(box.y1, box.y0) / BAND))


def best_region(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds ``region_label``: of the first region holding the line, else of the largest overlap.

    Both sides are cut into bands down the page and meet on (page, band), so a crowded page
    spreads over many keys and only neighbours are compared.
    """
    line, region = Box.named("l_"), Box.named("r_")
    left = lines.select(*PAGE, "block_id", *Box.named().columns("l_"), F.explode(_bands(Box.named())).alias("band"))
    right = regions.select(
        *PAGE, F.col("seq").alias("r_seq"), F.col("label").alias("r_label"), *Box.named().columns("r_"),
        F.explode(_bands(Box.named())).alias("band"))
    holds = geo.box_contains(region, line)
    area = geo.intersection_area(region, line)
    pairs = left.join(right, [*PAGE, "band"]).where(holds | (area > 0))
    rank = F.struct(holds.cast("int"), F.when(holds, -F.col("r_seq")), area, -F.col("r_seq"))
    best = pairs.groupBy(*PAGE, "block_id").agg(F.max_by("r_label", rank).alias("region_label"))
    return lines.join(best, [*PAGE, "block_id"], "left")


def infer_label(parser: Column, region: Column, text: Column, box: Box, median_height: Column,
                page_width: Column, page_height: Column) -> Column:
    """Label of a text line; the first rule that applies decides."""
    region_label = normalize_label(region)
    low = F.lower(F.coalesce(region, F.lit("")))
    bare = tx.strip(text)
    tall, wide = geo.bbox_height(box), box.x1 - box.x0
    plain = ("text", "unknown")
    small = tall <= F.greatest(F.lit(12), F.floor(median_height * 0.95))
    return (
        F.when(~parser.isin(*plain), parser)
        .when(~region_label.isin(*plain), region_label)
        .when(news.contains_any(low, ("title", "headline", "section", "doc_title", "subheadline")), "title")
        .when(news.contains_any(low, ("caption", "vision_footnote")), "caption")
        .when(F.contains(low, F.lit("advert")) | low.rlike(r"(?:^|[_\-\s])ad(?:$|[_\-\s])"), "advertisement")
        .when(bare == "", "unknown")
        .when((box.y0 <= page_height * 0.04) & (F.length(bare) <= 50), "header")
        .when((box.y1 >= page_height * 0.97) & ((F.length(bare) <= 40) | bare.rlike(r"\p{Nd}")), "footer")
        .when(news.looks_like_ad(bare), "advertisement")
        .when(small & (F.length(bare) <= 80) & (wide <= page_width * 0.7)
              & news.contains_any(bare, ("사진", "자료", "연합뉴스", "기자", "caption", "photo")), "caption")
        .when((tall >= median_height * 1.75) & (F.length(bare) <= 48) & (wide < page_width * 0.85)
              & (box.y0 <= page_height * 0.35) & ~bare.rlike("[.!?]$"), "title")
        .when(F.contains(low, F.lit("header")), "header")
        .when(F.contains(low, F.lit("footer")), "footer")
        .when(parser != "unknown", parser)
        .otherwise("text")
    )


def upper_median_height(blocks: DataFrame, default: int = 20) -> DataFrame:
    """Per page the upper median of the heights of blocks with text, from counts per height."""
    counts = blocks.where(tx.strip(F.col("text")) != "").groupBy(
        *PAGE, geo.bbox_height(Box.named()).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("hs"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("h"))

    def step(acc: Column, item: Column) -> Column:
        seen = acc["seen"] + item["n"]
        hit = acc["h"].isNull() & (seen > F.floor(F.col("total") / 2))
        return F.struct(seen.alias("seen"), F.when(hit, item["h"]).otherwise(acc["h"]).cast("int").alias("h"))

    return listed.select(*PAGE, F.coalesce(F.aggregate("hs", start, step)["h"], F.lit(default)).alias("median_height"))


def merge_blocks(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Labelled text lines and the page's distinct picture regions as one block table."""
    medians = upper_median_height(lines)
    labelled = best_region(lines, regions).join(medians, PAGE, "left")
    label = infer_label(F.col("label"), F.col("region_label"), F.col("text"), Box.named(),
                        F.coalesce("median_height", F.lit(20)), F.col("width"), F.col("height"))
    text_part = labelled.select(
        *PAGE, "width", "height", "block_id", label.alias("label"), *Box._fields, "text", "confidence",
        F.col("region_label").alias("layout_label"))
    pictures = dedupe_images(regions.where(is_image_label(F.col("label"))))
    image_part = pictures.select(
        *PAGE, "width", "height", F.concat_ws("-", F.lit("image"), "page_no", F.col("seq") + 1).alias("block_id"),
        normalize_label(F.col("label"), "image").alias("label"), *Box._fields, F.lit("").alias("text"),
        F.col("confidence"), F.lower("label").alias("layout_label"))
    return text_part.unionByName(image_part)


def dedupe_images(regions: DataFrame) -> DataFrame:
    """Drops a region that an earlier kept one covers to nine tenths."""
    item = F.struct("seq", *[c for c in regions.columns if c not in (*PAGE, "seq")])
    pages = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("rs"))

    def covered(r: Column, kept: Column) -> Column:
        area = F.greatest(F.lit(1), geo.bbox_area(Box.of(r)))
        return F.exists(kept, lambda k: geo.intersection_area(Box.of(r), Box.of(k)) / area >= 0.9)

    empty = F.filter("rs", lambda r: F.lit(False))
    kept = F.aggregate("rs", empty, lambda acc, r: F.when(covered(r, acc), acc).otherwise(F.concat(acc, F.array(r))))
    return pages.select(*PAGE, F.explode(kept).alias("r")).select(*PAGE, "r.*").select(*regions.columns)


def fits_table(image: Box, table: Box, max_gap: Column) -> Column:
    """A picture lies in the table's width and inside it or just above."""
    tw, iw = F.greatest(F.lit(1), table.x1 - table.x0), F.greatest(F.lit(1), image.x1 - image.x0)
    cx = geo.center_x(image)
    shared = F.greatest(F.lit(0), F.least(image.x1, table.x1) - F.greatest(image.x0, table.x0))
    gap = table.y0 - image.y1
    return (
        (iw <= tw * 1.08) & (cx >= table.x0 - tw * 0.08) & (cx <= table.x1 + tw * 0.08)
        & (shared / F.least(iw, tw) >= 0.45) & (geo.box_contains(table, image) | ((gap >= 0) & (gap <= max_gap)))
    )


def embed_images_in_tables(blocks: DataFrame, medians: DataFrame) -> DataFrame:
    """Pictures go to the first table they fit; the table's box grows over them afterwards.

    Adds ``embedded_in_table`` to pictures; tables keep their own box as ``original_*``. Pictures
    and tables meet on bands of the page, a picture reaching down as far as the gap allows.
    """
    limit = F.greatest(F.coalesce("median_height", F.lit(20)) * 3, F.floor(F.col("height") * 0.08), F.lit(24)).cast("int")
    sized = blocks.join(medians, PAGE, "left").withColumn("max_gap", limit).drop("median_height")
    tables = sized.where((F.col("label") == "table") & F.col("has_rows")).select(
        *PAGE, F.col("seq").alias("t_seq"), F.col("block_id").alias("t_id"), *Box.named().columns("t_"),
        F.explode(_bands(Box.named())).alias("band"))
    reach = Box.named()._replace(y1=F.col("y1") + F.col("max_gap"))
    images = sized.where(F.col("label") == "image").select(
        *PAGE, "block_id", "max_gap", *Box.named().columns("i_"), F.explode(_bands(reach)).alias("band"))
    hits = images.join(tables, [*PAGE, "band"]).where(fits_table(Box.named("i_"), Box.named("t_"), F.col("max_gap")))
    chosen = hits.groupBy(*PAGE, "block_id").agg(
        F.min_by(F.struct("t_id", *[F.col(f"i_{s}") for s in Box._fields]), "t_seq").alias("c"))
    chosen = chosen.select(*PAGE, "block_id", F.col("c.t_id").alias("embedded_in_table"), *[f"c.i_{s}" for s in Box._fields])
    grown = chosen.groupBy(*PAGE, F.col("embedded_in_table").alias("block_id")).agg(
        *geo.bbox_union(Box.named("i_")).columns("g_"), F.count(F.lit(1)).alias("embedded_images"))
    out = sized.drop("max_gap").join(chosen.select(*PAGE, "block_id", "embedded_in_table"), [*PAGE, "block_id"], "left")
    out = out.join(grown, [*PAGE, "block_id"], "left")
    box, own = Box.named("g_"), Box.named()
    union = geo.clamp_bbox(Box(F.least(own.x0, box.x0), F.least(own.y0, box.y0), F.greatest(own.x1, box.x1),
                               F.greatest(own.y1, box.y1)), F.col("width"), F.col("height"))
    moved = F.col("g_x0").isNotNull()
    final = Box(*[F.when(moved, u).otherwise(o) for u, o in zip(union, own)])
    original = [F.when(moved, o).alias(f"original_{s}") for s, o in own._asdict().items()]
    rest = [c for c in blocks.columns if c not in Box._fields]
    return out.select(*rest, *final.columns(), *original, "embedded_in_table", "embedded_images")


# -- page selection and reuse ----------------------------------------------------------------

def select_pages(pages: DataFrame, page_range: list[int] | None = None, max_pages: int | None = None,
                 doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Pages by zero-based position within their document, then at most the first ``max_pages``."""
    over = Window.partitionBy(doc).orderBy(page)
    out = pages
    if page_range is not None:
        out = out.withColumn("_at", F.row_number().over(over) - 1).where(F.col("_at").isin(list(page_range))).drop("_at")
    if max_pages is not None:
        out = out.withColumn("_at", F.row_number().over(over)).where(F.col("_at") <= max_pages).drop("_at")
    return out


# Outputs stored for a finished page.
PAGE_OUTPUTS = ("markdown", "html", "json", "metadata")


def pending_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages without all four stored outputs; ``stored`` has one row per page and output."""
    complete = stored.where(F.col("output").isin(*PAGE_OUTPUTS)).groupBy(*PAGE).agg(
        F.count_distinct("output").alias("n")).where(F.col("n") == len(PAGE_OUTPUTS))
    return pages.join(complete, PAGE, "left_anti")


def batch_pages(pages: DataFrame, n: int) -> DataFrame:
    """Adds ``batch``: consecutive pages of a document, ``n`` at a time."""
    if n <= 0:
        raise ValueError("Batch size must be greater than zero.")
    over = Window.partitionBy("doc_id").orderBy("page_no")
    return pages.withColumn("batch", F.floor((F.row_number().over(over) - 1) / n).cast("int"))


def best_variant(scores: DataFrame) -> DataFrame:
    """The layout kept per page: the first one unless unacceptable and beaten by a retry.

    Rows are ``(doc_id, page_no, variant, score, acceptable)``; variant 0 is the first attempt.
    """
    first = F.max(F.when(F.col("variant") == 0, F.struct("score", "acceptable", "variant")))
    retry = F.max(F.when(F.col("variant") > 0, F.struct(F.col("score"), (-F.col("variant")).alias("rank"))))
    best = scores.groupBy(*PAGE).agg(first.alias("first"), retry.alias("retry"))
    switch = F.coalesce(~F.col("first.acceptable") & (F.col("retry.score") > F.col("first.score")), F.lit(False))
    return best.select(*PAGE, F.when(switch, -F.col("retry.rank")).otherwise(F.lit(0)).alias("variant"),
                       F.when(switch, F.col("retry.score")).otherwise(F.col("first.score")).alias("score"))


def apply_block_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited label, text and table rows by position; the latest edit of a block counts.

    Text of a table left blank is rebuilt from its rows, other labels lose their rows. ``edits``
    holds null for a part that is not changed.
    """
    wins = edits.groupBy("doc_id", "page_no", "seq").agg(F.max_by(
        F.struct(F.col("label").alias("e_label"), F.col("text").alias("e_text"), F.col("table_rows").alias("e_rows"),
                 F.col("updated_at").alias("e_at")), "updated_at").alias("e"))
    out = blocks.join(wins, ["doc_id", "page_no", "seq"], "left")
    hit = F.col("e").isNotNull()
    label = F.when(F.col("e.e_label").isNotNull(), normalize_label(F.col("e.e_label"))).otherwise(F.col("label"))
    rows = F.filter(F.transform(F.slice("e.e_rows", 1, 500), lambda r: F.transform(F.slice(r, 1, 80), tx.strip)),
                    lambda r: F.exists(r, lambda c: c != ""))
    text = F.coalesce("e.e_text", "text")
    refilled = F.when((label == "table") & F.col("e.e_rows").isNotNull() & (tx.strip(text) == ""), tx.rows_to_tsv(rows)).otherwise(text)
    new_rows = F.when(label != "table", None).otherwise(F.coalesce(rows, F.col("table_rows")))
    unknown = F.when(hit & (label == "unknown"), F.raise_error(F.lit("unsupported block label")))
    keep = [c for c in blocks.columns if c not in ("label", "text", "table_rows")]
    return out.select(
        *keep, F.coalesce(unknown.cast("string"), label).alias("label"), F.when(hit, refilled).otherwise(F.col("text")).alias("text"),
        F.when(hit, new_rows).otherwise(F.col("table_rows")).alias("table_rows"),
        F.when(hit, F.col("label")).alias("original_label"), hit.alias("edited"), F.col("e.e_at").alias("updated_at"))


# -- scaling ---------------------------------------------------------------------------------

def normalize_page_boxes(blocks: DataFrame) -> DataFrame:
    """Boxes scaled or clamped to the page, decided once per page from its reach.

    The reach is aggregated before the shuffle and joined back, not windowed.
    """
    reach = blocks.groupBy(*PAGE).agg(F.max("x1").alias("_x"), F.max("y1").alias("_y"))
    joined = blocks.join(reach, PAGE)
    scale = geo.needs_scaling(F.col("_x"), F.col("_y"), F.col("width"), F.col("height"))
    box = geo.normalize_bboxes(Box.named(), F.col("width"), F.col("height"), scale)
    return joined.withColumns({f"n_{s}": v for s, v in box._asdict().items()}).drop("_x", "_y", *Box._fields) \
        .withColumnsRenamed({f"n_{s}": s for s in Box._fields})
