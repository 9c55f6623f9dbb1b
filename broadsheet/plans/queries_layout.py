"""Blocks, columns, articles, captions and quality over sheets laid out from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box
from broadsheet.functions.labels import QUALITY_TEXT_LABELS
from broadsheet.operators import blocks as bl
from broadsheet.operators import cluster as cl
from broadsheet.operators import models, page_articles, quality, relevance, segment
from broadsheet.plans import inputs
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import LINES_SQL, SHEET_SQL, sheet_blocks, table
from broadsheet.sources import payloads

PAGE = ["doc_id", "page_no"]
W, H = 2480, 3509
TEXTUAL = "(" + ", ".join(q.lit(x) for x in QUALITY_TEXT_LABELS) + ")"


# -- blocks ----------------------------------------------------------------------------------

@query("synthetic_layout", f"""WITH {LINES_SQL}
SELECT doc_id, lang, line_no AS seq, CASE line_no WHEN 0 THEN 'title' ELSE 'text' END AS label, 124 AS x0, 175 + line_no * 280 AS y0, 2356 AS x1,
  least(3485, 175 + line_no * 280 + CASE line_no WHEN 0 THEN 175 ELSE 140 END) AS y1, {q.strip(q.sub('line', '^#+', ''))} AS text FROM lines""")
def q_synthetic_layout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return bl.synthetic_layout(docs, W, H).drop("confidence")


def document_pages(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return bl.synthetic_layout(docs, W, H).withColumn("page_no", F.lit(1))


MARKS = {"title": "Section-Header", "text": "Text", "caption": "Caption", "image": "Picture", "header": "pageHeader"}


def sheet_markup(spark, sf_dir) -> DataFrame:
    """Sheets as the tagged markup a page model returns; one block in five is given twice."""
    b = sheet_blocks(spark, sf_dir)
    mark = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in MARKS.items()])
    div = F.concat(F.lit('<div class="b" data-bbox="'), F.concat_ws(" ", *Box._fields), F.lit('" data-label="'), mark, F.lit('"><p>'),
                   F.regexp_replace("text", "[<>&]", " "), F.lit("</p></div>\n"))
    twice = F.when(F.col("seq") % 5 == 0, F.concat(div, div)).otherwise(div)
    parts = b.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("seq", twice.alias("div")))).alias("d"))
    return parts.select(*PAGE, F.array_join(F.transform("d", lambda d: d["div"]), "").alias("markup"))


@query("blocks_from_markup", f"""WITH {SHEET_SQL}
SELECT DISTINCT doc_id, page_no, label, x0, y0, x1, y1, {q.strip(q.sub('text', '[<>&]', ' '))} AS text FROM sheet
WHERE {q.strip(q.sub('text', '[<>&]', ' '))} <> '' OR label = 'image'""")
def q_blocks_from_markup(spark, sf_dir):
    return bl.blocks_from_markup(sheet_markup(spark, sf_dir)).select(*PAGE, "label", *Box._fields, "text")


def sheet_regions(spark, sf_dir) -> DataFrame:
    """Two regions per column of each sheet, overlapping each other, and one across the top."""
    pages = sheet_blocks(spark, sf_dir).select(*PAGE, "width", "height").distinct()
    regions = [(0, "header", 100, 40, 1600, 140)]
    for c in range(4):
        regions.append((1 + 2 * c, "section_header" if c % 2 else "paragraph", 110 + 570 * c, 400, 640 + 570 * c, 1500))
        regions.append((2 + 2 * c, "caption", 110 + 570 * c, 1300, 500 + 570 * c, 3480))
    parts = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("seq", "label", *Box._fields), r)]) for r in regions]
    return pages.select(*PAGE, "width", "height", F.explode(F.array(*parts)).alias("r")).select(*PAGE, "width", "height", "r.*")


_REGION_ROWS = ["(0, 'header', 100, 40, 1600, 140)"] + [
    row for c in range(4) for row in (
        f"({1 + 2 * c}, '{'section_header' if c % 2 else 'paragraph'}', {110 + 570 * c}, 400, {640 + 570 * c}, 1500)",
        f"({2 + 2 * c}, 'caption', {110 + 570 * c}, 1300, {500 + 570 * c}, 3480)")]
REGION_SQL = f"""{SHEET_SQL}, regions(r_seq, r_label, rx0, ry0, rx1, ry1) AS (VALUES {', '.join(_REGION_ROWS)}),
text_lines AS (SELECT * FROM sheet WHERE label <> 'image'),
scored AS (SELECT l.*, r.*, (rx0 <= x0 AND ry0 <= y0 AND rx1 >= x1 AND ry1 >= y1) AS holds,
    greatest(0, least(rx1, x1) - greatest(rx0, x0)) * greatest(0, least(ry1, y1) - greatest(ry0, y0)) AS shared FROM text_lines l, regions r),
best AS (SELECT doc_id, page_no, block_id, r_label FROM scored WHERE holds OR shared > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, block_id ORDER BY holds DESC, CASE WHEN holds THEN r_seq END, shared DESC, r_seq) = 1),
regioned AS (SELECT t.*, b.r_label FROM text_lines t LEFT JOIN best b USING (doc_id, page_no, block_id))"""


@query("best_region", f"WITH {REGION_SQL} SELECT doc_id, page_no, block_id, r_label AS region_label FROM regioned")
def q_best_region(spark, sf_dir):
    text = sheet_blocks(spark, sf_dir).where(F.col("label") != "image")
    return bl.best_region(text, sheet_regions(spark, sf_dir)).select(*PAGE, "block_id", "region_label")


# Lines as a parser without layout knowledge gives them: all plain text.
_BARE = q.strip("text")
_RISE = "greatest(0, y1 - y0)"
INFER_SQL = f"""CASE WHEN r_label = 'header' THEN 'header' WHEN r_label = 'section_header' THEN 'title' WHEN r_label = 'caption' THEN 'caption'
  WHEN {_BARE} = '' THEN 'unknown' WHEN y0 <= {H} * 0.04 AND length({_BARE}) <= 50 THEN 'header'
  WHEN y1 >= {H} * 0.97 AND (length({_BARE}) <= 40 OR regexp_matches({_BARE}, '[0-9]')) THEN 'footer' WHEN {q.looks_like_ad(_BARE)} THEN 'advertisement'
  WHEN {_RISE} <= greatest(12, floor(m * 0.95)) AND length({_BARE}) <= 80 AND x1 - x0 <= {W} * 0.7
    AND {q.has_any(_BARE, ('사진', '자료', '연합뉴스', '기자', 'caption', 'photo'))} THEN 'caption'
  WHEN {_RISE} >= m * 1.75 AND length({_BARE}) <= 48 AND x1 - x0 < {W} * 0.85 AND y0 <= {H} * 0.35 AND NOT regexp_matches({_BARE}, '[.!?]$') THEN 'title'
  ELSE 'text' END"""
MEDIAN_SQL = f"""medians AS (SELECT doc_id, page_no, list_sort(list({_RISE}))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM text_lines
  WHERE {_BARE} <> '' GROUP BY doc_id, page_no)"""


@query("merge_blocks", f"""WITH {REGION_SQL}, {MEDIAN_SQL}
SELECT doc_id, page_no, block_id, {INFER_SQL} AS label, x0, y0, x1, y1 FROM regioned JOIN medians USING (doc_id, page_no)
UNION ALL SELECT doc_id, page_no, 'image-' || page_no || '-' || (seq + 1), 'image', x0, y0, x1, y1 FROM sheet WHERE label = 'image'""")
def q_merge_blocks(spark, sf_dir):
    b = sheet_blocks(spark, sf_dir)
    text = b.where(F.col("label") != "image").withColumn("label", F.lit("text"))
    pictures = b.where(F.col("label") == "image").select(*PAGE, "width", "height", "seq", F.lit("figure").alias("label"), *Box._fields, "confidence")
    regions = sheet_regions(spark, sf_dir).withColumn("confidence", F.lit(0.0)).unionByName(pictures.withColumn("seq", F.col("seq") + 100))
    merged = bl.merge_blocks(text, regions)
    name = F.when(F.col("label") == "image", F.concat_ws(
        "-", F.lit("image"), "page_no", F.element_at(F.split("block_id", "-"), 3).cast("int") - 100)).otherwise(F.col("block_id"))
    return merged.select(*PAGE, name.alias("block_id"), "label", *Box._fields)


@query("infer_label", f"WITH {REGION_SQL}, {MEDIAN_SQL} SELECT doc_id, page_no, block_id, {INFER_SQL} AS label FROM regioned JOIN medians USING (doc_id, page_no)")
def q_infer_label(spark, sf_dir):
    text = sheet_blocks(spark, sf_dir).where(F.col("label") != "image")
    found = bl.best_region(text, sheet_regions(spark, sf_dir)).join(bl.upper_median_height(text), PAGE)
    label = bl.infer_label(F.lit("text"), F.col("region_label"), F.col("text"), Box.named(), F.col("median_height"), F.lit(W), F.lit(H))
    return found.select(*PAGE, "block_id", label.alias("label"))


@query("dedupe_images", f"""WITH {SHEET_SQL} SELECT doc_id, page_no, seq * 2 AS seq FROM sheet WHERE label = 'image'
  UNION ALL SELECT doc_id, page_no, seq * 2 + 1 FROM sheet WHERE label = 'image' AND seq % 2 = 1""")
def q_dedupe_images(spark, sf_dir):
    """Each picture with a twin: shifted slightly (covered) or by half its height (kept)."""
    b = sheet_blocks(spark, sf_dir).where(F.col("label") == "image")
    shift = F.when(F.col("seq") % 2 == 1, 90).otherwise(9)
    twin = b.withColumns({"y0": F.col("y0") + shift, "y1": F.col("y1") + shift, "twin": F.lit(1)})
    regions = b.withColumn("twin", F.lit(0)).unionByName(twin).withColumn("seq", F.col("seq") * 2 + F.col("twin"))
    return bl.dedupe_images(regions.select(*PAGE, "seq", "label", *Box._fields)).select(*PAGE, "seq")


def sheet_tables(spark, sf_dir) -> DataFrame:
    """Sheets whose captions are tables; a picture above one may belong to it."""
    return sheet_blocks(spark, sf_dir).withColumn("label", F.when(F.col("label") == "caption", "table").otherwise(F.col("label"))).withColumn(
        "has_rows", F.col("seq") % 3 != 0)


_GAP = f"greatest(coalesce(m, 20) * 3, floor({H} * 0.08), 24)"


@query("embed_images_in_tables", f"""WITH {SHEET_SQL}, text_lines AS (SELECT * FROM sheet WHERE label <> 'image'), {MEDIAN_SQL},
i AS (SELECT * FROM sheet WHERE label = 'image'), t AS (SELECT * FROM sheet WHERE label = 'caption' AND seq % 3 <> 0),
hit AS (SELECT i.doc_id, i.page_no, i.block_id, t.block_id AS table_id, i.x0, i.y0, i.x1, i.y1 FROM i JOIN t USING (doc_id, page_no) LEFT JOIN medians USING (doc_id, page_no)
  WHERE greatest(1, i.x1 - i.x0) <= greatest(1, t.x1 - t.x0) * 1.08 AND (i.x0 + i.x1) / 2 BETWEEN t.x0 - (t.x1 - t.x0) * 0.08 AND t.x1 + (t.x1 - t.x0) * 0.08
  AND greatest(0, least(i.x1, t.x1) - greatest(i.x0, t.x0)) / least(i.x1 - i.x0, t.x1 - t.x0) >= 0.45
  AND ((t.x0 <= i.x0 AND t.y0 <= i.y0 AND t.x1 >= i.x1 AND t.y1 >= i.y1) OR t.y0 - i.y1 BETWEEN 0 AND {_GAP})
  QUALIFY row_number() OVER (PARTITION BY i.doc_id, i.page_no, i.block_id ORDER BY t.seq) = 1),
g AS (SELECT doc_id, page_no, table_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM hit GROUP BY doc_id, page_no, table_id)
SELECT s.doc_id, s.page_no, s.block_id, h.table_id AS embedded_in_table, coalesce(least(s.y0, g.y0), s.y0) AS y0, coalesce(greatest(s.x1, g.x1), s.x1) AS x1,
  CASE WHEN g.y0 IS NOT NULL THEN s.y0 END AS original_y0
FROM sheet s LEFT JOIN hit h USING (doc_id, page_no, block_id) LEFT JOIN g ON g.doc_id = s.doc_id AND g.page_no = s.page_no AND g.table_id = s.block_id""")
def q_embed_images_in_tables(spark, sf_dir):
    b = sheet_tables(spark, sf_dir)
    out = bl.embed_images_in_tables(b, bl.upper_median_height(b.where(F.col("label") != "image")))
    return out.select(*PAGE, "block_id", "embedded_in_table", "y0", "x1", "original_y0")


def sheet_payloads(spark, sf_dir, style: str) -> DataFrame:
    """Sheets as nested page payloads: blocks inside columns inside the page."""
    b = sheet_blocks(spark, sf_dir)
    box = F.array(*Box._fields)
    item = F.struct(F.col("label").alias("type"), box.alias("bbox"), F.col("text").alias("text" if style == "a" else "content"), F.col("confidence").alias("score"))
    listed = b.groupBy(*PAGE, "width", "height").agg(F.sort_array(F.collect_list(F.struct("seq", item.alias("item")))).alias("l"))
    node = F.struct(F.col("page_no").alias("page_no"), F.struct(F.transform("l", lambda i: i["item"]).alias("children")).alias("layout"))
    return listed.select(*PAGE, "width", "height", F.to_json(node).alias("payload"))


@query("flatten_payload_a", f"""WITH {SHEET_SQL},
kept AS (SELECT doc_id, page_no, label, x0, y0, x1, y1, text, min(seq) AS seq FROM sheet GROUP BY ALL)
SELECT doc_id, page_no, label AS kind, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, text,
  printf('block-%04d', row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq)) AS block_id FROM kept""")
def q_flatten_payload_a(spark, sf_dir):
    return payloads.flatten_payload_a(sheet_payloads(spark, sf_dir, "a")).select(*PAGE, "kind", *Box._fields, "text", "block_id")


@query("flatten_payload_b", f"""WITH {SHEET_SQL}
SELECT DISTINCT doc_id, page_no, CASE WHEN label = 'text' AND text LIKE '#%' THEN 'title' ELSE label END AS label, x0, y0, x1, least(y1, {H}) AS y1, text FROM sheet""")
def q_flatten_payload_b(spark, sf_dir):
    return payloads.flatten_payload_b(sheet_payloads(spark, sf_dir, "b")).select(*PAGE, "label", *Box._fields, "text")


# -- page selection --------------------------------------------------------------------------

PAGE_LIST = "p AS (SELECT DISTINCT doc_id, page_no FROM sheet)"


def page_list(spark, sf_dir) -> DataFrame:
    return sheet_blocks(spark, sf_dir).select(*PAGE).distinct()


@query("select_pages", f"""WITH {SHEET_SQL}, {PAGE_LIST}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS place FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rn FROM n WHERE place IN (0, 2, 3)) SELECT doc_id, page_no FROM k WHERE rn <= 2""")
def q_select_pages(spark, sf_dir):
    return bl.select_pages(page_list(spark, sf_dir), [0, 2, 3], 2)


def stored_outputs(spark, sf_dir) -> DataFrame:
    pages = page_list(spark, sf_dir)
    outputs = F.array(*map(F.lit, bl.PAGE_OUTPUTS))
    return pages.select(*PAGE, F.explode(F.slice(outputs, 1, (F.col("doc_id") % 5).cast("int"))).alias("output"))


@query("pending_pages", f"WITH {SHEET_SQL}, {PAGE_LIST} SELECT doc_id, page_no FROM p WHERE doc_id % 5 < 4")
def q_pending_pages(spark, sf_dir):
    return bl.pending_pages(page_list(spark, sf_dir), stored_outputs(spark, sf_dir))


@query("batch_pages", f"WITH {SHEET_SQL}, {PAGE_LIST} SELECT doc_id, page_no, CAST((page_no - 1) // 2 AS INT) AS batch FROM p")
def q_batch_pages(spark, sf_dir):
    return bl.batch_pages(page_list(spark, sf_dir), 2)


VARIANT_SQL = """v AS (SELECT user_id AS doc_id, 1 AS page_no, event_id % 3 AS variant, round(value, 2) AS score, event_type <> 'error' AS acceptable, event_id FROM events),
w AS (SELECT doc_id, page_no, variant, max(score) AS score, bool_and(acceptable) AS acceptable FROM v GROUP BY 1, 2, 3)"""


@query("best_variant", f"""WITH {VARIANT_SQL},
f AS (SELECT * FROM w WHERE variant = 0), r AS (SELECT doc_id, max(score) AS score FROM w WHERE variant > 0 GROUP BY doc_id),
rv AS (SELECT w.doc_id, min(variant) AS variant FROM w JOIN r USING (doc_id, score) WHERE w.variant > 0 GROUP BY w.doc_id)
SELECT f.doc_id, f.page_no, CASE WHEN NOT f.acceptable AND r.score > f.score THEN rv.variant ELSE 0 END AS variant,
  CASE WHEN NOT f.acceptable AND r.score > f.score THEN r.score ELSE f.score END AS score FROM f LEFT JOIN r USING (doc_id) LEFT JOIN rv USING (doc_id)""")
def q_best_variant(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scores = e.groupBy(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("event_id") % 3).alias("variant")).agg(
        F.max(F.round("value", 2)).alias("score"), F.bool_and(F.col("event_type") != "error").alias("acceptable"))
    has_first = scores.where(F.col("variant") == 0).select("doc_id")
    return bl.best_variant(scores.join(has_first, "doc_id", "left_semi"))


@query("apply_block_edits", f"""WITH {SHEET_SQL}
SELECT doc_id, page_no, block_id, CASE WHEN seq % 4 = 1 THEN 'table' ELSE label END AS label,
  CASE WHEN seq % 4 = 1 THEN 'a' || chr(9) || doc_id ELSE text END AS text, CASE WHEN seq % 4 = 1 THEN label END AS original_label, seq % 4 = 1 AS edited FROM sheet""")
def q_apply_block_edits(spark, sf_dir):
    b = sheet_blocks(spark, sf_dir).withColumn("table_rows", F.lit(None).cast("array<array<string>>"))
    hit = b.where(F.col("seq") % 4 == 1)
    rows = F.array(F.array(F.lit(" a "), F.col("doc_id").cast("string")), F.array(F.lit(" "), F.lit("")))
    first = hit.select(*PAGE, "seq", F.lit("text").alias("label"), F.lit("old").alias("text"), F.lit(None).cast("array<array<string>>").alias("table_rows"),
                       F.lit(1).alias("updated_at"))
    last = hit.select(*PAGE, "seq", F.lit("tableGroup").alias("label"), F.lit(" ").alias("text"), rows.alias("table_rows"), F.lit(2).alias("updated_at"))
    return bl.apply_block_edits(b, first.unionByName(last)).select(*PAGE, "block_id", "label", "text", "original_label", "edited")


@query("upper_median_height", f"WITH {SHEET_SQL}, text_lines AS (SELECT * FROM sheet WHERE label <> 'image'), {MEDIAN_SQL} SELECT doc_id, page_no, m AS median_height FROM medians")
def q_upper_median_height(spark, sf_dir):
    return bl.upper_median_height(sheet_blocks(spark, sf_dir).where(F.col("label") != "image"))


# -- column-wise segmentation ----------------------------------------------------------------

def column_blocks(spark, sf_dir) -> DataFrame:
    b = sheet_blocks(spark, sf_dir).where(F.col("label") != "header")
    return b.select(*PAGE, "width", "height", "block_id", F.col("label").alias("kind"), *[F.col(s).cast("double").alias(s) for s in Box._fields], "text")


# The sheets' columns lie far apart, so the fold must find the known column of each block.
COLS_SQL = f"""{SHEET_SQL}, body AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY col) - 1 AS column_index FROM sheet WHERE label <> 'header')"""


@query("build_columns", f"WITH {COLS_SQL} SELECT doc_id, page_no, block_id, column_index FROM body")
def q_build_columns(spark, sf_dir):
    return segment.build_columns(column_blocks(spark, sf_dir)).select(*PAGE, "block_id", "column_index")


@query("column_boxes", f"""WITH {COLS_SQL} SELECT doc_id, page_no, column_index, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1,
  CAST(max(y1) AS DOUBLE) AS y1, count(*) AS n_blocks FROM body GROUP BY 1, 2, 3""")
def q_column_boxes(spark, sf_dir):
    return segment.column_boxes(segment.build_columns(column_blocks(spark, sf_dir)))


STATS_SQL = f"""{COLS_SQL}, g AS (SELECT *, greatest(0, y1 - y0) AS bh, greatest(0, y0 - lag(y1) OVER (PARTITION BY doc_id, page_no, column_index ORDER BY y0, x0, block_id)) AS gap FROM body),
stats AS (SELECT *, coalesce(median(CASE WHEN text <> '' THEN bh END) OVER c, 24) AS mh, coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER c, {H} * 0.01) AS mg
  FROM g WINDOW c AS (PARTITION BY doc_id, page_no, column_index))"""


@query("column_stats", f"WITH {STATS_SQL} SELECT doc_id, page_no, block_id, round(mh, 3) AS median_height, round(mg, 3) AS median_gap FROM stats")
def q_column_stats(spark, sf_dir):
    out = segment.column_stats(segment.build_columns(column_blocks(spark, sf_dir)))
    return out.select(*PAGE, "block_id", F.round("median_height", 3).alias("median_height"), F.round("median_gap", 3).alias("median_gap"))


_WORDS = f"list_filter(regexp_split_to_array({q.strip('text')}, '{tx.SPACE}+'), lambda w: w <> '')"


@query("headline_score", f"""WITH {STATS_SQL}, w AS (SELECT *, {_WORDS} AS words FROM stats)
SELECT doc_id, page_no, block_id, round(CASE WHEN label = 'title' THEN 2.0 WHEN len(words) = 0 OR regexp_matches({q.strip('text')}, '[.!?;]$') OR len(words) > 10 THEN 0.0
  ELSE 0.6 + CASE WHEN bh >= mh * 1.35 THEN 0.8 ELSE 0 END
    + CASE WHEN (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g'))) / greatest(length({q.strip('text')}), 1) >= 0.4 THEN 0.4 ELSE 0 END
    + CASE WHEN len(list_filter(words, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / greatest(len(words), 1) >= 0.5 THEN 0.3 ELSE 0 END END, 4) AS score FROM w""")
def q_headline_score(spark, sf_dir):
    out = segment.column_stats(segment.build_columns(column_blocks(spark, sf_dir)))
    score = segment.headline_score(F.col("kind"), F.col("text"), F.col("block_height"), F.col("median_height"))
    return out.select(*PAGE, "block_id", F.round(score, 4).alias("score"))


# -- clustering ------------------------------------------------------------------------------

@query("source_metadata_blocks", f"""WITH {SHEET_SQL}, n AS (SELECT *, {q.normalize('text')} AS norm FROM sheet WHERE label <> 'image'),
k AS (SELECT *, {q.metadata_kind('norm')} AS metadata_kind FROM n) SELECT doc_id, page_no, block_id, metadata_kind FROM k WHERE metadata_kind IS NOT NULL""")
def q_source_metadata_blocks(spark, sf_dir):
    return cl.source_metadata_blocks(sheet_blocks(spark, sf_dir)).select(*PAGE, "block_id", "metadata_kind")


TEXTISH_SQL = f"""{SHEET_SQL}, n AS (SELECT *, {q.normalize('text')} AS norm FROM sheet WHERE label IN ('title', 'text', 'caption')),
textish AS (SELECT * FROM n WHERE {q.metadata_kind('norm')} IS NULL AND {q.strip('text')} <> '' AND NOT {q.is_credit('norm')}
  AND NOT (length({q.strip('text')}) <= 2 AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]')))"""


@query("text_blocks", f"WITH {TEXTISH_SQL} SELECT doc_id, page_no, block_id FROM textish")
def q_text_blocks(spark, sf_dir):
    return cl.text_blocks(sheet_blocks(spark, sf_dir)).select(*PAGE, "block_id")


@query("usable_images", f"WITH {SHEET_SQL} SELECT doc_id, page_no, block_id FROM sheet WHERE label = 'image' AND (x1 - x0) * (y1 - y0) >= {W} * {H} * 0.002")
def q_usable_images(spark, sf_dir):
    return cl.usable_images(sheet_blocks(spark, sf_dir)).select(*PAGE, "block_id")


@query("assign_columns", f"""WITH {TEXTISH_SQL}, seeds AS (SELECT * FROM (SELECT *, bool_or(label <> 'title') OVER (PARTITION BY doc_id, page_no) AS mixed FROM textish) WHERE label <> 'title' OR NOT mixed)
SELECT doc_id, page_no, block_id, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY col) - 1 AS column_index FROM seeds""")
def q_assign_columns(spark, sf_dir):
    return cl.assign_columns(cl.text_blocks(sheet_blocks(spark, sf_dir))).select(*PAGE, "block_id", "column_index")


@query("place_titles", f"""WITH {TEXTISH_SQL}, r AS (SELECT *, max(CASE WHEN label <> 'title' THEN col END) OVER (PARTITION BY doc_id, page_no) AS text_col,
    max(col) OVER (PARTITION BY doc_id, page_no) AS any_col FROM textish), whole AS (SELECT * FROM r WHERE text_col = any_col),
c AS (SELECT DISTINCT doc_id, page_no, col, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY col) - 1 AS column_index FROM whole WHERE label <> 'title'),
t AS (SELECT * FROM whole WHERE label = 'title')
SELECT t.doc_id, t.page_no, t.block_id, c.column_index FROM t JOIN c USING (doc_id, page_no)
QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.page_no, t.block_id ORDER BY abs(t.col - c.col), c.col) = 1""")
def q_place_titles(spark, sf_dir):
    """Titles of pages whose last column holds text; a title beyond it widens the last column."""
    pages = cl.page_rows(sheet_blocks(spark, sf_dir))
    textish = F.filter("blocks", lambda b: b["textish"])
    text_x = F.array_max(F.transform(F.filter(textish, lambda b: b["label"] != "title"), lambda b: b["x0"]))
    whole = pages.where(text_x + 100 > F.array_max(F.transform(textish, lambda b: b["x0"])))
    # By place, not zipped: a filter that the explode brings would be pushed down as a copy of the columns' computation.
    rows = whole.select(*PAGE, "columns", F.posexplode("blocks").alias("i", "b")).where(F.col("b.textish") & (F.col("b.label") == "title"))
    return rows.select(*PAGE, "b.block_id", F.get("columns", "i").alias("column_index"))


# Sheets whose articles are certain: every title stands clear of the text above it.
CLEAR_SQL = f"""{LINES_SQL},
placed AS (SELECT doc_id, line, line_no, CAST(line_no // 48 + 1 AS INT) AS page_no, CAST((line_no % 48) // 12 AS INT) AS col, CAST(line_no % 12 AS INT) AS row FROM lines),
clear AS (SELECT doc_id, page_no, line_no, col, row, row // 4 AS part, 'Headline ' || line_no AS heading, 'word ' || left({q.sub('line', '[^A-Za-z ]', '')}, 60) || ' end' AS words FROM placed)"""


def clear_sheets(spark, sf_dir) -> DataFrame:
    n = F.col("line_no")
    src = inputs.lines(spark, sf_dir).select(
        "doc_id", "line_no", (F.floor(n / 48) + 1).cast("int").alias("page_no"), F.floor((n % 48) / 12).cast("int").alias("col"), (n % 12).alias("row"), "line")
    row, top = F.col("row"), F.col("row") % 4 == 0
    y0 = (420 + F.floor(row / 4) * 1000 + (row % 4) * 150).cast("int")
    words = F.concat(F.lit("word "), F.substring(F.regexp_replace("line", "[^A-Za-z ]", ""), 1, 60), F.lit(" end"))
    x0 = (120 + F.col("col") * 570).cast("int")

    def block(kind: str, seq: Column, start: Column, end: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("label"), seq.cast("int").alias("seq"), start.alias("y0"), end.alias("y1"), text.alias("text"))

    head = block("title", n * 2, y0, y0 + 40, F.concat(F.lit("Headline "), n))
    body = block("text", n * 2 + 1, F.when(top, y0 + 50).otherwise(y0), y0 + 100, words)
    rows = src.select(*PAGE, x0.alias("x0"), F.explode(F.when(top, F.array(head, body)).otherwise(F.array(body))).alias("b"))
    return rows.select(*PAGE, F.lit(W).alias("width"), F.lit(H).alias("height"), "x0", (F.col("x0") + 500).alias("x1"), "b.*",
                       F.concat(F.lit("b-"), "b.seq").alias("block_id"), F.lit(0.9).alias("confidence"))


@query("cluster_clear_sheets", f"""WITH {CLEAR_SQL},
a AS (SELECT doc_id, page_no, col, part, max(CASE WHEN row % 4 = 0 THEN heading END) AS title,
  string_agg({q.squeeze('words')}, chr(10) ORDER BY row) AS body_text,
  120 + 570 * col AS x0, 420 + 1000 * part AS y0 FROM clear GROUP BY doc_id, page_no, col, part),
k AS (SELECT * FROM a WHERE body_text <> '')
SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0) AS article_order, title, body_text, x0, y0 FROM k""")
def q_cluster_clear_sheets(spark, sf_dir):
    out = cl.articles(cl.cluster_pages(clear_sheets(spark, sf_dir)))
    return out.select(*PAGE, "article_order", "title", "body_text", "x0", "y0")


@query("column_segments", f"""WITH {SHEET_SQL}, body AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY col) - 1 AS column_index FROM sheet WHERE label NOT IN ('header', 'title')),
h AS (SELECT doc_id, page_no, column_index, greatest(floor(list_sort(list(y1 - y0))[CAST(floor(count(*) / 2) AS INT) + 1] * 1.0 * 2.8), 70) AS lim FROM body GROUP BY 1, 2, 3),
g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page_no, column_index ORDER BY y0, x0, seq) AS gap FROM body)
SELECT doc_id, page_no, block_id, CAST(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, column_index ORDER BY y0, x0, seq) AS BIGINT) AS segment
FROM g JOIN h USING (doc_id, page_no, column_index)""")
def q_column_segments(spark, sf_dir):
    src = sheet_blocks(spark, sf_dir).where(~F.col("label").isin("header", "title"))
    return cl.column_segments(cl.assign_columns(src)).select(*PAGE, "block_id", "segment")


PAIR_SQL = f"""{SHEET_SQL}, titles AS (SELECT * FROM sheet WHERE label = 'title'),
pic AS (SELECT doc_id, page_no, col, row, block_id, x0 AS ix0, y0 AS iy0, x1 AS ix1, y1 AS iy1 FROM sheet WHERE label = 'image')"""


@query("score_caption_image", f"""WITH {PAIR_SQL}, c AS (SELECT *, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1 FROM sheet WHERE label <> 'header' AND label <> 'image'),
j AS (SELECT c.doc_id, c.page_no, c.block_id, ix0, iy0, ix1, iy1, cx0, cy0, cx1, cy1, CASE WHEN cy0 >= iy1 THEN cy0 - iy1 WHEN cy1 <= iy0 THEN iy0 - cy1 ELSE 0 END AS gap,
  greatest(160, floor((iy1 - iy0) * 0.45)) AS lim, greatest(24, floor((ix1 - ix0) * 0.18)) AS pad FROM c JOIN pic ON pic.doc_id = c.doc_id AND pic.page_no = c.page_no AND pic.row = c.row - 1 AND pic.col <= c.col)
SELECT doc_id, page_no, block_id, ix0 AS image_x0, CASE WHEN cx1 >= ix0 - pad AND cx0 <= ix1 + pad AND gap <= lim THEN round({q.overlap('c', 'i')} * 3
  + CASE WHEN cy0 >= iy1 THEN 0.45 WHEN cy1 <= iy0 THEN -0.2 ELSE 0.2 END + greatest(1 - abs((cx0 + cx1) / 2 - (ix0 + ix1) / 2) / greatest(ix1 - ix0, 1), -1) - gap / lim, 6) END AS score FROM j""")
def q_score_caption_image(spark, sf_dir):
    b = sheet_blocks(spark, sf_dir)
    slot = (F.col("seq") - 2) % 48
    b = b.withColumns({"col": F.floor(slot / 12), "row": slot % 12})
    pics = b.where(F.col("label") == "image").select(*PAGE, F.col("col").alias("i_col"), (F.col("row") + 1).alias("row"), *Box.named().columns("i"))
    text = b.where(~F.col("label").isin("header", "image"))
    pairs = text.join(pics, [*PAGE, "row"]).where(F.col("i_col") <= F.col("col"))
    return pairs.select(*PAGE, "block_id", F.col("ix0").alias("image_x0"), F.round(page_articles.score_caption_image(Box.named(), Box.named("i")), 6).alias("score"))


@query("score_image_article", f"""WITH {PAIR_SQL}, a AS (SELECT doc_id, page_no, col, row // 6 AS part, min(x0) AS ax0, min(y0) AS ay0, max(x1) AS ax1, max(y1) AS ay1, count(*) > 1 AS has_body
    FROM sheet WHERE label IN ('title', 'text') GROUP BY 1, 2, 3, 4),
t AS (SELECT doc_id, page_no, col, row // 6 AS part, x0 AS tx0, y0 AS ty0, x1 AS tx1, y1 AS ty1 FROM titles),
j AS (SELECT p.block_id, p.ix0, p.iy0, p.ix1, p.iy1, a.*, tx0, ty0, tx1, ty1, CASE WHEN iy1 <= ay0 THEN ay0 - iy1 WHEN iy0 >= ay1 THEN iy0 - ay1 ELSE 0 END AS gap,
    greatest(220, floor(greatest(iy1 - iy0, ay1 - ay0, 1) * 0.75)) AS lim
  FROM pic p JOIN a ON a.doc_id = p.doc_id AND a.page_no = p.page_no AND a.part = p.row // 6 JOIN t ON t.doc_id = a.doc_id AND t.page_no = a.page_no AND t.col = a.col AND t.part = a.part)
SELECT doc_id, page_no, block_id, col, part, CASE WHEN NOT (gap > lim AND {q.overlap('a', 'i')} < 0.2) THEN round({q.overlap('a', 'i')} * 4.5
  + CASE WHEN iy1 <= ay0 THEN 0.9 WHEN iy0 >= ay1 THEN -0.6 ELSE 0.35 END
  + CASE WHEN {q.overlap('t', 'i')} >= 0.35 AND iy0 - ty1 BETWEEN -40 AND greatest(260, floor((iy1 - iy0) * 0.45)) THEN 1.15 ELSE 0 END
  + greatest(1 - abs((ax0 + ax1) / 2 - (ix0 + ix1) / 2) / greatest(ax1 - ax0, ix1 - ix0, 1), -1) + CASE WHEN has_body THEN 0.5 ELSE 0 END - gap / lim, 6) END AS score FROM j""")
def q_score_image_article(spark, sf_dir):
    slot = (F.col("seq") - 2) % 48
    b = sheet_blocks(spark, sf_dir).withColumns({"col": F.floor(slot / 12).cast("int"), "part": F.floor(slot % 12 / 6).cast("int")})
    pics = b.where(F.col("label") == "image").select(*PAGE, "part", "block_id", *Box.named().columns("i"))
    parts = b.where(F.col("label").isin("title", "text")).groupBy(*PAGE, "col", "part").agg(
        *[f(F.col(s)).alias("a" + s) for f, s in zip((F.min, F.min, F.max, F.max), Box._fields)], (F.count(F.lit(1)) > 1).alias("has_body"),
        *[F.max(F.when(F.col("label") == "title", F.col(s))).alias("t" + s) for s in Box._fields])
    pairs = pics.join(parts.where(F.col("tx0").isNotNull()), [*PAGE, "part"])
    score = page_articles.score_image_article(Box.named("i"), Box.named("a"), Box.named("t"), F.col("has_body"))
    return pairs.select(*PAGE, "block_id", "col", "part", F.round(score, 6).alias("score"))


@query("title_spans", f"""WITH {COLS_SQL}, hulls AS (SELECT doc_id, page_no, column_index, min(x0) AS hx0, max(x1) AS hx1 FROM body WHERE label <> 'title' GROUP BY 1, 2, 3),
t AS (SELECT doc_id, page_no, block_id, x0 AS tx0, x1 + 500 AS tx1, y0 FROM body WHERE label = 'title' AND (doc_id, page_no, column_index) IN (SELECT (doc_id, page_no, column_index) FROM hulls)),
m AS (SELECT t.doc_id, t.page_no, t.block_id, y0, tx0, tx1, list_sort(list(column_index)) AS span FROM t JOIN hulls USING (doc_id, page_no)
  WHERE {q.overlap('t', 'h')} >= 0.18 OR (tx0 + tx1) / 2 BETWEEN hx0 AND hx1 GROUP BY ALL)
SELECT a.doc_id, a.page_no, a.block_id, array_to_string(a.span, ',') AS span,
  (SELECT min(b.y0) FROM m b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND (b.y0 > a.y0 OR (b.y0 = a.y0 AND b.tx0 > a.tx0))
    AND (list_has_any(b.span, a.span) OR greatest(0, least(a.tx1, b.tx1) - greatest(a.tx0, b.tx0)) / least(a.tx1 - a.tx0, b.tx1 - b.tx0) >= 0.18)) AS next_top FROM m a""")
def q_title_spans(spark, sf_dir):
    """Titles made one column wider: the columns they span and the next rival below."""
    b = sheet_blocks(spark, sf_dir).where(F.col("label") != "header")
    columned = segment.build_columns(column_blocks(spark, sf_dir)).select(*PAGE, "block_id", "column_index")
    b = b.join(columned, [*PAGE, "block_id"])
    hulls = b.where(F.col("label") != "title").groupBy(*PAGE, "column_index").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    pages = hulls.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("column_index", "x0", "x1"))).alias("h"))
    own = hulls.select(*PAGE, "column_index")
    titles = b.where(F.col("label") == "title").join(own, [*PAGE, "column_index"], "left_semi").withColumn("x1", F.col("x1") + 500).join(pages, PAGE)
    wide = F.transform("h", lambda h: F.struct(h["x0"].alias("x0"), F.lit(0).alias("y0"), h["x1"].alias("x1"), F.lit(1).alias("y1"), h["column_index"].alias("c")))
    at = page_articles.title_span(Box.named(), F.lit(-1), wide)
    titles = titles.withColumn("span", F.transform(at, lambda i: F.get("h", i)["column_index"]))
    listed = titles.groupBy(*PAGE).agg(F.collect_list(F.struct(*Box._fields, "span", "block_id")).alias("ts"))
    rows = listed.select(*PAGE, "ts", F.explode("ts").alias("t"))
    later = F.filter("ts", lambda t: (t["y0"] > F.col("t.y0")) | ((t["y0"] == F.col("t.y0")) & (t["x0"] > F.col("t.x0"))))
    return rows.select(*PAGE, "t.block_id", F.array_join("t.span", ",").alias("span"),
                       page_articles.next_title_top(Box.of(F.col("t")), F.col("t.span"), later).alias("next_top"))


@query("attach_source_metadata", f"""WITH {SHEET_SQL}, t AS (SELECT doc_id, page_no, block_id, x0 AS tx0, y0 AS ty0, x1 AS tx1, y1 AS ty1 FROM sheet WHERE label = 'title'),
hd AS (SELECT doc_id, page_no, block_id AS hid, x0 AS hx0, y0 AS hy0, x1 AS hx1, y1 AS hy1, {q.normalize('text')} AS norm FROM sheet WHERE label = 'header'),
k AS (SELECT *, {q.metadata_kind('norm')} AS kind FROM hd),
ok AS (SELECT t.doc_id, t.page_no, t.block_id, norm, kind FROM t JOIN k USING (doc_id, page_no) WHERE kind IS NOT NULL AND hy0 <= ty0 + greatest(60, floor({H} * 0.02))
  AND NOT (greatest(ty0 - hy1, 0) > greatest(260, floor({H} * 0.16)) AND {q.overlap('h', 't')} < 0.18))
SELECT t.doc_id, t.page_no, t.block_id, p.norm AS publication, CASE WHEN regexp_matches(i.norm, '년') THEN i.norm END AS raw_issue_text
FROM t LEFT JOIN ok p ON p.doc_id = t.doc_id AND p.page_no = t.page_no AND p.block_id = t.block_id AND p.kind = 'publication'
  LEFT JOIN ok i ON i.doc_id = t.doc_id AND i.page_no = t.page_no AND i.block_id = t.block_id AND i.kind = 'issue'""")
def q_attach_source_metadata(spark, sf_dir):
    b = sheet_blocks(spark, sf_dir)
    heads = cl.source_metadata_blocks(b.where(F.col("label") == "header"))
    per_page = heads.groupBy(*PAGE).agg(F.collect_list(F.struct(*Box._fields, "block_id", "metadata_kind", "norm")).alias("headers"))
    titles = b.where(F.col("label") == "title").join(per_page, PAGE, "left")
    anchor = Box.named()
    empty = F.coalesce("headers", F.filter("headers", lambda h: F.lit(False)))
    return titles.select(*PAGE, "block_id", cl.attach_publication(empty, anchor, F.lit(H)).alias("publication"),
                         cl.attach_issue(empty, anchor, F.lit(H))["raw_issue_text"].alias("raw_issue_text"))


# -- quality ---------------------------------------------------------------------------------

@query("layout_text", f"""WITH {SHEET_SQL} SELECT doc_id, page_no, coalesce(string_agg(CASE WHEN label IN {TEXTUAL} AND text <> '' THEN text END, chr(10) ORDER BY seq), '') AS layout_text
FROM sheet GROUP BY doc_id, page_no""")
def q_layout_text(spark, sf_dir):
    return quality.layout_text(sheet_blocks(spark, sf_dir))


DUP_SQL = f"""{LINES_SQL}, c AS (SELECT doc_id, {q.compact('line')} AS line, count(*) AS n FROM lines GROUP BY 1, 2),
d AS (SELECT doc_id, sum(n) AS total, sum(n - 1) AS rep, count(*) FILTER (WHERE n >= 3 AND length(line) <= 40) AS hits FROM c GROUP BY doc_id),
dup AS (SELECT doc_id, CASE WHEN total < 3 THEN 0 ELSE least(0.35, rep / total * 0.45 + hits * 0.05) END AS penalty FROM d)"""


@query("duplicate_line_penalty", f"WITH {DUP_SQL} SELECT doc_id, 1 AS page_no, round(penalty, 6) AS duplicate_penalty FROM dup")
def q_duplicate_line_penalty(spark, sf_dir):
    out = quality.duplicate_line_penalty(document_pages(spark, sf_dir))
    return out.select(*PAGE, F.round("duplicate_penalty", 6).alias("duplicate_penalty"))


@query("structure_penalty", f"""WITH {SHEET_SQL}, s AS (SELECT doc_id, page_no, count(*) FILTER (WHERE label IN {TEXTUAL}) AS n, count(*) FILTER (WHERE label = 'title') AS t,
  count(*) FILTER (WHERE label = 'title' AND length({q.compact('text')}) >= 60) AS lt, count(*) FILTER (WHERE label = 'caption') AS c FROM sheet GROUP BY 1, 2)
SELECT doc_id, page_no, round(CASE WHEN n < 3 THEN 0 ELSE least(0.22, CASE WHEN t >= 2 AND t / n > 0.35 THEN least(0.14, (t / n - 0.35) * 0.45) ELSE 0 END
  + CASE WHEN t >= 2 THEN least(0.12, lt * 0.04) ELSE 0 END + CASE WHEN c >= 3 AND t = 0 THEN 0.06 ELSE 0 END) END, 6) AS structure_penalty FROM s""")
def q_structure_penalty(spark, sf_dir):
    return quality.structure_penalty(sheet_blocks(spark, sf_dir)).select(*PAGE, F.round("structure_penalty", 6).alias("structure_penalty"))


QUALITY_SQL = f"""{DUP_SQL}, s AS (SELECT doc_id, sum(length({q.compact('line')})) AS chars, count(*) AS n FROM lines GROUP BY doc_id)"""


@query("layout_quality", f"""WITH {QUALITY_SQL}
SELECT doc_id, 1 AS page_no, round(round(greatest(0, least(chars / 80, 2) / 2 * 0.55 - penalty), 4), 3) AS score, false AS acceptable FROM s JOIN dup USING (doc_id)""")
def q_layout_quality(spark, sf_dir):
    return quality.layout_quality(document_pages(spark, sf_dir)).select(*PAGE, F.round("score", 3).alias("score"), "acceptable")


GRADE_SQL = f"""{LINES_SQL}, mixed AS (SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN repeat('한글 ', 30) || line ELSE line END AS text FROM lines),
s AS (SELECT doc_id, sum(length({q.compact('text')})) AS c, sum(length(text) - length(regexp_replace(text, '[가-힣]', '', 'g'))) AS h, count(*) AS b FROM mixed GROUP BY doc_id),
r AS (SELECT doc_id, c AS char_count, round(h / c, 4) AS korean_ratio, round(0.3 + doc_id % 7 * 0.1, 4) AS average_confidence, b AS block_count, doc_id % 4 AS article_count FROM s),
g AS (SELECT *, round(least(1, least(char_count / 80, 2) / 2 * 0.45 + korean_ratio * 0.3 + average_confidence * 0.25), 4) AS score4, round(score4, 3) AS score,
  list_filter([CASE WHEN char_count < 80 THEN 'low_text' END, CASE WHEN korean_ratio < 0.35 THEN 'low_korean_ratio' END, CASE WHEN average_confidence < 0.75 THEN 'low_confidence' END,
    CASE WHEN article_count = 0 THEN 'no_articles' END], lambda x: x IS NOT NULL) AS reasons FROM r),
grades AS (SELECT *, CASE WHEN score4 < 0.45 OR article_count = 0 THEN 'blocked' WHEN score4 < 0.7 OR len(reasons) > 0 THEN 'warning' ELSE 'ready' END AS status FROM g)"""


def graded_pages(spark, sf_dir) -> DataFrame:
    """Documents as pages, a third of them partly Korean, with set confidences and article counts."""
    d = F.col("doc_id")
    b = document_pages(spark, sf_dir)
    text = F.when(d % 3 == 0, F.concat(F.repeat(F.lit("한글 "), F.lit(30)), F.col("text"))).otherwise(F.col("text"))
    b = b.withColumns({"text": text, "confidence": 0.3 + d % 7 * 0.1})
    counts = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), (d % 4).alias("article_count"))
    return quality.page_quality(b, counts)


@query("page_quality", f"""WITH {GRADE_SQL} SELECT doc_id, 1 AS page_no, status, score, char_count, korean_ratio, average_confidence, block_count, article_count,
  array_to_string(reasons, ',') AS reasons FROM grades""")
def q_page_quality(spark, sf_dir):
    return graded_pages(spark, sf_dir).select(
        *PAGE, "status", F.round("score", 3).alias("score"), "char_count", "korean_ratio", "average_confidence", "block_count", "article_count", F.array_join("reasons", ",").alias("reasons"))


_ROLLUP = """SELECT {key}, CASE WHEN b > 0 THEN 'blocked' WHEN w > 0 THEN 'warning' ELSE 'ready' END AS status, average_score, r AS ready_pages, w AS warning_pages,
  b AS blocked_pages, n AS measured_pages, coalesce(top_reasons, '') AS top_reasons FROM (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE status = 'ready') AS r,
  count(*) FILTER (WHERE status = 'warning') AS w, count(*) FILTER (WHERE status = 'blocked') AS b, round(round(avg(score4), 4), 2) AS average_score FROM grades_k GROUP BY {key}) s
LEFT JOIN (SELECT {key}, string_agg(reason, ',' ORDER BY n DESC, reason) AS top_reasons FROM (SELECT {key}, reason, count(*) AS n FROM (SELECT {key}, unnest(reasons) AS reason FROM grades_k)
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, reason) <= 5) GROUP BY {key}) t USING ({key})"""


def _rolled(df: DataFrame, key: str) -> DataFrame:
    return quality.job_quality(df, key).select(
        key, "status", F.round("average_score", 2).alias("average_score"), "ready_pages", "warning_pages", "blocked_pages", "measured_pages",
        F.array_join("top_reasons", ",").alias("top_reasons"))


@query("job_quality", f"WITH {GRADE_SQL}, grades_k AS (SELECT *, doc_id % 50 AS job_id FROM grades) " + _ROLLUP.format(key="job_id"))
def q_job_quality(spark, sf_dir):
    return _rolled(graded_pages(spark, sf_dir).withColumn("job_id", F.col("doc_id") % 50), "job_id")


@query("quality_by_language", f"WITH {GRADE_SQL}, grades_k AS (SELECT g.*, lang FROM grades g JOIN documents USING (doc_id)) " + _ROLLUP.format(key="lang"))
def q_quality_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return _rolled(graded_pages(spark, sf_dir).join(docs, "doc_id"), "lang")


@query("parse_quality_score", f"WITH {SHEET_SQL} SELECT doc_id, round(round(avg(confidence), 4), 3) AS parse_quality_score FROM sheet GROUP BY doc_id")
def q_parse_quality_score(spark, sf_dir):
    return quality.parse_quality_score(sheet_blocks(spark, sf_dir)).select("doc_id", F.round("parse_quality_score", 3).alias("parse_quality_score"))


# -- relevance -------------------------------------------------------------------------------

WORDS = ("국회 국방위원회에서 보고", "처리 경과 결과", "사고로 부상", "군 훈련 소식", "예산 통계와 질의 답변", "일반 소식")


def scored_articles(spark, sf_dir) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat_ws("\n", F.concat(inputs._pick(WORDS, o), F.lit("  "), c.cast("string")), F.concat(F.lit("  "), inputs._pick(WORDS, c)), F.lit(""))
    return table(spark, sf_dir, "orders").select(
        (F.floor(o / 3)).alias("doc_id"), F.lit(1).alias("page_no"), (o % 3 + 1).cast("int").alias("article_order"),
        F.concat(F.lit("기사 &amp; "), o.cast("string")).alias("title"), F.when(o % 8 == 0, "").otherwise(body).alias("body_text"))


_RAW_BODY = f"{inputs._sql_pick(WORDS, 'o_orderkey')} || ' ' || o_custkey || chr(10) || {inputs._sql_pick(WORDS, 'o_custkey')}"


def _hits(words) -> str:
    return "list_filter([" + ", ".join(q.lit(w) for w in words) + "], lambda w: contains(t, replace(w, ' ', '')))"


def _sentence(key: str, words: str) -> str:
    before, after = relevance.REASONS[key]
    return f"{q.lit(before)} || array_to_string({words}[1:4], ', ') || {q.lit(after)}"


REL_SQL = f"""a AS (SELECT o_orderkey // 3 AS doc_id, CAST(o_orderkey % 3 + 1 AS INT) AS article_order, '기사 & ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 8 = 0 THEN '기사 & ' || o_orderkey ELSE {_RAW_BODY} END AS body, o_orderkey FROM orders),
n AS (SELECT *, {q.compact('title || body')} AS t FROM a), h AS (SELECT *, {_hits(relevance.DIRECT)} AS d, {_hits(relevance.ADMIN)} AS ad, {_hits(relevance.INCIDENT)} AS i FROM n),
sc AS (SELECT *, least(0.98, 0.05 + least(0.24, 0.18 * len(d)) + least(0.20, 0.10 * len(ad)) + least(0.18, 0.09 * len(i)) + CASE WHEN contains(t, '군') THEN 0.04 ELSE 0 END
  + CASE WHEN list_has_any(d, ['국회', '국방위', '국방위원회', '국정감사']) THEN 0.12 ELSE 0 END) AS score FROM h),
heur AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS label,
  CASE WHEN len(d) > 0 AND (len(ad) > 0 OR len(i) > 0) THEN {_sentence('direct_context', 'd')} WHEN len(d) > 0 THEN {_sentence('direct', 'd')}
    WHEN len(i) > 0 THEN {_sentence('incident', 'i')} WHEN len(ad) > 0 AND score >= 0.4 THEN {_sentence('admin_high', 'ad')} WHEN len(ad) > 0 THEN {_sentence('admin_low', 'ad')}
    ELSE {q.lit(relevance.REASONS['none'])} END AS reason FROM sc)"""


@query("heuristic_relevance", f"WITH {REL_SQL} SELECT doc_id, article_order, round(score, 6) AS score, label, reason FROM heur")
def q_heuristic_relevance(spark, sf_dir):
    out = relevance.heuristic_relevance(relevance.prepare(scored_articles(spark, sf_dir)))
    return out.select("doc_id", "article_order", F.round("heuristic_score", 6).alias("score"), F.col("heuristic_label").alias("label"),
                      F.col("heuristic_reason").alias("reason"))


def model_replies(spark, sf_dir) -> DataFrame:
    """Replies for two pages in three: fenced lists with a percent score and a bad one, or single objects."""
    d = F.floor(F.col("o_orderkey") / 3)
    pages = table(spark, sf_dir, "orders").select(d.alias("doc_id"), F.lit(1).alias("page_no")).distinct()
    listed = F.concat(F.lit('```json\n{"articles":[{"article_order":1,"score":80,"label":"HIGH","reason":" r  '), F.col("doc_id"),
                      F.lit('","corrected_title":"새 제목"},{"index":"2","score":"n/a"}]}\n```'))
    single = F.lit('so: {"relevance_score":0.5,"decision":"odd"} ok')
    reply = F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, single)
    return pages.withColumn("reply", reply)


@query("apply_model_replies", f"""WITH {REL_SQL}, m AS (SELECT *, CASE WHEN article_order = 1 AND doc_id % 3 < 2 THEN 1 ELSE 0 END AS hit FROM heur)
SELECT doc_id, article_order, CASE WHEN hit = 1 AND doc_id % 3 = 0 THEN 0.8 WHEN hit = 1 THEN 0.5 ELSE round(score, 6) END AS score,
  CASE WHEN hit = 1 AND doc_id % 3 = 0 THEN 'high' WHEN hit = 1 THEN 'medium' ELSE label END AS label,
  CASE WHEN hit = 1 AND doc_id % 3 = 0 THEN 'r ' || doc_id WHEN hit = 1 THEN {q.lit(relevance.REASONS['model'])} ELSE reason END AS reason,
  CASE hit WHEN 1 THEN 'llm' ELSE 'heuristic' END AS source, CASE WHEN hit = 1 AND doc_id % 3 = 0 THEN '새 제목' WHEN hit = 1 THEN title END AS corrected_title,
  CASE WHEN hit = 1 THEN body END AS corrected_body_text FROM m""")
def q_apply_model_replies(spark, sf_dir):
    out = relevance.apply_model_replies(scored_articles(spark, sf_dir), model_replies(spark, sf_dir), PAGE)
    return out.select("doc_id", "article_order", F.round("score", 6).alias("score"), "label", "reason", "source", "corrected_title", "corrected_body_text")


@query("relevance_page_source", f"""WITH {REL_SQL}, p AS (SELECT doc_id, count(*) AS n FROM heur GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND n > 1 THEN 'mixed' WHEN doc_id % 3 < 2 THEN 'llm' ELSE 'heuristic' END AS source FROM p""")
def q_relevance_page_source(spark, sf_dir):
    out = relevance.apply_model_replies(scored_articles(spark, sf_dir), model_replies(spark, sf_dir), PAGE)
    return relevance.page_source(out, PAGE).select("doc_id", "source")


# -- models ----------------------------------------------------------------------------------

@query("run_page_model", f"WITH {SHEET_SQL}, {PAGE_LIST} SELECT doc_id, page_no, 'page ' || doc_id || '/' || page_no AS output FROM p WHERE doc_id % 5 < 4")
def q_run_page_model(spark, sf_dir):
    def runner(pages: list[dict]) -> list[str]:
        return [f"page {p['doc_id']}/{p['page_no']}" for p in pages]

    return models.run_page_model(page_list(spark, sf_dir), runner, 4, stored_outputs(spark, sf_dir))


@query("score_with_model", f"WITH {SHEET_SQL}, {PAGE_LIST} SELECT doc_id, page_no, CASE WHEN doc_id % 4 > 0 THEN '{{\"score\": ' || doc_id % 4 || '}}' END AS reply FROM p")
def q_score_with_model(spark, sf_dir):
    def scorer(page: dict) -> str:
        if page["doc_id"] % 4 == 0:
            raise ValueError("no answer")
        return f'{{"score": {page["doc_id"] % 4}}}'

    return models.score_with_model(page_list(spark, sf_dir), scorer)


