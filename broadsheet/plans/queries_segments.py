"""Column-wise segmentation over sheets and over rough pages, with recursive SQL for its folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.geometry import Box
from broadsheet.functions.text import SPACE
from broadsheet.operators import segment
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import PAGE_HEIGHT as H, PAGE_WIDTH as W, SHEET_SQL, sheet_blocks
from broadsheet.plans.queries_articles import PAGE, ROUGH_SQL, rough_blocks

READ = "y0, x0, block_id"
WORDS = f"list_filter(regexp_split_to_array({q.strip('text')}, '{SPACE}+'), lambda w: w <> '')"


def shared_sql(a: str, b: str) -> str:
    narrow = f"least(greatest(0, {a}x1 - {a}x0), greatest(0, {b}x1 - {b}x0))"
    return f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) / CASE WHEN {narrow} = 0 THEN 1 ELSE {narrow} END)"


def score_sql(median: str) -> str:
    return f"""CASE WHEN kind = 'title' THEN 2.0 WHEN len(words) = 0 OR regexp_matches({q.strip('text')}, '[.!?;]$') OR len(words) > 10 THEN 0.0
  ELSE 0.6 + CASE WHEN bh >= {median} * 1.35 THEN 0.8 ELSE 0 END
    + CASE WHEN (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g'))) / greatest(length({q.strip('text')}), 1) >= 0.4 THEN 0.4 ELSE 0 END
    + CASE WHEN len(list_filter(words, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / greatest(len(words), 1) >= 0.5 THEN 0.3 ELSE 0 END END"""


def segments_sql(cte: str, source: str) -> str:
    return f"""WITH RECURSIVE {cte},
sb AS MATERIALIZED (SELECT doc_id, page_no, doc_id * 1000000 + page_no AS p, block_id, label AS kind, {', '.join(f'{s}::DOUBLE AS {s}' for s in Box._fields)}, text
  FROM {source} WHERE label <> 'header'),
narrowed AS (SELECT *, greatest(0, x1 - x0) <= {W} * 0.78 AS narrow, bool_or(greatest(0, x1 - x0) <= {W} * 0.78) OVER (PARTITION BY p) AS any_narrow FROM sb),
seeds AS MATERIALIZED (SELECT p, x0, x1, row_number() OVER (PARTITION BY p ORDER BY x0, y0, block_id, x1) AS n FROM narrowed WHERE narrow OR NOT any_narrow),
seeding(p, n, cols) AS (SELECT p, 1::BIGINT, [{{'x0': x0, 'x1': x1}}] FROM seeds WHERE n = 1 UNION ALL
  SELECT p, n, CASE WHEN near IS NULL THEN list_append(cols, {{'x0': x0, 'x1': x1}})
    ELSE list_transform(cols, lambda c, k: CASE WHEN k = near THEN {{'x0': least(c.x0, x0), 'x1': greatest(c.x1, x1)}} ELSE c END) END
  FROM (SELECT b.*, s.cols, list_min(list_transform(s.cols, lambda c, k: CASE WHEN abs(b.x0 - c.x0) <= greatest(24, {W} * 0.06) OR {shared_sql('b.', 'c.')} >= 0.35 THEN k END)) AS near
        FROM seeding s JOIN seeds b ON b.p = s.p AND b.n = s.n + 1)),
hulls AS MATERIALIZED (SELECT p, arg_max(cols, n) AS cols FROM seeding GROUP BY p),
fitted AS (SELECT sb.*, list_max(list_transform(cols, lambda c, k: {{'s': {shared_sql('sb.', 'c.')}
    - abs(sb.x0 + greatest(0, sb.x1 - sb.x0) / 2 - (c.x0 + greatest(0, c.x1 - c.x0) / 2)) / greatest(greatest(0, c.x1 - c.x0), 1), 'k': -k}})) AS best FROM sb JOIN hulls USING (p)),
columned AS MATERIALIZED (SELECT * EXCLUDE (best), CASE WHEN best.s > -1 THEN -best.k - 1 ELSE 0 END AS col, {WORDS} AS words, greatest(0, y1 - y0) AS bh FROM fitted),
gaps AS (SELECT *, min(x0) OVER (PARTITION BY p, col) AS column_x0, row_number() OVER down AS n, greatest(0, y0 - lag(y1) OVER down) AS gap
  FROM columned WINDOW down AS (PARTITION BY p, col ORDER BY {READ})),
stats AS (SELECT *, coalesce(median(CASE WHEN text <> '' THEN bh END) OVER c, 24) AS mh, coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER c, {H} * 0.01) AS mg
  FROM gaps WINDOW c AS (PARTITION BY p, col)),
flagged AS MATERIALIZED (SELECT *, kind <> 'image' AND {score_sql('mh')} >= 1.0 AS headline, text <> '' AS has_text,
    coalesce(gap > greatest(mg * 1.8, {H} * 0.035) AND text <> '' AND kind <> 'caption', false) AS wide FROM stats),
breaking(p, col, n, part, seen) AS (SELECT p, col, n, 0, has_text FROM flagged WHERE n = 1 UNION ALL
  SELECT p, col, n, part + cut::INT, CASE WHEN cut THEN has_text ELSE seen OR has_text END
  FROM (SELECT b.p, b.col, b.n, s.part, s.seen, b.has_text, (b.headline AND s.seen) OR b.wide AS cut
        FROM breaking s JOIN flagged b ON b.p = s.p AND b.col = s.col AND b.n = s.n + 1)),
parts AS (SELECT f.*, part, has_text AND kind <> 'image' AS textual FROM flagged f JOIN breaking USING (p, col, n)),
sized AS (SELECT *, sum(textual::INT) OVER own AS n_textual, sum(CASE WHEN textual THEN len(words) ELSE 0 END) OVER own AS n_words,
    row_number() OVER (PARTITION BY p, col, part ORDER BY {READ}) = 1 AS first FROM parts WINDOW own AS (PARTITION BY p, col, part)),
grouped AS (SELECT *, sum((first AND NOT (n_textual <= 1 AND n_words < 12 AND part > 0))::INT) OVER (PARTITION BY p, col ORDER BY part, {READ}) AS g FROM sized),
found AS (SELECT doc_id, page_no, p, col, g, min(column_x0) AS column_x0, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS block_count,
    count(*) FILTER (WHERE kind <> 'image' AND {score_sql('greatest(bh, 1)')} >= 1.0) AS headline_count,
    {q.strip(f"coalesce(string_agg(text, chr(10) || chr(10) ORDER BY {READ}) FILTER (WHERE has_text), '')")} AS article_text
  FROM grouped GROUP BY doc_id, page_no, p, col, g HAVING count(*) FILTER (WHERE has_text OR kind = 'image') > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY column_x0, col, g) AS article_index FROM found)
SELECT doc_id, page_no, article_index, printf('page-%04d-article-%04d', page_no, article_index) AS article_id, col AS column_index,
  least(greatest(x0 - 12, 0), {W})::DOUBLE AS x0, least(greatest(y0 - 12, 0), {H})::DOUBLE AS y0, least(greatest(x1 + 12, 0), {W})::DOUBLE AS x1,
  least(greatest(y1 + 12, 0), {H})::DOUBLE AS y1, article_text, block_count, headline_count FROM numbered"""


def typed(blocks: DataFrame) -> DataFrame:
    b = blocks.where(F.col("label") != "header")
    return b.select(*PAGE, "width", "height", "block_id", F.col("label").alias("kind"), *[F.col(s).cast("double").alias(s) for s in Box._fields], "text")


@query("segment_pages", segments_sql(SHEET_SQL, "sheet"))
def q_segment_pages(spark, sf_dir):
    blocks = sheet_blocks(spark, sf_dir)
    return segment.segment_pages(typed(blocks), blocks.select(*PAGE).distinct())


@query("segment_pages_rough", segments_sql(ROUGH_SQL, "rough"))
def q_segment_pages_rough(spark, sf_dir):
    return segment.segment_pages(typed(rough_blocks(spark, sf_dir)))
