"""The order-dependent steps of the clustering, over sheets and over rough pages, with recursive SQL beside them.

Sheets have four neat columns, so few titles, pictures or articles compete on them. Rough pages lay the same lines out with wide titles,
stacks, overlaps, gaps and pictures at places drawn from the line's numbers, so that every rule decides something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import newspaper as news
from broadsheet.functions.geometry import Box
from broadsheet.functions.text import SPACE
from broadsheet.operators import cluster as cl
from broadsheet.operators import documents
from broadsheet.plans import inputs
from broadsheet.plans import sqltext as q
from broadsheet.plans.catalog import query
from broadsheet.plans.inputs import LINES_SQL, PAGE_HEIGHT as H, PAGE_WIDTH as W, SHEET_SQL, sheet_blocks

PAGE = ["doc_id", "page_no"]
ROUGH_LINES = 28
ISSUE = news.ISSUE_DATE + rf"(?:\s*({news.WEEKDAY}))?(.*)$"
LABELLED = rf"^({news.PAGE_NUMBER})\s*면(?:\s*(.+))?$"


def rough_blocks(spark, sf_dir) -> DataFrame:
    """28 lines a page in one to four columns, a line's kind, place and size drawn from its number and length."""
    src = inputs.lines(spark, sf_dir)
    d, n = F.col("doc_id"), F.col("line_no")
    page, slot = (F.floor(n / ROUGH_LINES) + 1).cast("int"), (n % ROUGH_LINES).cast("int")
    src = src.select("doc_id", "line", "line_no", page.alias("page_no"), slot.alias("slot"),
                     ((d * 7919 + n * 104729 + F.length("line") * 31) % 9973).cast("int").alias("u"), (1 + (d + page) % 4).cast("int").alias("cols"))
    u, slot = F.col("u"), F.col("slot")
    rows = F.ceil(F.lit(ROUGH_LINES) / F.col("cols")).cast("int")
    src = src.withColumns({"col": F.floor(slot / rows).cast("int"), "row": (slot % rows).cast("int"), "rows": rows})
    kind = u % 12
    label = F.when(kind < 3, "title").when(kind == 3, "image").when(kind == 4, "caption").otherwise("text")
    w = F.floor(F.lit(2280) / F.col("cols")).cast("int")
    x0 = 100 + F.col("col") * w + u % 37 - 18
    step = F.floor(F.lit(3000) / F.col("rows")).cast("int")
    y0 = 300 + F.col("row") * step + F.when(u % 5 == 0, F.floor(step * (u % 7) / 4).cast("int")).otherwise(0)
    wide = F.when((label == "title") & (u % 4 == 1), 1 + u % 3).otherwise(1)
    height = F.when(label == "image", 40 + u % 600).when(label == "text", 20 + u % 260).otherwise(20 + u % 60)
    text = F.when(label == "image", "").when(u % 61 == 0, F.concat(F.lit("article_"), F.col("line"))).otherwise(F.col("line"))
    parts = {"seq": slot, "block_id": F.concat(F.lit("b-"), n), "label": label, "x0": x0, "y0": y0, "x1": F.least(x0 + w * wide - 40, F.lit(W)),
             "y1": F.least(y0 + height, F.lit(H)), "text": text, "confidence": F.round((u % 100) / 100, 2)}
    return src.select("doc_id", "page_no", F.lit(W).alias("width"), F.lit(H).alias("height"), *[
        (v.cast("int") if k in ("seq", *Box._fields) else v).alias(k) for k, v in parts.items()])


ROUGH_SQL = LINES_SQL + f""",
rough_u AS (SELECT doc_id, line, line_no, CAST(line_no // {ROUGH_LINES} + 1 AS INT) AS page_no, CAST(line_no % {ROUGH_LINES} AS INT) AS slot,
  (doc_id * 7919 + line_no * 104729 + length(line) * 31) % 9973 AS u FROM lines),
rough_c AS (SELECT *, 1 + (doc_id + page_no) % 4 AS cols, CAST(ceil({ROUGH_LINES} / cols) AS INT) AS n_rows FROM rough_u),
rough_k AS (SELECT *, slot // n_rows AS col, slot % n_rows AS row, 2280 // cols AS w, 3000 // n_rows AS step,
  CASE WHEN u % 12 < 3 THEN 'title' WHEN u % 12 = 3 THEN 'image' WHEN u % 12 = 4 THEN 'caption' ELSE 'text' END AS label FROM rough_c),
rough_x AS (SELECT *, 100 + col * w + u % 37 - 18 AS x0, 300 + row * step + CASE WHEN u % 5 = 0 THEN CAST(floor(step * (u % 7) / 4) AS INT) ELSE 0 END AS y0 FROM rough_k),
rough AS (SELECT doc_id, page_no, slot AS seq, 'b-' || line_no AS block_id, label, x0, y0,
  least(x0 + w * CASE WHEN label = 'title' AND u % 4 = 1 THEN 1 + u % 3 ELSE 1 END - 40, {W}) AS x1,
  least(y0 + CASE label WHEN 'image' THEN 40 + u % 600 WHEN 'text' THEN 20 + u % 260 ELSE 20 + u % 60 END, {H}) AS y1,
  CASE WHEN label = 'image' THEN '' WHEN u % 61 = 0 THEN 'article_' || line ELSE line END AS text, round((u % 100) / 100, 2) AS confidence FROM rough_x)"""


# -- SQL of the steps --------------------------------------------------------------------------

def facts_sql(source: str) -> str:
    """A block's text facts, from its label and text."""
    return f"""(SELECT *, bare <> '' AS filled, {q.is_aux('norm')} AS aux, {q.is_credit('norm')} AS credit, {q.non_article('norm')} AS non_article,
    norm <> '' AND length(norm) <= 72 AND NOT ends_with(norm, '.') AS short_title, regexp_matches(norm, '^[◆■]') AS bullet,
    starts_with(shown, 'page_') OR starts_with(shown, 'article_') AS placeholder, length(norm) AS norm_len, length(bare) AS text_len,
    {q.strip_credit('norm')} AS body, length(body) AS body_len, length(shown) AS title_len
  FROM (SELECT *, {q.squeeze('plain')} AS norm, {q.strip('text')} AS bare,
      CASE WHEN label = 'caption' AND length(plain) > 80 THEN regexp_replace(left(plain, 77), '{SPACE}+$', '') || '...' ELSE plain END AS shown
    FROM (SELECT *, {q.strip_markup('text')} AS plain FROM {source})))"""


def area_sql(b: str) -> str:
    return f"(greatest(0, {b}x1 - {b}x0) * greatest(0, {b}y1 - {b}y0))"


def box_sql(prefix: str = "") -> str:
    return ", ".join(f"'{side}': {prefix}{side}" for side in Box._fields)


def span_sql(hulls: str) -> str:
    """The columns that the title in scope spans."""
    return f"""list_filter(list_transform({hulls}, lambda h, k: CASE WHEN {q.overlap('', 'h.')} >= 0.18 OR (x0 + x1) / 2 BETWEEN h.x0 AND h.x1
      THEN k - 1 END), lambda c: c IS NOT NULL)"""


def in_span_sql(b: str, t: str, hulls: str) -> str:
    return (f"(list_contains({t}span, {b}col) OR {q.overlap(t, b)} >= 0.22"
            f" OR len(list_filter({t}span, lambda c: {q.overlap(f'{hulls}[c + 1].', b)} >= 0.22)) > 0)")


def hulls_sql(source: str, column: str) -> str:
    return f"""(SELECT p, list({{'x0': x0, 'x1': x1}} ORDER BY c) AS hulls
  FROM (SELECT p, {column} AS c, min(x0) AS x0, max(x1) AS x1 FROM {source} GROUP BY ALL) GROUP BY p)"""


def items_sql(source: str) -> str:
    """``it``: the page's blocks with facts, flags and column."""
    usable = (f"label = 'image' AND {area_sql('')} >= {W * H} * 0.002 AND greatest(x1 - x0, 1) / greatest(y1 - y0, 1) BETWEEN 0.125 AND 8"
              f" AND NOT ((y0 < {H} * 0.04 OR y1 > {H} * 0.96) AND greatest(x1 - x0, 1) > {W} * 0.6 AND greatest(y1 - y0, 1) < {H} * 0.12)")
    return f"""b0 AS (SELECT doc_id, page_no, doc_id * 1000000 + page_no AS p, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) - 1 AS i,
  block_id, label, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1, text, confidence FROM {source}),
b1 AS MATERIALIZED (SELECT *, CASE WHEN label IN ('title', 'text', 'caption', 'header') THEN {q.metadata_kind('norm')} END AS meta FROM {facts_sql('b0')}),
b2 AS MATERIALIZED (SELECT *, {usable} AS usable_image, label IN ('title', 'text', 'caption') AND meta IS NULL AND filled AND NOT credit
  AND NOT (text_len <= 2 AND NOT regexp_matches(norm, '[\\p{{L}}\\p{{N}}]')) AS textish FROM b1),
titles_only AS (SELECT p, bool_and(label = 'title') AS titles_only FROM b2 WHERE textish GROUP BY p),
seeds AS MATERIALIZED (SELECT p, x0, x1, row_number() OVER (PARTITION BY p ORDER BY x0, i) AS n FROM b2 JOIN titles_only USING (p)
  WHERE textish AND (titles_only OR label <> 'title')),
start_steps(p, n, starts, total, held) AS (SELECT p, n, [x0], x0::BIGINT, 1 FROM seeds WHERE n = 1 UNION ALL
  SELECT p, n, CASE WHEN near THEN starts ELSE list_append(starts, x0) END, CASE WHEN near THEN total + x0 ELSE x0 END, CASE WHEN near THEN held + 1 ELSE 1 END
  FROM (SELECT s.p, b.n, starts, total, held, b.x0, b.x0 - total // held <= greatest(floor({W} * 0.05), 40) AS near
        FROM start_steps s JOIN seeds b ON b.p = s.p AND b.n = s.n + 1)),
starts AS MATERIALIZED (SELECT p, arg_max(starts, n) AS starts FROM start_steps GROUP BY p),
first_hulls AS (SELECT p, list({{'x0': x0, 'x1': x1}} ORDER BY x0) AS cols FROM (
  SELECT p, list_max(list_filter(starts, lambda s: s <= x0)) AS x0, max(x1) AS x1 FROM seeds JOIN starts USING (p) GROUP BY ALL) GROUP BY p),
to_place AS MATERIALIZED (SELECT p, i, x0, x1, row_number() OVER (PARTITION BY p ORDER BY i) AS n FROM b2 JOIN titles_only USING (p)
  WHERE textish AND label = 'title' AND NOT titles_only),
place_steps(p, n, i, best, cols) AS (SELECT p, 0::BIGINT, -1::BIGINT, 0::BIGINT, cols FROM first_hulls UNION ALL
  SELECT p, n, i, best, list_transform(cols, lambda c, k: CASE WHEN k = best THEN {{'x0': least(c.x0, x0), 'x1': greatest(c.x1, x1)}} ELSE c END)
  FROM (SELECT s.p, t.n, t.i, t.x0, t.x1, s.cols, -list_max(list_transform(s.cols, lambda c, k: {{'s': {q.overlap('t.', 'c.')} * 3.0
          - abs((t.x0 + t.x1) / 2 - (c.x0 + c.x1) / 2) / greatest(c.x1 - c.x0, 1), 'k': -k}})).k AS best
        FROM place_steps s JOIN to_place t ON t.p = s.p AND t.n = s.n + 1)),
it AS MATERIALIZED (SELECT b2.*, CASE WHEN NOT textish THEN -1 WHEN best IS NOT NULL THEN best - 1 ELSE len(list_filter(starts, lambda s: s <= b2.x0)) - 1 END AS col
  FROM b2 LEFT JOIN starts USING (p) LEFT JOIN place_steps USING (p, i))"""


TITLES_SQL = f"""title_hulls AS {hulls_sql('(SELECT * FROM it WHERE textish)', 'col')},
bodies AS MATERIALIZED (SELECT * FROM it WHERE textish AND label = 'text' AND filled AND NOT credit AND NOT non_article),
spanned AS MATERIALIZED (SELECT it.*, hulls, {span_sql('hulls')} AS found, CASE WHEN len(found) > 0 THEN found ELSE [col] END AS span
  FROM it JOIN title_hulls USING (p) WHERE textish AND label = 'title' AND NOT aux),
beside AS (SELECT t.p, t.i,
    max(b.y1) FILTER (WHERE b.y0 < t.y0 AND direct) AS above, min(b.y0) FILTER (WHERE b.y1 > t.y0 AND direct) AS below,
    max(b.y1) FILTER (WHERE b.y0 < t.y0 AND reached) AS s_above, min(b.y0) FILTER (WHERE b.y1 > t.y0 AND reached) AS s_below
  FROM spanned t JOIN (SELECT *, true AS one FROM bodies) b USING (p), LATERAL (SELECT {q.overlap('b.', 't.')} >= 0.12 OR b.col = t.col AS direct,
    {in_span_sql('b.', 't.', 't.hulls')} AS reached) GROUP BY ALL),
candidates AS MATERIALIZED (SELECT t.p, t.i, x0, y0, x1, y1, span, text_len, norm_len > 110 AND NOT bullet AS long,
    coalesce(y0 - above <= 100 AND below - y1 <= 120, false) AS direct, coalesce(y0 - s_above <= 110 AND s_below - y1 <= 120, false) AS reached,
    row_number() OVER (PARTITION BY t.p ORDER BY y0, x0, t.i) AS n FROM spanned t LEFT JOIN beside USING (p, i)),
keeping(p, n, i, stays, kept) AS (SELECT p, 0::BIGINT, -1::BIGINT, false, []::STRUCT(x0 BIGINT, x1 BIGINT, y1 BIGINT, span BIGINT[])[] FROM title_hulls UNION ALL
  SELECT p, n, i, NOT embedded, CASE WHEN embedded THEN kept ELSE list_append(kept, {{'x0': x0, 'x1': x1, 'y1': y1, 'span': span::BIGINT[]}}) END
  FROM (SELECT *, len(rel) > 0 AND (direct OR (y0 - list_max(list_transform(rel, lambda k: k.y1)) > 320 AND reached))
          AND NOT (greatest(x1 - x0, 1) > list_max(list_transform(rel, lambda k: greatest(k.x1 - k.x0, 1))) * 0.95 AND long) AS embedded
        FROM (SELECT t.*, s.kept, list_filter(s.kept, lambda k: list_has_any(k.span, t.span::BIGINT[]) OR {q.overlap('k.', 't.')} >= 0.18) AS rel
              FROM keeping s JOIN candidates t ON t.p = s.p AND t.n = s.n + 1))),
kept AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY p ORDER BY c.n) AS m FROM candidates c JOIN keeping USING (p, i) WHERE stays),
contexts AS (SELECT p, list({{{box_sql()}}}) AS context FROM it WHERE label = 'text' AND filled AND NOT credit GROUP BY p),
stacking(p, m, i, lead, x0, y0, x1, y1) AS (SELECT p, m, i, i, x0, y0, x1, y1 FROM kept WHERE m = 1 UNION ALL
  SELECT p, m, i, CASE WHEN joins THEN lead ELSE i END, CASE WHEN joins THEN least(sx0, x0) ELSE x0 END, CASE WHEN joins THEN least(sy0, y0) ELSE y0 END,
    CASE WHEN joins THEN greatest(sx1, x1) ELSE x1 END, CASE WHEN joins THEN greatest(sy1, y1) ELSE y1 END
  FROM (SELECT *, y0 - sy1 <= CASE WHEN apart THEN near ELSE greatest(near, CASE WHEN led THEN 280 ELSE 160 END) END AND shared >= 0.5 AS joins
        FROM (SELECT t.p, t.m, t.i, t.x0, t.y0, t.x1, t.y1, s.lead, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1, {q.overlap('s.', 't.')} AS shared,
                greatest(20, floor(greatest(s.y1 - s.y0, t.y1 - t.y0, 0) * 0.8)) AS near,
                greatest(s.x1 - s.x0, 1) >= greatest(t.x1 - t.x0, 1) * 2.0 AND (greatest(t.x1 - t.x0, 1) <= greatest(s.x1 - s.x0, 1) * 0.45 OR t.text_len <= 48) AS led,
                len(list_filter(coalesce(context, []), lambda c: c.y0 >= s.y1 AND c.y1 <= t.y0 AND greatest(0, least(greatest(s.x1, t.x1), c.x1)
                  - greatest(least(s.x0, t.x0), c.x0)) / least(greatest(1, greatest(s.x1, t.x1) - least(s.x0, t.x0)), greatest(1, c.x1 - c.x0)) >= 0.2)) > 0 AS apart
              FROM stacking s JOIN kept t ON t.p = s.p AND t.m = s.m + 1 LEFT JOIN contexts c ON c.p = s.p))),
leads AS MATERIALIZED (SELECT p, i, lead FROM stacking)"""


def q_title_groups(blocks: DataFrame) -> DataFrame:
    pages = cl.title_groups(cl.page_rows(blocks))
    rows = pages.select(*PAGE, F.explode(F.arrays_zip("blocks", "columns", "leads")).alias("z"), F.col("blocks.block_id").alias("ids"))
    return rows.where(F.col("z.leads") >= 0).select(*PAGE, "z.blocks.block_id", F.col("z.columns").alias("column_index"),
                                                    F.get("ids", F.col("z.leads")).alias("lead_id"))


def title_groups_sql(cte: str, source: str) -> str:
    return f"""WITH RECURSIVE {cte}, {items_sql(source)}, {TITLES_SQL}
SELECT t.doc_id, t.page_no, t.block_id, t.col::INT AS column_index, h.block_id AS lead_id
FROM leads l JOIN it t USING (p, i) JOIN it h ON h.p = l.p AND h.i = l.lead"""


@query("title_groups", title_groups_sql(SHEET_SQL, "sheet"))
def q_sheet_title_groups(spark, sf_dir):
    """Titles that start an article, each with the one that leads its stack."""
    return q_title_groups(sheet_blocks(spark, sf_dir))


@query("title_groups_rough", title_groups_sql(ROUGH_SQL, "rough"))
def q_rough_title_groups(spark, sf_dir):
    return q_title_groups(rough_blocks(spark, sf_dir))


OWN = ("label", "x0", "y0", "x1", "y1", "filled", "aux", "credit", "non_article", "short_title", "placeholder", "norm", "body", "shown",
       "body_len", "title_len", "confidence")
RANK = """CASE WHEN label = 'title' AND filled AND NOT aux AND NOT non_article THEN 0 WHEN label = 'caption' AND filled AND NOT credit THEN 1
  WHEN label = 'text' AND short_title AND NOT non_article THEN 2 END"""
NO_BODY = "NOT filled OR aux OR credit OR non_article"

CLAIMS_SQL = f"""stacks AS (SELECT p, lead AS i, 'title' AS label, {q.strip("string_agg(text, ' ' ORDER BY y0, x0, it.i)")} AS text, min(x0) AS x0, min(y0) AS y0,
    max(x1) AS x1, max(y1) AS y1, max(confidence) AS confidence, min(col) AS col FROM leads JOIN it USING (p, i) GROUP BY p, lead HAVING count(*) > 1),
jb AS MATERIALIZED (SELECT p, it.i, it.doc_id, it.page_no, it.block_id, usable_image, textish AND coalesce(lead = it.i, true) AS textish, coalesce(lead = it.i, false) AS lead,
    coalesce(lead <> it.i, false) AS merged, it.col AS home, coalesce(w.col, it.col) AS col, {', '.join(f'CASE WHEN w.i IS NULL THEN it.{n} ELSE w.{n} END AS {n}' for n in OWN)}
  FROM it LEFT JOIN leads USING (p, i) LEFT JOIN {facts_sql('stacks')} w USING (p, i)),
claim_hulls AS {hulls_sql('(SELECT * FROM jb WHERE textish OR merged)', 'home')},
head_spans AS (SELECT jb.*, hulls, {span_sql('hulls')} AS found, CASE WHEN len(found) > 0 THEN found ELSE [col] END AS span,
    row_number() OVER (PARTITION BY p ORDER BY y0, x0, i) AS n FROM jb JOIN claim_hulls USING (p) WHERE textish AND lead),
heads AS MATERIALIZED (SELECT h.*, stop FROM head_spans h LEFT JOIN (SELECT h.p, h.n, min(o.y0) AS stop FROM head_spans h JOIN head_spans o
    ON o.p = h.p AND o.n > h.n AND (list_has_any(o.span, h.span) OR {q.overlap('h.', 'o.')} >= 0.18) GROUP BY h.p, h.n) USING (p, n)),
reaches AS MATERIALIZED (SELECT h.p, h.n, list({{'i': b.i, 'x0': b.x0, 'y0': b.y0, 'y1': b.y1, 'label': b.label}} ORDER BY b.y0, b.x0, b.col, b.i) AS reach
  FROM heads h JOIN jb b ON b.p = h.p AND b.textish AND b.label <> 'title' AND b.y0 >= h.y0 AND (stop IS NULL OR b.y0 < stop) AND {in_span_sql('b.', 'h.', 'h.hulls')}
  GROUP BY h.p, h.n),
claiming(p, n, mine, taken) AS (SELECT DISTINCT p, 0::BIGINT, []::STRUCT(i BIGINT, x0 BIGINT, y0 BIGINT, y1 BIGINT, label VARCHAR)[], []::BIGINT[] FROM heads UNION ALL
  SELECT p, n, mine[1:cut], list_concat(taken, list_transform(mine[1:cut], lambda b: b.i))
  FROM (SELECT *, coalesce(list_min(list_transform(mine, lambda b, k: CASE WHEN k >= 3 AND b.label <> 'caption' AND b.y0 - mine[k - 1].y1
          > greatest(floor(list_sort(list_transform(mine, lambda h: greatest(h.y1 - h.y0, 0)))[len(mine) // 2 + 1] * 3.2), 90) THEN k - 1 END)), len(mine)) AS cut
        FROM (SELECT h.p, h.n, s.taken, list_transform(list_sort(list_transform(list_prepend({{'i': h.i, 'x0': h.x0, 'y0': h.y0, 'y1': h.y1, 'label': h.label}},
                list_filter(coalesce(reach, []), lambda b: NOT list_contains(s.taken, b.i))), lambda b, k: {{'y0': b.y0, 'x0': b.x0, 'k': k, 'b': b}})), lambda s: s.b) AS mine
              FROM claiming s JOIN heads h ON h.p = s.p AND h.n = s.n + 1 LEFT JOIN reaches r ON r.p = h.p AND r.n = h.n))),
claimed AS (SELECT p, n - 1 AS a, unnest(list_transform(mine, lambda b, k: {{'i': b.i, 'k': k}}), recursive := true) FROM claiming WHERE n > 0),
free_runs AS (SELECT p, i, col, y0, x0, y0 - lag(y1) OVER down AS gap, greatest(floor(list_sort(list(greatest(y1 - y0, 0)) OVER (PARTITION BY p, col))
    [count(*) OVER (PARTITION BY p, col) // 2 + 1] * 2.8), 70) AS wide FROM jb WHERE textish AND p NOT IN (SELECT p FROM heads)
  WINDOW down AS (PARTITION BY p, col ORDER BY y0, x0, i)),
free_segments AS (SELECT *, sum(CASE WHEN gap > wide THEN 1 ELSE 0 END) OVER (PARTITION BY p, col ORDER BY y0, x0, i) AS segment FROM free_runs),
members0 AS MATERIALIZED (SELECT p, a, i, k FROM claimed UNION ALL
  SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY col, segment) - 1, i, row_number() OVER (PARTITION BY p, col, segment ORDER BY y0, x0, i) FROM free_segments),
articles0 AS MATERIALIZED (SELECT p, a, min(col) AS col, CASE WHEN p IN (SELECT p FROM heads) THEN 'column_' ELSE 'fallback_column_' END || (min(col) + 1) AS layout
  FROM members0 JOIN jb USING (p, i) GROUP BY p, a)"""


def image_score_sql(m: str, s: str, t: str, body: str) -> str:
    gap = f"CASE WHEN {m}y1 <= {s}y0 THEN {s}y0 - {m}y1 WHEN {m}y0 >= {s}y1 THEN {m}y0 - {s}y1 ELSE 0 END"
    limit = f"greatest(220, floor(greatest({m}y1 - {m}y0, {s}y1 - {s}y0, 1) * 0.75))"
    return f"""CASE WHEN NOT ({gap} > {limit} AND {q.overlap(s, m)} < 0.2) THEN {q.overlap(s, m)} * 4.5
      + CASE WHEN {m}y1 <= {s}y0 THEN 0.9 WHEN {m}y0 >= {s}y1 THEN -0.6 ELSE 0.35 END
      + CASE WHEN {q.overlap(t, m)} >= 0.35 AND {m}y0 - {t}y1 BETWEEN -40 AND greatest(260, floor(greatest({m}y1 - {m}y0, 1) * 0.45)) THEN 1.15 ELSE 0 END
      + greatest(1 - abs(({s}x0 + {s}x1) / 2 - ({m}x0 + {m}x1) / 2) / greatest({s}x1 - {s}x0, {m}x1 - {m}x0, 1), -1) + CASE WHEN {body} THEN 0.5 ELSE 0 END - ({gap}) / {limit} END"""


def caption_score_sql(c: str, m: str) -> str:
    w, h = f"greatest({m}x1 - {m}x0, 1)", f"greatest({m}y1 - {m}y0, 1)"
    gap = f"CASE WHEN {c}y0 >= {m}y1 THEN {c}y0 - {m}y1 WHEN {c}y1 <= {m}y0 THEN {m}y0 - {c}y1 ELSE 0 END"
    pad, limit = f"greatest(24, floor({w} * 0.18))", f"greatest(160, floor({h} * 0.45))"
    return f"""CASE WHEN {c}x1 >= {m}x0 - {pad} AND {c}x0 <= {m}x1 + {pad} AND {gap} <= {limit} THEN {q.overlap(c, m)} * 3
      + CASE WHEN {c}y0 >= {m}y1 THEN 0.45 WHEN {c}y1 <= {m}y0 THEN -0.2 ELSE 0.2 END
      + greatest(1 - abs(({c}x0 + {c}x1) / 2 - ({m}x0 + {m}x1) / 2) / {w}, -1) - ({gap}) / {limit} END"""


def of_image_sql(c: str, pictures: str) -> str:
    """Number of the picture that a caption belongs to."""
    return f"""CASE WHEN len({pictures}) = 1 THEN 1 ELSE -list_max(list_filter(list_transform({pictures}, lambda m, k: {{'s': {caption_score_sql(c, 'm.')}, 'k': -k}}),
      lambda z: z.s IS NOT NULL)).k END"""


def facts_of_articles_sql(n: int) -> str:
    """``facts{n}`` of the articles in ``members{n}`` (p, a, i, k) with ``pictures{n}`` (p, a, i, k): boxes, title, body and captions."""
    return f"""shown{n} AS (SELECT p, a, list({{'i': i, {box_sql()}}} ORDER BY k) AS pictures FROM pictures{n} JOIN jb USING (p, i) GROUP BY p, a),
ranked{n} AS MATERIALIZED (SELECT p, a, jb.*, row_number() OVER (PARTITION BY p, a ORDER BY col, y0, x0, k) AS rk, coalesce(pictures, []) AS pictures,
    CASE WHEN {RANK} = 1 AND pictures IS NULL THEN NULL ELSE {RANK} END AS r FROM members{n} JOIN jb USING (p, i) LEFT JOIN shown{n} USING (p, a)),
titles{n} AS (SELECT p, a, min({{'r': r, 'y0': y0, 'x0': x0, 'rk': rk, 'i': i, 'x1': x1, 'y1': y1, 'len': title_len, 'shown': shown, 'placeholder': placeholder}})
    FILTER (WHERE r IS NOT NULL) AS title, min({{'rk': rk, {box_sql()}}}) AS top,
    min({{'rk': rk, 'len': title_len, 'shown': shown, 'placeholder': placeholder}}) FILTER (WHERE NOT ({NO_BODY})) AS start FROM ranked{n} GROUP BY p, a),
roles{n} AS MATERIALIZED (SELECT b.*, title.i IS NOT DISTINCT FROM b.i AS is_title, title.i IS DISTINCT FROM b.i AND NOT ({NO_BODY} OR (len(pictures) > 0 AND label = 'caption')) AS is_body,
    CASE WHEN len(pictures) > 0 AND label = 'caption' AND filled AND NOT credit AND body_len > 0
      AND row_number() OVER (PARTITION BY p, a, label, filled AND NOT credit, body, x0, y0, x1, y1 ORDER BY rk) = 1 THEN {of_image_sql('', 'pictures')} END AS of_image
  FROM ranked{n} b JOIN titles{n} USING (p, a)),
captions{n} AS (SELECT p, a, sum(len) + count(*) - 1 AS caption_len FROM (SELECT DISTINCT p, a, body, body_len AS len FROM roles{n} WHERE of_image IS NOT NULL) GROUP BY p, a),
facts{n} AS MATERIALIZED (SELECT p, a, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(sum(body_len) FILTER (WHERE is_body AND body_len > 0)
      + count(*) FILTER (WHERE is_body AND body_len > 0) - 1, any_value(caption_len), 0) AS body_len,
    any_value(CASE WHEN title IS NOT NULL THEN title.len ELSE least(coalesce(start.len, 8), 80) END) AS title_len,
    any_value(coalesce(CASE WHEN title IS NOT NULL THEN title.placeholder ELSE start.placeholder END, false)) AS placeholder, any_value(pictures) AS pictures
  FROM (SELECT p, a, x0, y0, x1, y1, is_body, body_len, pictures FROM roles{n} UNION ALL
        SELECT p, a, x0, y0, x1, y1, false, 0, NULL FROM pictures{n} JOIN jb USING (p, i)) JOIN titles{n} USING (p, a) LEFT JOIN captions{n} USING (p, a) GROUP BY p, a)"""


ATTACH_SQL = f"""ready_ranks AS MATERIALIZED (SELECT p, a, jb.*, row_number() OVER (PARTITION BY p, a ORDER BY col, y0, x0, k) AS rk, {RANK} AS r FROM members0 JOIN jb USING (p, i)),
ready_titles AS (SELECT p, a, min({{'rk': rk, {box_sql()}, 'i': -1}}) AS top,
    min({{'r': r, 'y0': y0, 'x0': x0, 'rk': rk, 'i': i, 'x1': x1, 'y1': y1}}) FILTER (WHERE r IN (0, 2)) AS t0,
    min({{'r': r, 'y0': y0, 'x0': x0, 'rk': rk, 'i': i, 'x1': x1, 'y1': y1}}) FILTER (WHERE r IS NOT NULL) AS t1,
    min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ready_ranks GROUP BY p, a),
ready_bodies AS (SELECT p, a, bool_or(NOT ({NO_BODY}) AND body_len > 0 AND i IS DISTINCT FROM t0.i) AS body0,
    bool_or(NOT ({NO_BODY}) AND body_len > 0 AND label <> 'caption' AND i IS DISTINCT FROM t1.i) AS body1,
    bool_or(filled) AND bool_and(non_article AND NOT aux) FILTER (WHERE filled) AND NOT body0 AS stub,
    coalesce(list({{{box_sql('b.')}}} ORDER BY rk) FILTER (WHERE label = 'caption' AND filled AND NOT credit AND body_len > 0), []) AS captions
  FROM ready_ranks b JOIN ready_titles USING (p, a) GROUP BY p, a),
ready AS MATERIALIZED (SELECT p, list({{{', '.join(f"'{s}': coalesce(t0.{s}, top.{s})" for s in Box._fields)}, 'body': body0}} ORDER BY a) AS plain,
    list({{{', '.join(f"'{s}': coalesce(t1.{s}, top.{s})" for s in Box._fields)}, 'body': body1}} ORDER BY a) AS pictured, list(captions ORDER BY a) AS captions,
    list(coalesce(stub, false) ORDER BY a) AS stubs, list({{{box_sql()}, 'pictures': []::STRUCT(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]}} ORDER BY a) AS state
  FROM ready_titles JOIN ready_bodies USING (p, a) GROUP BY p),
pictures AS MATERIALIZED (SELECT p, i, {', '.join(Box._fields)}, row_number() OVER (PARTITION BY p ORDER BY i) AS n FROM jb WHERE usable_image),
hanging(p, n, i, best, state) AS (SELECT p, 0::BIGINT, -1::BIGINT, NULL::BIGINT, state FROM ready UNION ALL
  SELECT p, n, i, best, list_transform(state, lambda s, k: CASE WHEN k = best THEN {{'x0': least(s.x0, x0), 'y0': least(s.y0, y0), 'x1': greatest(s.x1, x1), 'y1': greatest(s.y1, y1),
    'pictures': list_append(s.pictures, {{{box_sql()}}})}} ELSE s END)
  FROM (SELECT m.*, s.state, -list_max(list_filter(list_transform(s.state, lambda s, k: {{'k': -k, 's': CASE WHEN len(s.pictures) > 0 OR NOT stubs[k] THEN
          list_transform([CASE WHEN len(s.pictures) > 0 THEN pictured[k] ELSE plain[k] END], lambda t: {image_score_sql('m.', 's.', 't.',
            f"t.body OR (len(s.pictures) > 0 AND len(list_filter(captions[k], lambda c: {of_image_sql('c.', 's.pictures')} IS NOT NULL)) > 0)")})[1] END}}),
          lambda z: z.s IS NOT NULL).list_transform(lambda z: {{'s': z.s, 'k': z.k}})).k AS best
        FROM hanging s JOIN pictures m ON m.p = s.p AND m.n = s.n + 1 JOIN ready r ON r.p = s.p)),
pictures1 AS MATERIALIZED (SELECT p, best - 1 AS a, i, n AS k FROM hanging WHERE best IS NOT NULL),
hung AS (SELECT p, arg_max(state, n) AS state FROM hanging GROUP BY p),
rest AS MATERIALIZED (SELECT p, i, {', '.join(Box._fields)}, row_number() OVER (PARTITION BY p ORDER BY i) AS n FROM jb
  WHERE textish AND NOT aux AND (p, i) NOT IN (SELECT (p, i) FROM members0) AND p IN (SELECT p FROM hung)),
joining(p, n, i, best, state) AS (SELECT p, 0::BIGINT, -1::BIGINT, NULL::BIGINT, list_transform(state, lambda s: {{{box_sql('s.')}}}) FROM hung UNION ALL
  SELECT p, n, i, best, list_transform(state, lambda s, k: CASE WHEN k = best THEN {{'x0': least(s.x0, x0), 'y0': least(s.y0, y0), 'x1': greatest(s.x1, x1), 'y1': greatest(s.y1, y1)}} ELSE s END)
  FROM (SELECT b.*, s.state, list_min(list_transform(s.state, lambda s, k: {{'d': sqrt(pow((s.x0 + s.x1) / 2 - (b.x0 + b.x1) / 2, 2)
          + pow((s.y0 + s.y1) / 2 - (b.y0 + b.y1) / 2, 2)) - {q.overlap('s.', 'b.')} * 100, 'k': k}})).k AS best
        FROM joining s JOIN rest b ON b.p = s.p AND b.n = s.n + 1)),
members1 AS MATERIALIZED (SELECT * FROM members0 UNION ALL SELECT p, best - 1, i, 1000 + n FROM joining WHERE n > 0)"""

LED = f"len(list_filter(b.pictures, lambda z: greatest(z.x1 - z.x0, 1) >= {W} * 0.55 OR {area_sql('z.')} >= {W * H} * 0.05)) > 0"
LARGEST = f"-list_max(list_transform(line[n].pictures, lambda z, k: {{'s': {area_sql('z.')}, 'k': -k}})).k"
SIDE_BY_SIDE = "least(s.x0, o.x0) AS x0, least(s.y0, o.y0) AS y0, greatest(s.x1, o.x1) AS x1, greatest(s.y1, o.y1) AS y1"

MERGE_SQL = f"""{facts_of_articles_sql(1)},
lined AS MATERIALIZED (SELECT p, list({{'a': a, {box_sql()}, 'col': col, 'layout': layout, 'body_len': body_len, 'title_len': title_len, 'pictures': coalesce(pictures, [])}}
    ORDER BY y0, col, x0, a) AS line FROM facts1 JOIN articles0 USING (p, a) GROUP BY p),
led_steps(p, n, m, live, stop, x0, y0, x1, y1, col, added, used) AS (
  SELECT p, 0::BIGINT, len(line)::BIGINT, false, true, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM lined UNION ALL
  SELECT p, n, m, CASE WHEN n = m THEN NOT list_contains(used, n) ELSE live END, CASE WHEN n = m THEN NOT led ELSE stop OR (NOT skip AND NOT fits AND o.y0 > y1 + greatest(180, floor({H} * 0.06))) END,
    CASE WHEN n = m THEN o.x0 WHEN take THEN least(x0, o.x0) ELSE x0 END, CASE WHEN n = m THEN o.y0 WHEN take THEN least(y0, o.y0) ELSE y0 END,
    CASE WHEN n = m THEN o.x1 WHEN take THEN greatest(x1, o.x1) ELSE x1 END, CASE WHEN n = m THEN o.y1 WHEN take THEN greatest(y1, o.y1) ELSE y1 END,
    CASE WHEN n = m THEN o.col WHEN take THEN least(col, o.col) ELSE col END, CASE WHEN n = m THEN [] WHEN take THEN list_append(added, m) ELSE added END,
    CASE WHEN n <> m AND take THEN list_append(used, m) ELSE used END
  FROM (SELECT *, NOT skip AND fits AS take FROM (
    SELECT *, NOT live OR stop OR list_contains(used, m) AS skip, len(list_filter([o], lambda b: {LED})) > 0 AS led,
      coalesce(len(o.pictures) = 0 AND {q.overlap('largest.', 'o.')} >= 0.18 AND o.y0 - bottom <= greatest(160, floor({H} * 0.045))
        AND NOT (o.title_len > 180 AND o.body_len > 180), false) AS fits
    FROM (SELECT *, line[m] AS o, list_max(list_transform(line[n].pictures, lambda z: z.y1)) AS bottom, line[n].pictures[{LARGEST}] AS largest
      FROM (SELECT s.* EXCLUDE (n, m), line, CASE WHEN s.m < len(line) THEN s.n ELSE s.n + 1 END AS n, CASE WHEN s.m < len(line) THEN s.m + 1 ELSE s.n + 1 END AS m
            FROM led_steps s JOIN lined USING (p)) WHERE n <= len(line))))),
led AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY n) - 1 AS a, l.col, list_prepend(n, added) AS places, line,
    CASE WHEN len(added) > 0 THEN 'image_led' ELSE line[n].layout END AS layout FROM led_steps l JOIN lined USING (p) WHERE n > 0 AND m = len(line) AND live),
from1 AS MATERIALIZED (SELECT p, a AS now, unnest(list_transform(places, lambda x, k: {{'a': line[x].a, 'pos': k}}), recursive := true) FROM led),
members2 AS (SELECT p, now AS a, i, pos * 100000 + rk AS k FROM from1 JOIN roles1 USING (p, a)),
pictures2 AS (SELECT p, now AS a, i, pos * 100000 + k AS k FROM from1 JOIN pictures1 USING (p, a)),
{facts_of_articles_sql(2)},
down AS MATERIALIZED (SELECT f.*, col, layout, row_number() OVER (PARTITION BY p ORDER BY col, y0, x0, a) AS n FROM facts2 f JOIN led USING (p, a)),
closing(p, n, a, g, col, y1) AS (SELECT p, n, a, 0::BIGINT, col, y1 FROM down WHERE n = 1 UNION ALL
  SELECT o.p, o.n, o.a, CASE WHEN near THEN g ELSE g + 1 END, o.col, CASE WHEN near THEN greatest(s.y1, o.y1) ELSE o.y1 END
  FROM closing s JOIN down o ON o.p = s.p AND o.n = s.n + 1,
    LATERAL (SELECT s.col = o.col AND o.y0 - s.y1 <= 50 AND (o.body_len <= 40 OR o.placeholder) AS near)),
members3 AS (SELECT p, g AS a, i, n * 100000 + rk AS k FROM closing JOIN roles2 USING (p, a)),
pictures3 AS (SELECT p, g AS a, i, row_number() OVER (PARTITION BY p, g ORDER BY n, k) AS k FROM closing JOIN pictures2 USING (p, a)),
{facts_of_articles_sql(3)},
articles3 AS (SELECT p, g AS a, arg_min(down.col, down.n) AS col, arg_min(layout, down.n) AS layout FROM closing JOIN down USING (p, a) GROUP BY p, g)"""


def chain_sql(cte: str, source: str, select: str) -> str:
    last = f", {FINAL_SQL}" if "FROM final" in select else ""
    return f"WITH RECURSIVE {cte}, {items_sql(source)}, {TITLES_SQL}, {CLAIMS_SQL}, {ATTACH_SQL}, {MERGE_SQL}{last}\n{select}"


#: Every block and picture of an article, with its role and place.
BLOCKS_SQL = """SELECT doc_id, page_no, a::INT AS article_key, rk::INT - 1 AS rank, CASE WHEN is_title THEN 'title' WHEN is_body THEN 'body' ELSE 'other' END AS role,
  block_id, label, col::INT AS column_index, coalesce(of_image, -1)::INT AS of_image FROM roles3
UNION ALL SELECT doc_id, page_no, a, k, 'image', block_id, label, -1, -1 FROM pictures3 JOIN jb USING (p, i)"""


#: Articles that are kept, in reading order, with title, text and boxes.
FINAL_SQL = f"""caption_texts AS (SELECT p, a, string_agg(body, chr(10) ORDER BY of_image, y0, x0, block_id) AS text, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY p, a, body ORDER BY of_image, y0, x0, block_id) AS nth FROM roles3 WHERE of_image IS NOT NULL) WHERE nth = 1 GROUP BY p, a),
texts3 AS (SELECT p, a, string_agg(body, chr(10) ORDER BY rk) FILTER (WHERE is_body AND body <> '') AS own, avg(confidence) AS confidence, any_value(pictures) AS pictures,
  any_value(doc_id) AS doc_id, any_value(page_no) AS page_no, count(of_image) AS caption_count FROM roles3 GROUP BY p, a),
drafts AS (SELECT t.*, col, layout, f.x0, f.y0, f.x1, f.y1, len(t.pictures) AS image_count, list_max(list_transform(t.pictures, lambda m: {area_sql('m.')})) AS image_area,
    coalesce(nullif(title.shown, ''), left(start.shown, 80), 'Untitled') AS headline, coalesce(nullif(own, ''), c.text, '') AS body_text,
    {', '.join(f'coalesce(title.{side}, top.{side}) AS t{side}' for side in Box._fields)}, {q.normalize('headline')} AS norm_title
  FROM texts3 t JOIN titles3 USING (p, a) JOIN facts3 f USING (p, a) JOIN articles3 USING (p, a) LEFT JOIN caption_texts c USING (p, a)),
final AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p ORDER BY y0, col, x0, a) AS article_order FROM drafts
  WHERE NOT ({q.non_article('norm_title')} AND body_text = '') AND NOT (body_text = '' AND image_count = 1 AND image_area < 70000 AND caption_count = 0)
    AND (body_text <> '' OR (image_count > 0 AND norm_title <> ''))),
header_scores AS MATERIALIZED (SELECT p, a, h.meta, h.norm, h.x0, h.y0, h.block_id, gap, shared * 4.0 + greatest(1 - abs((h.x0 + h.x1) / 2 - (tx0 + tx1) / 2)
      / greatest(tx1 - tx0, h.x1 - h.x0, 1), -1) - gap / greatest(260, floor({H} * 0.16)) AS score
  FROM final JOIN (SELECT * FROM it WHERE meta IS NOT NULL) h USING (p), LATERAL (SELECT greatest(ty0 - h.y1, 0) AS gap, {q.overlap('h.', 't')} AS shared)
  WHERE h.y0 <= ty0 + greatest(60, floor({H} * 0.02)) AND NOT (gap > greatest(260, floor({H} * 0.16)) AND shared < 0.18)),
papers AS (SELECT p, a, norm AS publication FROM header_scores WHERE meta = 'publication'
  QUALIFY row_number() OVER (PARTITION BY p, a ORDER BY score DESC, y0 DESC, x0, norm DESC) = 1),
issue_near AS (SELECT p, a, norm, row_number() OVER (PARTITION BY p, a ORDER BY y0, x0, block_id) AS n FROM (
  SELECT *, first_value(gap) OVER (PARTITION BY p, a ORDER BY score DESC, gap, x0) AS top_gap FROM header_scores WHERE meta = 'issue') WHERE gap <= top_gap + 140),
issue_texts AS (SELECT p, a, list(norm ORDER BY n) AS texts FROM issue_near WHERE n <= 3 GROUP BY p, a),
issue_runs AS (SELECT p, a, n, array_to_string(texts[b:e], ' ') AS run FROM issue_texts, (VALUES (0, 1, 1), (1, 1, 2), (2, 1, 3), (3, 2, 2), (4, 2, 3), (5, 3, 3)) r(n, b, e) WHERE e <= len(texts)),
issue_parts AS (SELECT *, printf('%04d-%02d-%02d', {', '.join(f'regexp_extract(run, {q.lit(ISSUE)}, {k})::INT' for k in (1, 2, 3))}) AS issue_date, {q.strip('part_rest')} AS rest FROM (
  SELECT *, regexp_extract(run, {q.lit(ISSUE)}, 5) AS part_rest
  FROM issue_runs WHERE length(run) <= 96 AND regexp_matches(run, {q.lit(news.ISSUE_DATE)}))),
issues AS (SELECT p, a, issue_date, coalesce(nullif(regexp_extract(rest, {q.lit(LABELLED)}, 1), ''), nullif(regexp_extract(rest, {q.lit(f'^({news.PAGE_NUMBER})$')}, 1), '')) AS issue_page,
    nullif(trim(regexp_extract(rest, {q.lit(LABELLED)}, 2)), '') AS issue_section FROM issue_parts
  QUALIFY row_number() OVER (PARTITION BY p, a ORDER BY (issue_page IS NOT NULL)::INT + (issue_section IS NOT NULL)::INT DESC, n) = 1)"""
ARTICLES_SQL = f"""SELECT doc_id, page_no, article_order, col::INT AS column_index, headline AS title, body_text, {', '.join(f'{s}::INT AS {s}' for s in Box._fields)}, round(confidence + 1e-9, 4) AS confidence,
  layout AS layout_type, image_count, caption_count, publication, issue_date, issue_page, issue_section FROM final LEFT JOIN papers USING (p, a) LEFT JOIN issues USING (p, a)"""
IMAGES_SQL = f"""SELECT doc_id, page_no, a::INT AS article_key, k::INT AS image_order, block_id, {', '.join(f'{s}::INT AS {s}' for s in Box._fields)}, confidence FROM pictures3 JOIN jb USING (p, i)"""
CAPTIONS_SQL = f"""SELECT doc_id, page_no, a::INT AS article_key, of_image::INT AS image_order, block_id, {', '.join(f'{s}::INT AS {s}' for s in Box._fields)}, body AS caption, confidence,
  is_title AS used_as_title FROM roles3 WHERE of_image IS NOT NULL"""
FREE_SQL = f"""SELECT doc_id, page_no, block_id, label, {', '.join(f'{s}::INT AS {s}' for s in Box._fields)} FROM jb
  WHERE textish AND NOT aux AND NOT merged AND (p, i) NOT IN (SELECT (p, i) FROM members3)"""


def placed_blocks(blocks: DataFrame) -> DataFrame:
    pages = cl.cluster_pages(blocks)
    return cl.article_blocks(pages).select(*PAGE, "article_key", "rank", "role", "block_id", "label", "column_index", "of_image")


@query("article_blocks", chain_sql(SHEET_SQL, "sheet", BLOCKS_SQL))
def q_article_blocks(spark, sf_dir):
    return placed_blocks(sheet_blocks(spark, sf_dir))


@query("article_blocks_rough", chain_sql(ROUGH_SQL, "rough", BLOCKS_SQL))
def q_article_blocks_rough(spark, sf_dir):
    return placed_blocks(rough_blocks(spark, sf_dir))


def clustered_articles(blocks: DataFrame) -> DataFrame:
    out = cl.articles(cl.cluster_pages(blocks))
    return out.select(*PAGE, "article_order", "column_index", "title", "body_text", *Box._fields, F.round(F.col("confidence") + 1e-9, 4).alias("confidence"),
                      "layout_type", "image_count", "caption_count", "publication", F.col("issue.parsed.issue_date").alias("issue_date"),
                      F.col("issue.parsed.issue_page").alias("issue_page"), F.col("issue.parsed.issue_section").alias("issue_section"))


@query("cluster_articles", chain_sql(SHEET_SQL, "sheet", ARTICLES_SQL))
def q_cluster_articles(spark, sf_dir):
    return clustered_articles(sheet_blocks(spark, sf_dir))


@query("cluster_articles_rough", chain_sql(ROUGH_SQL, "rough", ARTICLES_SQL))
def q_cluster_articles_rough(spark, sf_dir):
    return clustered_articles(rough_blocks(spark, sf_dir))


@query("article_images", chain_sql(ROUGH_SQL, "rough", IMAGES_SQL))
def q_article_images(spark, sf_dir):
    return cl.images(cl.cluster_pages(rough_blocks(spark, sf_dir)))


@query("article_captions", chain_sql(ROUGH_SQL, "rough", CAPTIONS_SQL))
def q_article_captions(spark, sf_dir):
    return cl.captions(cl.cluster_pages(rough_blocks(spark, sf_dir)))


@query("unassigned_blocks", chain_sql(ROUGH_SQL, "rough", FREE_SQL))
def q_unassigned_blocks(spark, sf_dir):
    return cl.unassigned(cl.cluster_pages(rough_blocks(spark, sf_dir))).select(*PAGE, "block_id", "label", *Box._fields)


# -- documents from their articles ---------------------------------------------------------------

TEXTS_SQL = f"""page_texts AS (SELECT doc_id, page_no, doc_id * 1000000 + page_no AS p,
  coalesce(string_agg({q.strip('text')}, chr(10) ORDER BY seq) FILTER (WHERE {q.strip('text')} <> ''), '') AS page_text FROM sheet GROUP BY doc_id, page_no),
page_articles AS (SELECT p, count(*) AS n, string_agg(headline, '|' ORDER BY article_order) AS titles, string_agg(body_text, '|' ORDER BY article_order) AS bodies,
  string_agg(concat_ws(chr(10) || chr(10), CASE WHEN {q.strip('headline')} <> '' THEN '## ' || {q.strip('headline')} END, nullif({q.strip('body_text')}, '')),
    chr(10) || chr(10) ORDER BY article_order) AS pieces FROM final GROUP BY p),
doc_totals AS (SELECT doc_id, count(*) AS page_count, coalesce(sum(n), 0) AS total_articles, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE page_text <> '') AS full_text,
  string_agg('# Page ' || page_no || chr(10) || chr(10) || coalesce(nullif(pieces, ''), page_text), chr(10) || chr(10) ORDER BY page_no) AS markdown
  FROM page_texts LEFT JOIN page_articles USING (p) GROUP BY doc_id),
batch AS (SELECT doc_id // 7 AS collection_id, doc_id AS file_id FROM documents UNION ALL SELECT doc_id // 7, -1 FROM documents WHERE doc_id % 28 = 0),
done AS (SELECT collection_id, file_id, CASE WHEN markdown IS NULL THEN 'failed' ELSE 'complete' END AS status, CASE WHEN markdown IS NULL THEN 'file not found: ' || file_id END AS error,
  page_count, total_articles, full_text, markdown FROM batch LEFT JOIN doc_totals ON doc_id = file_id)"""


def documents_sql(select: str) -> str:
    return chain_sql(SHEET_SQL, "sheet", select).replace(f", {FINAL_SQL}", f", {FINAL_SQL}, {TEXTS_SQL}") if "FROM final" in select else (
        chain_sql(SHEET_SQL, "sheet", "").rstrip() + f", {FINAL_SQL}, {TEXTS_SQL}\n{select}")


def document_collections(spark, sf_dir) -> DataFrame:
    """Seven documents a collection; every fourth one names a file that does not exist."""
    group = F.floor(F.col("doc_id") / 7)
    docs = inputs.table(spark, sf_dir, "documents").groupBy(group.alias("collection_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.max(
        F.col("doc_id") % 28 == 0).alias("odd"))
    return docs.select("collection_id", F.when(F.col("odd"), F.concat("ids", F.array(F.lit(-1).cast("bigint")))).otherwise(F.col("ids")).alias("file_ids"))


@query("segment_document_pages", documents_sql("""SELECT doc_id, page_no, page_text, coalesce(n, 0) AS n_articles, coalesce(titles, '') AS titles, coalesce(bodies, '') AS bodies
FROM page_texts LEFT JOIN page_articles USING (p)"""))
def q_segment_document_pages(spark, sf_dir):
    """Pages with the articles that the clustering finds."""
    pages = documents.segmented_pages(sheet_blocks(spark, sf_dir))
    return pages.select(*PAGE, "page_text", F.size("articles").cast("long").alias("n_articles"), F.array_join("articles.title", "|").alias("titles"),
                        F.array_join("articles.body_text", "|").alias("bodies"))


@query("batch_run_segment", documents_sql("SELECT collection_id, file_id, status, error, page_count, total_articles, full_text FROM done"))
def q_batch_run_segment(spark, sf_dir):
    rows, _ = documents.run_batch(document_collections(spark, sf_dir), sheet_blocks(spark, sf_dir), "segment_document")
    kind = "struct<page_count:long,total_articles:long,full_text:string>"
    return rows.withColumn("r", F.from_json("result", kind)).select("collection_id", "file_id", "status", "error", "r.*")


@query("batch_run_convert", documents_sql("SELECT collection_id, file_id, status, error, markdown FROM done"))
def q_batch_run_convert(spark, sf_dir):
    rows, _ = documents.run_batch(document_collections(spark, sf_dir), sheet_blocks(spark, sf_dir), "convert_document", formats="markdown")
    return rows.select("collection_id", "file_id", "status", "error", F.get_json_object("result", "$.markdown").alias("markdown"))
