"""Blocks of newspaper pages to articles, anchored on titles.

One shuffle brings the blocks of a page together; everything after it works on the page's row: columns and title placement
here, titles, claims, pictures and merges in ``page_articles``, texts, header data and reading order here again, all as
array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import newspaper as news
from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box, bbox_area, center_x, h_overlap_ratio
from broadsheet.operators import page_articles as made
from broadsheet.operators.page_articles import PAGE

TEXT_LABELS = ("title", "text", "caption")
NEG_INF = float("-inf")


# -- facts about single blocks ---------------------------------------------------------------

def text_facts(label: Column, text: Column, plain: Column, norm: Column) -> dict[str, Column]:
    """What the clustering needs to know about one block's text.

    ``plain`` is the text without markup, ``norm`` the same on one line.
    """
    shown = F.when((label == "caption") & (F.length(plain) > 80),
                   F.concat(F.regexp_replace(F.substring(plain, 1, 77), f"{tx.SPACE}+$", ""), F.lit("..."))
                   ).otherwise(plain)
    return {
        "norm": norm, "body": news.strip_trailing_credit(norm), "title_text": shown,
        "text_len": F.length(tx.strip(text)), "norm_len": F.length(norm), "filled": tx.strip(text) != "",
        "aux": news.is_aux_title(norm), "credit": news.is_credit(norm),
        "non_article": news.is_non_article_title(norm), "short_title": news.is_short_title(norm),
        "bullet": norm.rlike("^[◆■]"), "placeholder": shown.startswith("page_") | shown.startswith("article_"),
    }


def text_lengths(body: Column, title_text: Column) -> dict[str, Column]:
    return {"body_len": F.length(body), "title_len": F.length(title_text), "text_key": F.xxhash64(body)}


def source_metadata_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that name the publication or the issue, with their kind."""
    return (
        blocks.where(F.col("label").isin(*TEXT_LABELS, "header"))
        .withColumn("norm", tx.normalize_text(F.col("text")))
        .withColumn("metadata_kind", news.metadata_kind(F.col("norm")))
        .where(F.col("metadata_kind").isNotNull())
    )


def is_noise(label: Column, text: Column, norm: Column, y0: Column, page_height: Column) -> Column:
    bare = tx.strip(text)
    symbols = (F.length(bare) <= 2) & ~bare.rlike(r"[\p{L}\p{N}]")
    header = (y0 <= page_height * 0.14) & (news.is_page_metadata(norm) | news.is_publication_header(norm))
    return label.isin("header", "footer", "advertisement") | (bare == "") | symbols | news.is_credit(norm) | header


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Title, text and caption blocks that are neither page metadata nor noise."""
    norm = F.col("norm")
    return blocks.where(F.col("label").isin(*TEXT_LABELS)).withColumn("norm", tx.normalize_text(F.col("text"))).where(
        news.metadata_kind(norm).isNull()
        & ~is_noise(F.col("label"), F.col("text"), norm, F.col("y0"), F.col("height"))
    )


def is_usable_image(box: Box, layout_label: Column, page_width: Column, page_height: Column) -> Column:
    """Large enough, not a strip, not a banner at the page's edge, not a logo or advertisement."""
    w, h = F.greatest(box.x1 - box.x0, F.lit(1)), F.greatest(box.y1 - box.y0, F.lit(1))
    edge = (box.y0 < page_height * 0.04) | (box.y1 > page_height * 0.96)
    banner = edge & (w > page_width * 0.6) & (h < page_height * 0.12)
    return (
        (bbox_area(box) >= page_width * page_height * 0.002) & (w / h <= 8) & (w / h >= 0.125) & ~banner
        & ~F.coalesce(layout_label.isin("logo", "advertisement", "ad"), F.lit(False))
    )


def usable_images(blocks: DataFrame) -> DataFrame:
    layout = F.col("layout_label") if "layout_label" in blocks.columns else F.lit(None)
    keep = is_usable_image(Box.named(), layout, F.col("width"), F.col("height"))
    return blocks.where((F.col("label") == "image") & keep)


# -- columns ---------------------------------------------------------------------------------

def column_tolerance(page_width: Column) -> Column:
    return F.greatest(F.floor(page_width * 0.05), F.lit(40)).cast("int")


def column_starts(counts: Column, tolerance: Column) -> Column:
    """Left edges where a new column begins, from ``[(x0, n)]`` sorted by x0.

    A block joins the column whose mean left edge is within tolerance. Taken from left to right
    only the newest column can match, and equal edges always share a column, so a count per edge
    is enough and the array is no longer than the page is wide.
    """
    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("total"),
                     F.lit(0).cast("long").alias("n"))

    def step(acc: Column, item: Column) -> Column:
        mean = F.floor(acc["total"] / F.greatest(acc["n"], F.lit(1)))
        joins = (acc["n"] > 0) & (item["x0"] - mean <= tolerance)
        weight = item["x0"].cast("long") * item["n"]
        return F.struct(
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(item["x0"]))).alias("starts"),
            F.when(joins, acc["total"] + weight).otherwise(weight).alias("total"),
            F.when(joins, acc["n"] + item["n"]).otherwise(item["n"]).cast("long").alias("n"),
        )

    return F.aggregate(counts, empty, step)["starts"]


def column_of(x0: Column, starts: Column) -> Column:
    """Index of the last column beginning at or left of ``x0``."""
    return F.size(F.filter(starts, lambda s: s <= x0)) - 1


def assign_columns(blocks: DataFrame) -> DataFrame:
    """Column index of every non-title block (of every block on pages of titles only).

    Edges are counted before the shuffle; the blocks themselves only meet the short list of
    column starts of their page.
    """
    counts = blocks.groupBy(*PAGE, "x0").agg(
        F.count_if(F.col("label") != "title").alias("n_seed"), F.count(F.lit(1)).alias("n_all"),
        F.max("width").alias("width"))
    edges = counts.groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("x0", "n_seed", "n_all"))).alias("edges"), F.max("width").alias("width"),
        F.sum("n_seed").alias("seeds"))
    seeded = F.filter("edges", lambda e: (F.col("seeds") == 0) | (e["n_seed"] > 0))
    weighted = F.transform(seeded, lambda e: F.struct(
        e["x0"].alias("x0"), F.when(F.col("seeds") == 0, e["n_all"]).otherwise(e["n_seed"]).alias("n")))
    starts = edges.select(*PAGE, "seeds", column_starts(weighted, column_tolerance(F.col("width"))).alias("starts"))
    joined = blocks.join(starts, PAGE)
    seed = (F.col("label") != "title") | (F.col("seeds") == 0)
    return joined.where(seed).withColumn("column_index", column_of(F.col("x0"), F.col("starts"))).drop("starts", "seeds")


def place_titles(titles: Column, columns: Column) -> Column:
    """Column of each title in list order; a placed title widens its column for the next."""
    start = F.struct(columns.alias("columns"), F.array().cast("array<int>").alias("placed"))

    def step(acc: Column, title: Column) -> Column:
        def score(c: Column) -> Column:
            shared = F.greatest(F.lit(0), F.least(title["x1"], c["x1"]) - F.greatest(title["x0"], c["x0"]))
            ratio = shared / F.least(F.greatest(F.lit(1), title["x1"] - title["x0"]), F.greatest(F.lit(1), c["x1"] - c["x0"]))
            off = F.abs((title["x0"] + title["x1"]) / 2 - (c["x0"] + c["x1"]) / 2)
            return ratio * 3.0 - off / F.greatest(c["x1"] - c["x0"], F.lit(1))

        best = -F.array_max(F.transform(acc["columns"], lambda c, i: F.struct(score(c).alias("s"), (-i).alias("i"))))["i"]
        wider = F.transform(acc["columns"], lambda c, i: F.when(i == best, F.struct(
            F.least(c["x0"], title["x0"]).alias("x0"), F.greatest(c["x1"], title["x1"]).alias("x1"))).otherwise(c))
        return F.struct(wider.alias("columns"), F.concat(acc["placed"], F.array(best)).alias("placed"))

    return F.aggregate(titles, start, step)["placed"]


# -- one row per page ------------------------------------------------------------------------

FACTS = ("norm", "body", "title_text", "text_len", "norm_len", "body_len", "title_len", "text_key",
         "filled", "aux", "credit", "non_article", "short_title", "bullet", "placeholder")


def page_rows(blocks: DataFrame) -> DataFrame:
    """One row per page: its size and ``blocks``, an array of structs in list order.

    Every struct carries its facts; ``columns`` runs alongside. The raw blocks are shuffled by page
    first, which is the only shuffle of the clustering: the facts, several copies of the text, are
    computed behind it and the grouping reuses its partitioning.
    """
    blocks = blocks.repartition(*PAGE)
    layout = F.col("layout_label") if "layout_label" in blocks.columns else F.lit(None).cast("string")
    known = blocks.select(
        *PAGE, "width", "height", "seq", "block_id", "label", "x0", "y0", "x1", "y1", "text", "confidence",
        layout.alias("layout_label"), tx.strip_markup(F.col("text")).alias("plain"))
    known = known.withColumn("norm", tx.squeeze(F.col("plain")))
    known = known.withColumns(text_facts(*[F.col(c) for c in ("label", "text", "plain", "norm")]))
    meta = F.when(F.col("label").isin(*TEXT_LABELS, "header"), news.metadata_kind(F.col("norm")))
    known = known.withColumns(text_lengths(F.col("body"), F.col("title_text")) | {"metadata_kind": meta})
    textish = (
        F.col("label").isin(*TEXT_LABELS) & F.col("metadata_kind").isNull() & F.col("filled") & ~F.col("credit")
        & ~((F.col("text_len") <= 2) & ~F.col("norm").rlike(r"[\p{L}\p{N}]"))
    )
    image = (F.col("label") == "image") & is_usable_image(
        Box.named(), F.col("layout_label"), F.col("width"), F.col("height"))
    known = known.withColumns({"textish": textish, "usable_image": image})
    item = F.struct("seq", "block_id", "label", "x0", "y0", "x1", "y1", "text", "confidence", *FACTS,
                    "metadata_kind", "textish", "usable_image")
    pages = known.groupBy(*PAGE).agg(
        F.max("width").alias("width"), F.max("height").alias("height"),
        F.sort_array(F.collect_list(item)).alias("blocks"))
    return _with_columns(pages)


def _with_columns(pages: DataFrame) -> DataFrame:
    """Adds ``columns``: the column index of each block, -1 where it is not textish."""
    textish = F.filter("blocks", lambda b: b["textish"])
    pages = pages.withColumn("titles_only", ~F.exists(textish, lambda b: b["label"] != "title"))
    seeds = F.filter(textish, lambda b: F.col("titles_only") | (b["label"] != "title"))
    edges = F.transform(F.array_sort(F.transform(seeds, lambda b: b["x0"])),
                        lambda x: F.struct(x.alias("x0"), F.lit(1).cast("long").alias("n")))
    pages = pages.withColumn("starts", column_starts(edges, column_tolerance(F.col("width"))))
    hulls = F.transform("starts", lambda s, i: F.struct(
        s.alias("x0"),
        F.array_max(F.transform(F.filter(seeds, lambda b: column_of(b["x0"], F.col("starts")) == i),
                                lambda b: b["x1"])).alias("x1")))
    titles = F.filter(textish, lambda b: ~F.col("titles_only") & (b["label"] == "title"))
    pages = pages.withColumn("placed", place_titles(titles, hulls))
    seq = F.transform(titles, lambda b: b["seq"])
    # Bound by let: a column that stands once, inside a lambda, would be inlined there and computed for every block.
    column = tx.let(F.col("placed"), lambda placed: tx.let(F.col("starts"), lambda starts: tx.let(seq, lambda seq: F.transform(
        "blocks", lambda b: F.when(~b["textish"], -1).when(
            (b["label"] == "title") & ~F.col("titles_only"), F.get(placed, (F.array_position(seq, b["seq"]) - 1).cast("int")),
        ).otherwise(column_of(b["x0"], starts))))))
    return pages.withColumn("columns", column).drop("starts", "placed", "titles_only")


def _items(**more) -> Column:
    """The numbers and flags of the page's blocks that ``page_articles`` works on; ``more`` makes fields that blocks don't have."""
    return F.transform("blocks", lambda b, i: F.struct(i.alias("i"), *[
        (more[n](b, i) if n in more else b[n]).alias(n) for n in made.ITEM]))


@tx.once
def _title_steps() -> dict[str, Column]:
    never = lambda b, i: F.lit(False)

    def items(columns: Column) -> Column:
        column = lambda b, i: F.get(columns, i)
        return _items(column=column, home=column, lead=never, merged=never)

    def leads(pairs: Column) -> Column:
        return F.transform("blocks", lambda b, i: F.coalesce(F.get(F.filter(pairs, lambda p: p["i"] == i), F.lit(0))["lead"], F.lit(-1)))

    return {"items": tx.let(F.col("columns"), items), "kept": made.drop_embedded_titles(made.title_candidates(F.col("items"))),
            "pairs": made.merge_adjacent_titles(F.col("kept"), F.col("items")), "leads": tx.let(F.col("pairs"), leads)}


def title_groups(pages: DataFrame) -> DataFrame:
    """Adds ``leads``: per block the index of the title leading its title group, else -1."""
    for name, step in _title_steps().items():
        pages = pages.withColumn(name, step)
    return pages.drop("items", "kept", "pairs")


def merge_title_blocks(pages: DataFrame) -> DataFrame:
    """Gives each leading title the text, hull and lowest column of its whole group."""
    pages = pages.withColumn("zipped", F.arrays_zip("blocks", "columns", "leads"))
    return pages.withColumn("blocks", _merged_blocks()).drop("columns", "leads", "zipped")


@tx.once
def _merged_blocks() -> Column:
    def members(i: Column) -> Column:
        return F.array_sort(F.transform(
            F.filter("zipped", lambda m: m["leads"] == i),
            lambda m: F.struct(*[m["blocks"][n].alias(n) for n in ("y0", "x0", "seq", "y1", "x1", "text", "confidence")],
                               m["columns"].alias("column"))))

    def whole(b: Column, home: Column, group: Column) -> Column:
        def over(name: str, pick) -> Column:
            return pick(F.transform(group, lambda m: m[name]))

        def build(text: Column, plain: Column, norm: Column) -> Column:
            facts = text_facts(b["label"], text, plain, norm)
            facts |= text_lengths(facts["body"], facts["title_text"])
            facts |= {"x0": over("x0", F.array_min), "y0": over("y0", F.array_min), "x1": over("x1", F.array_max),
                      "y1": over("y1", F.array_max), "text": text, "confidence": over("confidence", F.array_max)}
            return F.struct(*[facts.get(name, b[name]).alias(name) for name in BLOCK_FIELDS],
                            over("column", F.array_min).alias("column"), home.alias("home"), F.lit(True).alias("lead"),
                            F.lit(False).alias("merged"))

        text = tx.strip(F.array_join(F.transform(group, lambda m: m["text"]), " "))
        return tx.let(text, lambda t: tx.let(tx.strip_markup(t), lambda p: tx.let(tx.squeeze(p), lambda n: build(t, p, n))))

    def settled(item: Column, i: Column) -> Column:
        b, lead = item["blocks"], item["leads"]
        alone = F.struct(*[
            (b[name] & ((lead == -1) | (lead == i)) if name == "textish" else b[name]).alias(name)
            for name in BLOCK_FIELDS], item["columns"].alias("column"), item["columns"].alias("home"),
            (lead == i).alias("lead"), ((lead >= 0) & (lead != i)).alias("merged"))
        several = (lead == i) & (F.size(F.filter("leads", lambda other: other == i)) > 1)
        return F.when(several, tx.let(members(i), lambda g: whole(b, item["columns"], g))).otherwise(alone)

    return F.transform("zipped", settled)


BLOCK_FIELDS = ("seq", "block_id", "label", "x0", "y0", "x1", "y1", "text", "confidence", *FACTS,
                "metadata_kind", "textish", "usable_image")


def cluster_pages(blocks: DataFrame, **more: Column) -> DataFrame:
    """One row per page with ``blocks`` and ``articles`` arrays.

    ``articles``, ``images``, ``captions``, ``article_blocks`` and ``unassigned`` explode it; write
    or persist it when several of them are needed. A block's ``article`` counts from 0 within the
    page and is -1 where it belongs to none. ``more`` are columns of a page made from its ``blocks`` as they were given.
    """
    pages = merge_title_blocks(title_groups(page_rows(blocks).withColumns(more)))
    steps = _page_steps()
    pages = made.build_articles(pages.withColumn("items", steps["items"]))
    kept = [*PAGE, "width", "height", *more]
    pages = pages.select(*kept, "blocks", "found", steps["by_index"].alias("entries"))
    pages = pages.select(*kept, steps["placed"].alias("blocks"), "found").withColumn("drafts", steps["drafts"])
    # Behind a generator, so that filters on the outcome (an explode brings some) are not pushed down as copies of the whole computation.
    outcome = F.struct("blocks", steps["ordered"].alias("articles"))
    return pages.select(*kept, F.explode(F.array(outcome)).alias("page")).select(*kept, "page.blocks", "page.articles")


@tx.once
def _page_steps() -> dict[str, Column]:
    by_index = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["i"].alias("i"), e.alias("e"))))
    none = {"article": F.lit(-1), "rank": F.lit(-1), "role": F.lit("none"), "of_image": F.lit(-1)}

    def placed(entries: Column, b: Column, i: Column) -> Column:
        return tx.let(F.try_element_at(entries, i), lambda e: F.struct(
            *[F.coalesce(e[n], default).alias(n) for n, default in none.items()], *[b[n].alias(n) for n in BLOCK_FIELDS],
            b["column"].alias("column_index"), b["merged"].alias("merged")))

    drafts = F.transform("found", lambda a, number: tx.let(
        F.filter("blocks", lambda b: b["article"] == number), lambda mine: _draft(a, number, mine)))
    kept = F.filter("drafts", lambda d: tx.let(tx.normalize_text(d["title"]), lambda title: keep_article(
        title, d["body_text"], d["image_count"], d["image_area"], d["caption_count"])))
    order = ("y0", "column_index", "x0", "article_key")
    ordered = F.array_sort(F.transform(kept, lambda d: F.struct(*[d[n].alias(n) for n in order], d.alias("d"))))
    return {"items": _items(), "by_index": by_index, "drafts": drafts, "ordered": F.transform(ordered, lambda o: o["d"]),
            "placed": tx.let(F.col("entries"), lambda entries: F.transform("blocks", lambda b, i: placed(entries, b, i)))}


def _draft(found: Column, number: Column, mine: Column) -> Column:
    """One article from its blocks and pictures."""
    texts = F.array_sort(F.transform(F.filter(mine, lambda b: b["role"] != "image"), lambda b: F.struct(
        b["rank"].alias("rank"), b.alias("b"))))
    pictures = F.filter(mine, lambda b: b["role"] == "image")

    def finish(texts: Column) -> Column:
        title = F.get(F.filter(texts, lambda t: t["b"]["role"] == "title"), F.lit(0))["b"]
        start = F.get(F.filter(texts, lambda t: (t["b"]["norm"] != "") & ~t["b"]["aux"] & ~t["b"]["credit"]
                               & ~t["b"]["non_article"]), F.lit(0))["b"]
        first = F.get(texts, F.lit(0))["b"]
        body = F.array_join(F.transform(F.filter(
            texts, lambda t: (t["b"]["role"] == "body") & (t["b"]["body"] != "")), lambda t: t["b"]["body"]), "\n")
        captions = F.transform(F.array_sort(F.transform(
            F.filter(texts, lambda t: t["b"]["of_image"] > 0),
            lambda t: F.struct(*[t["b"][n].alias(n) for n in ("of_image", "y0", "x0", "block_id", "body")]))),
            lambda c: c["body"])
        box = [pick(F.transform(mine, lambda b: b[side])).alias(side) for side, pick in zip(
            Box._fields, (F.array_min, F.array_min, F.array_max, F.array_max))]
        return F.struct(
            number.alias("article_key"), found["column_index"].alias("column_index"),
            F.coalesce(F.nullif(title["title_text"], F.lit("")), F.substring(start["title_text"], 1, 80), F.lit("Untitled"))
            .alias("title"),
            F.coalesce(F.nullif(body, F.lit("")), F.array_join(F.array_distinct(captions), "\n"), F.lit("")).alias("body_text"),
            *[F.coalesce(title[side], first[side]).alias(f"title_{side}") for side in Box._fields], *box,
            (F.aggregate(texts, F.lit(0.0), lambda acc, t: acc + t["b"]["confidence"]) / F.size(texts)).alias("confidence"),
            found["layout_type"].alias("layout_type"), F.size(pictures).alias("image_count"),
            F.array_max(F.transform(pictures, lambda b: bbox_area(Box.of(b)))).alias("image_area"),
            F.size(captions).alias("caption_count"), F.size(texts).alias("block_count"))

    return tx.let(texts, finish)


# -- tables of the clustered pages -----------------------------------------------------------

def articles(pages: DataFrame) -> DataFrame:
    """One row per article in reading order, with publication and issue read from the page header."""
    headers = F.transform(F.filter("blocks", lambda b: b["metadata_kind"].isNotNull()), lambda b: F.struct(
        *[b[n].alias(n) for n in (*Box._fields, "block_id", "metadata_kind", "norm")]))
    rows = pages.select(*PAGE, "height", headers.alias("headers"), F.posexplode("articles").alias("pos", "a"))
    anchor = Box.of(F.struct(*[F.col(f"a.title_{side}").alias(side) for side in Box._fields]))
    return rows.select(
        *PAGE, (F.col("pos") + 1).alias("article_order"), "a.*",
        attach_publication(F.col("headers"), anchor, F.col("height")).alias("publication"),
        attach_issue(F.col("headers"), anchor, F.col("height")).alias("issue")).drop("image_area")


def article_blocks(pages: DataFrame) -> DataFrame:
    """Every block or picture of an article, with its role, its place and (captions) the number of its picture."""
    b = F.col("b")
    return pages.select(*PAGE, F.explode("blocks").alias("b")).where(b["article"] >= 0).select(
        *PAGE, b["article"].alias("article_key"), "b.rank", "b.role", "b.block_id", "b.label", "b.column_index", "b.of_image")


def images(pages: DataFrame) -> DataFrame:
    """Attached pictures, numbered within their article."""
    b = F.col("b")
    return pages.select(*PAGE, F.explode("blocks").alias("b")).where(b["role"] == "image").select(
        *PAGE, b["article"].alias("article_key"), b["rank"].alias("image_order"), "b.block_id",
        *[b[side].alias(side) for side in Box._fields], "b.confidence")


def captions(pages: DataFrame) -> DataFrame:
    """Captions of attached pictures, credits stripped, with the ones serving as title marked."""
    b = F.col("b")
    return pages.select(*PAGE, F.explode("blocks").alias("b")).where(b["of_image"] > 0).select(
        *PAGE, b["article"].alias("article_key"), b["of_image"].alias("image_order"), "b.block_id",
        *[b[side].alias(side) for side in Box._fields], b["body"].alias("caption"), "b.confidence",
        (b["role"] == "title").alias("used_as_title"))


def unassigned(pages: DataFrame) -> DataFrame:
    """Text blocks that ended up in no article (only on pages without any)."""
    b = F.col("b")
    free = (b["article"] < 0) & b["textish"] & ~b["aux"] & ~b["merged"]
    return pages.select(*PAGE, F.explode("blocks").alias("b")).where(free).select(
        *PAGE, "b.block_id", "b.label", *[b[side].alias(side) for side in Box._fields], "b.text")


def keep_article(title: Column, body: Column, images: Column, image_area: Column, captions: Column) -> Column:
    """Drops header-only and empty articles and those that are one small picture without caption.

    ``title`` is normalised text.
    """
    empty = body == ""
    lone = empty & (images == 1) & (image_area < 70000) & (captions == 0)
    return ~(news.is_non_article_title(title) & empty) & ~lone & (~empty | ((images > 0) & (title != "")))


# -- publication and issue -------------------------------------------------------------------

def score_source_block(block: Box, title: Box, page_height: Column) -> Column:
    """How well a header block fits a title; null where it cannot belong to it."""
    overlap = h_overlap_ratio(block, title)
    span = F.greatest(title.x1 - title.x0, block.x1 - block.x0, F.lit(1))
    aligned = 1.0 - F.abs(center_x(block) - center_x(title)) / span
    gap = F.greatest(title.y0 - block.y1, F.lit(0))
    limit = F.greatest(F.lit(260), F.floor(page_height * 0.16))
    allowed = (block.y0 <= title.y0 + F.greatest(F.lit(60), F.floor(page_height * 0.02))) & ~((gap > limit) & (overlap < 0.18))
    return F.when(allowed, overlap * 4.0 + F.greatest(aligned, F.lit(-1.0)) - gap / limit)


def _scored(headers: Column, kind: str, title: Box, page_height: Column) -> Column:
    mine = F.filter(headers, lambda h: h["metadata_kind"] == kind)
    scored = F.transform(mine, lambda h: F.struct(
        score_source_block(Box.of(h), title, page_height).alias("score"),
        F.greatest(title.y0 - h["y1"], F.lit(0)).alias("gap"), h.alias("h")))
    return F.filter(scored, lambda s: s["score"].isNotNull())


def attach_publication(headers: Column, title: Box, page_height: Column) -> Column:
    """Text of the best publication block: by score, then lowest, then leftmost."""
    ranked = F.transform(_scored(headers, "publication", title, page_height), lambda s: F.struct(
        s["score"].alias("score"), s["h"]["y0"].alias("y0"), (-s["h"]["x0"]).alias("x0"), s["h"]["norm"].alias("text")))
    return F.array_max(ranked)["text"]


def attach_issue(headers: Column, title: Box, page_height: Column) -> Column:
    """Issue data read from up to three header blocks near the best one, most complete first."""
    ranked = F.array_sort(F.transform(_scored(headers, "issue", title, page_height), lambda s: F.struct(
        (-s["score"]).alias("score"), s["gap"].alias("gap"), s["h"]["x0"].alias("x0"), s["h"].alias("h"))))
    return tx.let(tx.let(ranked, _nearby_texts), _best_issue)


def _nearby_texts(ranked: Column) -> Column:
    limit = F.get(ranked, F.lit(0))["gap"] + 140
    near = F.transform(F.filter(ranked, lambda s: s["gap"] <= limit), lambda s: F.struct(
        s["h"]["y0"].alias("y0"), s["h"]["x0"].alias("x0"), s["h"]["block_id"].alias("block_id"), s["h"]["norm"].alias("text")))
    return F.transform(F.slice(F.array_sort(near), 1, 3), lambda s: s["text"])


def _best_issue(texts: Column) -> Column:
    """The most complete reading of any run of the texts; the first one where several tie."""
    runs = F.array(*[F.struct(F.lit(-n).alias("n"), F.lit(start).alias("start"), F.lit(end).alias("end"))
                     for n, (start, end) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)])])
    joined = F.transform(F.filter(runs, lambda r: r["end"] < F.size(texts)), lambda r: F.struct(
        r["n"].alias("n"), F.array_join(F.slice(texts, r["start"] + 1, r["end"] - r["start"] + 1), " ").alias("raw_issue_text")))
    parsed = F.transform(joined, lambda j: F.struct(
        news.parse_issue_metadata(j["raw_issue_text"]).alias("parsed"), j["n"].alias("n"),
        j["raw_issue_text"].alias("raw_issue_text")))
    rated = F.transform(F.filter(parsed, lambda c: c["parsed"].isNotNull()), lambda c: F.struct(
        (F.when(c["parsed"]["issue_page"].isNotNull(), 1).otherwise(0)
         + F.when(c["parsed"]["issue_section"].isNotNull(), 1).otherwise(0)).alias("complete"),
        c["n"].alias("n"), c["parsed"].alias("parsed"), c["raw_issue_text"].alias("raw_issue_text")))
    return F.array_max(rated)


def column_segments(blocks: DataFrame) -> DataFrame:
    """Segment number of each block of a column, cut where the gap is wide for the column."""
    down = F.struct("y0", "x0", "seq", F.struct(*blocks.columns).alias("b"))
    columns = blocks.groupBy(*PAGE, "column_index").agg(F.sort_array(F.collect_list(down)).alias("down"))
    runs = made.column_runs(F.transform("down", lambda d: d["b"]))
    rows = columns.select(F.posexplode(runs).alias("segment", "run")).select(F.explode("run").alias("b"), "segment")
    return rows.select("b.*", F.col("segment").cast("long").alias("segment"))
