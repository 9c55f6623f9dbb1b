"""Blocks of one page to articles, as Columns over the page's arrays.

What depends on order (titles kept or merged, blocks claimed, pictures and leftovers attached, articles merged) is an ``aggregate``
whose state holds only what later steps look at: boxes, indices, who took which block. Scores and spans that no step
changes are computed before the fold, facts about a finished article after it. A page is one printed sheet, so the
arrays are small; texts are not among them.

An item is a struct of a block's numbers and flags (``ITEM``). An article in the making is a struct of ``column``, ``layout``, ``blocks``
and ``images`` (items) and its box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.geometry import Box, bbox_area, bbox_distance, bbox_height, center_x, h_overlap_ratio
from broadsheet.functions.text import let, once

PAGE = ["doc_id", "page_no"]
SIDES = Box._fields
ITEM = (*SIDES, "column", "home", "label", "textish", "usable_image", "filled", "aux", "credit", "non_article", "short_title", "bullet",
        "placeholder", "norm_len", "text_len", "body_len", "title_len", "text_key", "block_id", "lead", "merged")


# -- small helpers -----------------------------------------------------------------------------

def width(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(1))


def floor(number: Column) -> Column:
    return F.floor(number).cast("int")


def overlap(a: Column, b: Column) -> Column:
    return h_overlap_ratio(Box.of(a), Box.of(b))


def ordered(items: Column, *names: str) -> Column:
    """``items`` by the named fields; equal ones keep their order."""
    keyed = F.transform(items, lambda b, k: F.struct(*[b[n].alias(n) for n in names], k.alias("k"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda s: s["b"])


def reading_order(items: Column) -> Column:
    return ordered(items, "y0", "x0")


def none_of(items: Column) -> Column:
    """An empty array of the same type."""
    return F.filter(items, lambda _: F.lit(False))


def sides(items: Column) -> list[Column]:
    """The hull of ``items``, as named Columns."""
    return [pick(F.transform(items, lambda b: b[side])).alias(side)
            for side, pick in zip(SIDES, (F.array_min, F.array_min, F.array_max, F.array_max))]


def united(a: Column, b: Column) -> list[Column]:
    return [pick(a[side], b[side]).alias(side) for side, pick in zip(SIDES, (F.least, F.least, F.greatest, F.greatest))]


def changed(struct: Column, names: tuple[str, ...], **new: Column) -> Column:
    return F.struct(*[new.get(n, struct[n]).alias(n) for n in names])


def upper_median(numbers: Column) -> Column:
    return let(F.sort_array(numbers), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def column_hulls(items: Column, name: str) -> Column:
    """The width of each column: an array by column number, whose heights mean nothing."""
    last = F.array_max(F.transform(items, lambda b: b[name]))
    return F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda c: let(
        F.filter(items, lambda b: b[name] == c), lambda mine: F.struct(
            F.array_min(F.transform(mine, lambda b: b["x0"])).alias("x0"), F.lit(0).alias("y0"),
            F.array_max(F.transform(mine, lambda b: b["x1"])).alias("x1"), F.lit(0).alias("y1"))))


# -- scores and spans --------------------------------------------------------------------------

def score_image_article(image: Box, article: Box, title: Box, has_body: Column) -> Column:
    """How well a picture fits an article; null where it is too far off."""
    shared = h_overlap_ratio(article, image)
    span = F.greatest(article.x1 - article.x0, image.x1 - image.x0, F.lit(1))
    aligned = 1.0 - F.abs(center_x(article) - center_x(image)) / span
    above, below = image.y1 <= article.y0, image.y0 >= article.y1
    gap = F.when(above, article.y0 - image.y1).when(below, image.y0 - article.y1).otherwise(0)
    place = F.when(above, 0.9).when(below, -0.6).otherwise(0.35)
    image_height = F.greatest(image.y1 - image.y0, F.lit(1))
    limit = F.greatest(F.lit(220), F.floor(F.greatest(image_height, article.y1 - article.y0, F.lit(1)) * 0.75))
    under = image.y0 - title.y1
    titled = (h_overlap_ratio(title, image) >= 0.35) & (under >= -40) & (
        under <= F.greatest(F.lit(260), F.floor(image_height * 0.45)))
    score = (shared * 4.5 + place + F.when(F.coalesce(titled, F.lit(False)), 1.15).otherwise(0.0)
             + F.greatest(aligned, F.lit(-1.0)) + F.when(has_body, 0.5).otherwise(0.0) - gap / limit)
    return F.when(~((gap > limit) & (shared < 0.2)), score)


def score_caption_image(caption: Box, image: Box) -> Column:
    """How well a caption fits a picture; null where it is too far off."""
    w, h = F.greatest(image.x1 - image.x0, F.lit(1)), F.greatest(image.y1 - image.y0, F.lit(1))
    pad = F.greatest(F.lit(24), F.floor(w * 0.18))
    below, above = caption.y0 >= image.y1, caption.y1 <= image.y0
    gap = F.when(below, caption.y0 - image.y1).when(above, image.y0 - caption.y1).otherwise(0)
    place = F.when(below, 0.45).when(above, -0.2).otherwise(0.2)
    limit = F.greatest(F.lit(160), F.floor(h * 0.45))
    aligned = 1.0 - F.abs(center_x(caption) - center_x(image)) / w
    score = h_overlap_ratio(caption, image) * 3.0 + place + F.greatest(aligned, F.lit(-1.0)) - gap / limit
    near = (caption.x1 >= image.x0 - pad) & (caption.x0 <= image.x1 + pad) & (gap <= limit)
    return F.when(near, score)


def title_span(title: Box, own_column: Column, hulls: Column) -> Column:
    """Columns a title spans: those it overlaps or is centred in, else its own."""
    matched = F.filter(F.transform(hulls, lambda h, i: F.when(
        (h_overlap_ratio(title, Box.of(h)) >= 0.18) | ((h["x0"] <= center_x(title)) & (center_x(title) <= h["x1"])), i)),
        F.isnotnull)
    return let(matched, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(own_column)))


def block_in_span(block: Box, column: Column, title: Box, span: Column, hulls: Column) -> Column:
    """A block is in reach of a title: by column, or by overlap with the title or a spanned column."""
    touching = F.exists(span, lambda c: h_overlap_ratio(Box.of(F.get(hulls, c)), block) >= 0.22)
    return F.array_contains(span, column) | (h_overlap_ratio(title, block) >= 0.22) | touching


def rivals(title: Box, span: Column, titles: Column) -> Column:
    """Those of ``titles`` (with box and span) that share a column with the title or overlap it."""
    return F.filter(titles, lambda t: F.arrays_overlap(t["span"], span) | (h_overlap_ratio(title, Box.of(t)) >= 0.18))


def next_title_top(title: Box, span: Column, later: Column) -> Column:
    """Top of the nearest rival among the titles that come later in reading order."""
    return F.array_min(F.transform(rivals(title, span, later), lambda t: t["y0"]))


# -- titles ------------------------------------------------------------------------------------

def _runs_through(title: Column, bodies: Column, before: int, after: int) -> Column:
    """Body text ends shortly above the title and goes on shortly below it."""
    def check(found: Column) -> Column:
        above = F.array_max(F.transform(F.filter(found, lambda b: b["y0"] < title["y0"]), lambda b: b["y1"]))
        below = F.array_min(F.transform(F.filter(found, lambda b: b["y1"] > title["y0"]), lambda b: b["y0"]))
        return F.coalesce((title["y0"] - above <= before) & (below - title["y1"] <= after), F.lit(False))

    return let(bodies, check)


def title_candidates(items: Column) -> Column:
    """Titles in reading order, each with its span and whether the text beside it (``direct``) or in its span runs on through it."""
    def found(textish: Column, hulls: Column, bodies: Column) -> Column:
        def facts(t: Column) -> Column:
            span = title_span(Box.of(t), t["column"], hulls)
            direct = F.filter(bodies, lambda b: (overlap(b, t) >= 0.12) | (b["column"] == t["column"]))

            def with_span(s: Column) -> Column:
                spanned = F.filter(bodies, lambda b: block_in_span(Box.of(b), b["column"], Box.of(t), s, hulls))
                return F.struct(t["i"].alias("i"), *[t[side].alias(side) for side in SIDES], t["text_len"].alias("text_len"), s.alias("span"),
                                _runs_through(t, direct, 100, 120).alias("direct"), _runs_through(t, spanned, 110, 120).alias("spanned"),
                                ((t["norm_len"] > 110) & ~t["bullet"]).alias("long"))

            return let(span, with_span)

        return F.transform(reading_order(F.filter(textish, lambda b: (b["label"] == "title") & ~b["aux"])), facts)

    def body(b: Column) -> Column:
        return (b["label"] == "text") & b["filled"] & ~b["credit"] & ~b["non_article"]

    return let(F.filter(items, lambda b: b["textish"]), lambda textish: let(column_hulls(textish, "column"), lambda hulls: let(
        F.filter(textish, body), lambda bodies: found(textish, hulls, bodies))))


def drop_embedded_titles(candidates: Column) -> Column:
    """The candidates that start an article; a title below a kept one through which the text simply goes on does not."""
    def step(kept: Column, t: Column) -> Column:
        def embedded(related: Column) -> Column:
            below = t["y0"] - F.array_max(F.transform(related, lambda k: k["y1"])) > 320
            wide = width(t) > F.array_max(F.transform(related, width)) * 0.95
            return (F.size(related) > 0) & (t["direct"] | (below & t["spanned"])) & ~(wide & t["long"])

        drop = let(rivals(Box.of(t), t["span"], kept), embedded)
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(candidates, none_of(candidates), step)


def merge_adjacent_titles(kept: Column, items: Column) -> Column:
    """[(i, lead)]: the first title of the stack that each of the ``kept`` titles belongs to."""
    start = F.struct(F.lit(-1).alias("lead"), *[F.lit(0).alias(side) for side in SIDES],
                     F.array().cast("array<struct<i:int,lead:int>>").alias("pairs"))

    def fold(context: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            def height(b: Column) -> Column:
                return F.greatest(b["y1"] - b["y0"], F.lit(0))

            near = F.greatest(F.lit(20), floor(F.greatest(height(s), height(t)) * 0.8))
            both = Box(F.least(s["x0"], t["x0"]), s["y0"], F.greatest(s["x1"], t["x1"]), t["y1"])
            apart = F.exists(context, lambda c: (c["y0"] >= s["y1"]) & (c["y1"] <= t["y0"]) & (h_overlap_ratio(both, Box.of(c)) >= 0.2))
            led = (width(s) >= width(t) * 2.0) & ((width(t) <= width(s) * 0.45) | (t["text_len"] <= 48))
            limit = F.when(apart, near).otherwise(F.greatest(near, F.when(led, 280).otherwise(160)))
            joins = (s["lead"] >= 0) & (t["y0"] - s["y1"] <= limit) & (overlap(s, t) >= 0.5)

            def settled(j: Column) -> Column:
                lead = F.when(j, s["lead"]).otherwise(t["i"])
                box = [F.when(j, u).otherwise(t[side]).alias(side) for side, u in zip(SIDES, united(s, t))]
                return F.struct(lead.alias("lead"), *box, F.concat(s["pairs"], F.array(F.struct(t["i"].alias("i"), lead.alias("lead")))).alias("pairs"))

            return let(joins, settled)

        return F.aggregate(kept, start, step)["pairs"]

    return let(F.filter(items, lambda b: (b["label"] == "text") & b["filled"] & ~b["credit"]), fold)


# -- articles from titles, or from columns -------------------------------------------------------

def cut_at_gap(members: Column) -> Column:
    """``members`` up to the first wide gap behind the second one that no caption fills."""
    def cut(limit: Column) -> Column:
        at = F.transform(members, lambda m, k: F.when(
            (k >= 2) & (m["label"] != "caption") & (m["y0"] - F.get(members, k - 1)["y1"] > limit), k))
        return F.slice(members, F.lit(1), F.coalesce(F.array_min(at), F.size(members)))

    return let(F.greatest(floor(upper_median(F.transform(members, lambda m: bbox_height(Box.of(m)))) * 3.2), F.lit(90)), cut)


def column_runs(members: Column) -> Column:
    """``members`` of a column, in reading order, as arrays cut at wide gaps."""
    def runs(limit: Column) -> Column:
        begins = F.filter(F.transform(members, lambda m, k: F.when(
            (k == 0) | (m["y0"] - F.get(members, k - 1)["y1"] > limit), k)), F.isnotnull)
        return let(begins, lambda at: F.transform(at, lambda k, n: F.slice(
            members, k + 1, F.coalesce(F.get(at, n + 1), F.size(members)) - k)))

    return let(F.greatest(floor(upper_median(F.transform(members, lambda m: bbox_height(Box.of(m)))) * 2.8), F.lit(70)), runs)


def _article(column: Column, layout: str, blocks: Column) -> Column:
    return F.struct(column.alias("column"), F.concat(F.lit(layout), column + 1).alias("layout"), blocks.alias("blocks"))


def claim_blocks(items: Column) -> Column:
    """Articles of a page with titles: each title claims what is in its reach down to the next rival and not taken before.

    What a title claims behind a wide gap goes back, for later titles or as a leftover.
    """
    def fold(textish: Column, hulls: Column) -> Column:
        heads = F.transform(reading_order(F.filter(textish, lambda b: b["lead"])), lambda b: F.struct(
            *[b[side].alias(side) for side in SIDES], b.alias("b"), title_span(Box.of(b), b["column"], hulls).alias("span")))
        free = ordered(F.filter(textish, lambda b: b["label"] != "title"), "y0", "x0", "column", "i")

        def with_reach(heads: Column, free: Column) -> Column:
            def reach(t: Column, end: Column) -> Column:
                return F.filter(free, lambda b: (b["y0"] >= t["y0"]) & (end.isNull() | (b["y0"] < end))
                                & block_in_span(Box.of(b), b["column"], Box.of(t), t["span"], hulls))

            return F.transform(heads, lambda t, n: let(
                next_title_top(Box.of(t), t["span"], F.slice(heads, n + 2, F.size(heads))),
                lambda end: F.struct(t["b"].alias("b"), reach(t, end).alias("reach"))))

        def claims(titles: Column) -> Column:
            start = F.struct(F.array().cast("array<int>").alias("taken"), F.transform(none_of(titles), lambda t: t["reach"]).alias("found"))

            def step(s: Column, t: Column) -> Column:
                mine = F.concat(F.array(t["b"]), F.filter(t["reach"], lambda b: ~F.array_contains(s["taken"], b["i"])))
                return let(let(reading_order(mine), cut_at_gap), lambda m: F.struct(
                    F.concat(s["taken"], F.transform(m, lambda b: b["i"])).alias("taken"), F.concat(s["found"], F.array(m)).alias("found")))

            return F.transform(F.aggregate(titles, start, step)["found"], lambda m: let(
                F.array_min(F.transform(m, lambda b: b["column"])), lambda c: _article(c, "column_", m)))

        return let(let(heads, lambda h: let(free, lambda f: with_reach(h, f))), claims)

    # A merged title widens the column it was placed in, whatever column its stack ends up in.
    wide = F.filter(items, lambda b: b["textish"] | b["merged"])
    return let(F.filter(items, lambda b: b["textish"]), lambda textish: let(column_hulls(wide, "home"), lambda hulls: fold(textish, hulls)))


def split_columns(items: Column) -> Column:
    """Articles of a page without titles: columns cut at wide gaps."""
    def of_column(textish: Column, c: Column) -> Column:
        members = reading_order(F.filter(textish, lambda b: b["column"] == c))
        return F.transform(let(members, column_runs), lambda run: _article(c, "fallback_column_", run))

    return let(F.filter(items, lambda b: b["textish"]), lambda textish: F.flatten(F.transform(
        F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(textish, lambda b: b["column"])), F.lit(0))), lambda c: of_column(textish, c))))


# -- facts about an article ----------------------------------------------------------------------

def in_article_order(blocks: Column) -> Column:
    return ordered(blocks, "column", "y0", "x0")


def select_title(blocks: Column, pictured: Column) -> Column:
    """The topmost title, else (with pictures) caption, else short text; null if there is none."""
    def rank(b: Column) -> Column:
        return (F.when((b["label"] == "title") & b["filled"] & ~b["aux"] & ~b["non_article"], 0)
                .when(pictured & (b["label"] == "caption") & b["filled"] & ~b["credit"], 1)
                .when((b["label"] == "text") & b["short_title"] & ~b["non_article"], 2))

    ranked = F.transform(blocks, lambda b, k: let(rank(b), lambda r: F.when(r.isNotNull(), F.struct(
        r.alias("r"), b["y0"].alias("y0"), b["x0"].alias("x0"), k.alias("k"), b.alias("b")))))
    return F.array_min(ranked)["b"]


def is_body(b: Column, title: Column, pictured: Column) -> Column:
    return (b["filled"] & ~b["aux"] & ~b["credit"] & ~b["non_article"] & ~(pictured & (b["label"] == "caption"))
            & ~F.coalesce(b["i"] == title["i"], F.lit(False)))


def caption_candidates(blocks: Column) -> Column:
    """Captions with text that are no credits, each text at a place once."""
    found = F.filter(blocks, lambda b: (b["label"] == "caption") & b["filled"] & ~b["credit"] & (b["body_len"] > 0))

    def same(a: Column, b: Column) -> Column:
        return F.struct(*[a[n] for n in ("text_key", *SIDES)]) == F.struct(*[b[n] for n in ("text_key", *SIDES)])

    return let(found, lambda caps: F.filter(caps, lambda c, k: ~F.exists(F.slice(caps, F.lit(1), k), lambda e: same(c, e))))


def caption_image(caption: Column, images: Column) -> Column:
    """Number, from 1, of the picture that a caption belongs to: the only one, or the first of the best; null if all are too far off."""
    scored = F.transform(images, lambda m, k: let(score_caption_image(Box.of(caption), Box.of(m)), lambda s: F.when(
        s.isNotNull(), F.struct(s.alias("s"), (-k).alias("k")))))
    return F.when(F.size(images) == 1, 1).otherwise(1 - F.array_max(scored)["k"])


def article_facts(blocks: Column, images: Column) -> Column:
    """title (item or null), body_len and title_len of the texts, and whether the title is a placeholder."""
    pictured = F.size(images) > 0

    def facts(title: Column) -> Column:
        own = F.transform(F.filter(blocks, lambda b: is_body(b, title, pictured) & (b["body_len"] > 0)), lambda b: b["body_len"])
        shown = F.filter(caption_candidates(blocks), lambda c: caption_image(c, images).isNotNull())
        captions = F.transform(F.array_distinct(F.transform(shown, lambda c: F.struct(c["text_key"].alias("key"), c["body_len"].alias("n")))), lambda c: c["n"])
        lengths = let(own, lambda o: F.when((F.size(o) == 0) & pictured, captions).otherwise(o))
        first = F.get(F.filter(blocks, lambda b: b["filled"] & ~b["aux"] & ~b["credit"] & ~b["non_article"]), F.lit(0))
        head = F.coalesce(title, first)
        return let(lengths, lambda ns: let(head, lambda h: F.struct(
            title.alias("title"), (F.aggregate(ns, F.lit(0), lambda a, n: a + n) + F.greatest(F.size(ns) - 1, F.lit(0))).alias("body_len"),
            F.when(title.isNotNull(), title["title_len"]).otherwise(F.least(F.coalesce(h["title_len"], F.lit(len("Untitled"))), F.lit(80))).alias("title_len"),
            F.coalesce(h["placeholder"], F.lit(False)).alias("placeholder"))))

    return let(select_title(blocks, pictured), facts)


# -- pictures and leftovers ----------------------------------------------------------------------

def attach_images(articles: Column, items: Column) -> Column:
    """``articles`` with box and ``images``: each picture, in list order, joins the article it fits best and makes it taller."""
    pictures = F.filter(items, lambda b: b["usable_image"])

    def prepared(a: Column) -> Column:
        """What an article offers without (0) and with (1) pictures."""
        blocks = in_article_order(a["blocks"])

        def facts(blocks: Column) -> Column:
            def of(pictured: bool):
                title = select_title(blocks, F.lit(pictured))
                return let(title, lambda t: F.struct(
                    *[F.coalesce(t[side], F.get(blocks, F.lit(0))[side]).alias(side) for side in SIDES],
                    F.exists(blocks, lambda b: is_body(b, t, F.lit(pictured)) & (b["body_len"] > 0)).alias("body")))

            filled = F.filter(blocks, lambda b: b["filled"])
            stub = (F.size(filled) > 0) & F.forall(filled, lambda b: b["non_article"] & ~b["aux"])
            return let(of(False), lambda plain: F.struct(
                plain.alias("plain"), of(True).alias("pictured"), caption_candidates(blocks).alias("captions"), (stub & ~plain["body"]).alias("stub")))

        return let(blocks, facts)

    def fold(ready: Column) -> Column:
        start = F.transform(articles, lambda a: F.struct(*sides(a["blocks"]), none_of(pictures).alias("images")))

        def step(state: Column, picture: Column) -> Column:
            def score(r: Column, s: Column) -> Column:
                any_ = F.size(s["images"]) > 0
                title = Box(*[F.when(any_, r["pictured"][side]).otherwise(r["plain"][side]) for side in SIDES])
                body = F.when(any_, r["pictured"]["body"] | F.exists(r["captions"], lambda c: caption_image(c, s["images"]).isNotNull())).otherwise(r["plain"]["body"])
                return F.when(any_ | ~r["stub"], score_image_article(Box.of(picture), Box.of(s), title, body))

            scored = F.transform(state, lambda s, k: let(score(F.get(ready, k), s), lambda x: F.when(
                x.isNotNull(), F.struct(x.alias("x"), (-k).alias("k")))))
            return let(-F.array_max(scored)["k"], lambda best: F.transform(state, lambda s, k: F.when(k == best, F.struct(
                *united(s, picture), F.concat(s["images"], F.array(picture)).alias("images"))).otherwise(s)))

        return let(F.aggregate(pictures, start, step), lambda state: F.transform(articles, lambda a, k: F.struct(
            a["column"].alias("column"), a["layout"].alias("layout"), a["blocks"].alias("blocks"), F.get(state, k)["images"].alias("images"),
            *[F.get(state, k)[side].alias(side) for side in SIDES])))

    return let(F.when(F.size(pictures) > 0, F.transform(articles, prepared)), fold)


def attach_leftovers(articles: Column, items: Column) -> Column:
    """Each text that no article took, in list order, joins the nearest article and makes it larger."""
    def fold(taken: Column) -> Column:
        rest = F.filter(items, lambda b: b["textish"] & ~b["aux"] & ~F.array_contains(taken, b["i"]))
        start = F.transform(articles, lambda a: F.struct(*[a[side].alias(side) for side in SIDES], none_of(a["blocks"]).alias("added")))

        def step(state: Column, b: Column) -> Column:
            away = F.transform(state, lambda s, k: F.struct(
                (bbox_distance(Box.of(s), Box.of(b)) - overlap(s, b) * 100).alias("away"), k.alias("k")))
            return let(F.array_min(away)["k"], lambda best: F.transform(state, lambda s, k: F.when(k == best, F.struct(
                *united(s, b), F.concat(s["added"], F.array(b)).alias("added"))).otherwise(s)))

        return let(F.aggregate(rest, start, step), lambda state: F.transform(articles, lambda a, k: changed(
            a, ("column", "layout", "blocks", "images", *SIDES), blocks=F.concat(a["blocks"], F.get(state, k)["added"]),
            **{side: F.get(state, k)[side] for side in SIDES})))

    return let(F.flatten(F.transform(articles, lambda a: F.transform(a["blocks"], lambda b: b["i"]))), fold)


# -- merges ----------------------------------------------------------------------------------------

MADE = ("column", "layout", "blocks", "images", *SIDES)
KNOWN = ("body_len", "title_len", "placeholder")


def with_facts(articles: Column) -> Column:
    """``articles`` with their blocks in order and the facts that the merges look at."""
    return F.transform(articles, lambda a: let(in_article_order(a["blocks"]), lambda blocks: let(
        article_facts(blocks, a["images"]), lambda f: F.struct(
            *[(blocks if n == "blocks" else a[n]).alias(n) for n in MADE], *[f[n].alias(n) for n in KNOWN]))))


def merge_image_led(articles: Column, page_width: Column, page_height: Column) -> Column:
    """An article led by a large picture takes in the imageless ones right under the picture, down to the first that is far below."""
    area = F.greatest(page_width.cast("long") * page_height, F.lit(1))

    def size(b: Column) -> Column:
        return bbox_area(Box.of(b))

    def led(a: Column) -> Column:
        return F.exists(a["images"], lambda m: (width(m) >= page_width * 0.55) | (size(m) >= area * 0.05))

    def fold(listed: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("used"), none_of(listed).alias("merged"))

        def taken_in(base: Column, n: Column, used: Column) -> Column:
            """The box and column of ``base`` after it took in others, and their places."""
            bottom = F.array_max(F.transform(base["images"], lambda m: m["y1"]))
            largest = F.array_max(F.transform(base["images"], lambda m, k: F.struct(size(m).alias("size"), (-k).alias("k"), m.alias("m"))))["m"]
            names = (*SIDES, "column", "stop", "added")
            begin = F.struct(*[base[x].alias(x) for x in (*SIDES, "column")], F.lit(False).alias("stop"), F.array().cast("array<int>").alias("added"))

            def over(bottom: Column, largest: Column) -> Column:
                def step(s: Column, m: Column) -> Column:
                    other = F.get(listed, m)
                    fits = ((F.size(other["images"]) == 0) & (overlap(largest, other) >= 0.18)
                            & (other["y0"] - bottom <= F.greatest(F.lit(160), floor(page_height * 0.045)))
                            & ~((other["title_len"] > 180) & (other["body_len"] > 180)))
                    far = other["y0"] > s["y1"] + F.greatest(F.lit(180), floor(page_height * 0.06))
                    joined = F.struct(*united(s, other), F.least(s["column"], other["column"]).alias("column"), s["stop"].alias("stop"),
                                      F.concat(s["added"], F.array(m)).alias("added"))
                    return (F.when(s["stop"] | F.array_contains(used, m), s).when(fits, joined)
                            .otherwise(changed(s, names, stop=far)))

                return F.aggregate(F.filter(F.transform(listed, lambda _, m: m), lambda m: m > n), begin, step)

            return let(bottom, lambda b: let(largest, lambda m: over(b, m)))

        def step(s: Column, n: Column) -> Column:
            base = F.get(listed, n)

            def settled(t: Column) -> Column:
                more = F.flatten(F.transform(t["added"], lambda m: F.get(listed, m)["blocks"]))
                whole = changed(base, (*MADE, *KNOWN), blocks=F.concat(base["blocks"], more), layout=F.when(
                    F.size(t["added"]) > 0, F.lit("image_led")).otherwise(base["layout"]), **{x: t[x] for x in (*SIDES, "column")})
                return F.struct(F.concat(s["used"], t["added"]).alias("used"), F.concat(s["merged"], F.array(whole)).alias("merged"))

            alone = F.struct(s["used"].alias("used"), F.concat(s["merged"], F.array(base)).alias("merged"))
            return (F.when(F.array_contains(s["used"], n), s).when(led(base), let(taken_in(base, n, s["used"]), settled)).otherwise(alone))

        return F.aggregate(F.transform(listed, lambda _, n: n), start, step)["merged"]

    return let(ordered(articles, "y0", "column", "x0"), fold)


def merge_fragments(articles: Column) -> Column:
    """An article with next to no body, or without a title of its own, joins the one closely above it in its column."""
    def step(merged: Column, a: Column) -> Column:
        def settled(last: Column) -> Column:
            joins = F.coalesce((last["column"] == a["column"]) & (a["y0"] - last["y1"] <= 50) & ((a["body_len"] <= 40) | a["placeholder"]), F.lit(False))
            whole = F.struct(last["column"].alias("column"), last["layout"].alias("layout"), F.concat(last["blocks"], a["blocks"]).alias("blocks"),
                             F.concat(last["images"], a["images"]).alias("images"), *united(last, a), *[last[n].alias(n) for n in KNOWN])
            return F.when(joins, F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(whole))).otherwise(F.concat(merged, F.array(a)))

        return let(F.get(merged, F.size(merged) - 1), settled)

    return let(ordered(articles, "column", "y0", "x0"), lambda listed: F.aggregate(listed, none_of(listed), step))


# -- the outcome -----------------------------------------------------------------------------------

def outcome(articles: Column) -> Column:
    """[(i, article, rank, role, of_image)] of every block and picture of an article."""
    def entries(a: Column, number: Column) -> Column:
        def roles(blocks: Column) -> Column:
            pictured = F.size(a["images"]) > 0

            def entry(b: Column, rank: Column, title: Column, captions: Column) -> Column:
                role = F.when(b["i"] == title["i"], "title").when(is_body(b, title, pictured), "body").otherwise("other")
                of_image = F.when(F.exists(captions, lambda c: c["i"] == b["i"]), caption_image(b, a["images"]))
                return F.struct(b["i"].alias("i"), number.alias("article"), rank.alias("rank"), role.alias("role"),
                                F.coalesce(of_image, F.lit(-1)).alias("of_image"))

            captions = F.when(pictured, caption_candidates(blocks)).otherwise(none_of(blocks))
            texts = let(select_title(blocks, pictured), lambda title: let(captions, lambda caps: F.transform(
                blocks, lambda b, rank: entry(b, rank, title, caps))))
            pictures = F.transform(a["images"], lambda m, k: F.struct(
                m["i"].alias("i"), number.alias("article"), (k + 1).alias("rank"), F.lit("image").alias("role"), F.lit(-1).alias("of_image")))
            return F.concat(texts, pictures)

        return let(in_article_order(a["blocks"]), roles)

    return F.flatten(F.transform(articles, entries))


@once
def _steps() -> list[Column]:
    """``made`` step by step, from ``items`` and the page's size."""
    i, made = F.col("items"), F.col("made")
    titled = F.exists(i, lambda b: b["textish"] & b["lead"])
    led = merge_image_led(made, F.col("width"), F.col("height"))
    return [F.when(titled, claim_blocks(i)).otherwise(split_columns(i)), attach_images(made, i), with_facts(attach_leftovers(made, i)),
            with_facts(led), merge_fragments(made)]


@once
def _results() -> tuple[Column, Column]:
    found = F.transform("made", lambda a: F.struct(a["column"].alias("column_index"), a["layout"].alias("layout_type")))
    return outcome(F.col("made")), found


def build_articles(pages: DataFrame) -> DataFrame:
    """Adds ``entries`` (see ``outcome``) and ``found`` (column_index, layout_type of each article) to pages with ``items``."""
    for step in _steps():
        pages = pages.withColumn("made", step)
    entries, found = _results()
    return pages.withColumns({"entries": entries, "found": found}).drop("made")
