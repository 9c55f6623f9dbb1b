"""Documents to text, Markdown, HTML, chunks and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box, clamp_bbox

PAGE = ["doc_id", "page_no"]

# Labels sharing a rendering.
HEADINGS = ("title", "sectionheader")
FORMULAS = ("equation_block", "chemical_block")
NAMED = ("form", "table_of_contents", "bibliography", "complex_block", "blank_page")
ITALIC = ("caption", "footnote", "pageheader", "pagefooter", "header", "footer")
PREFORMATTED = ("table", "code_block", "equation_block", "chemical_block", "form", "complex_block")
IMAGE_LABELS = ("image", "figure", "photo", "picture", "illustration", "chart", "graphic", "diagram")


def _wrap(before: str, text: Column, after: str = "") -> Column:
    return F.concat(F.lit(before), text, F.lit(after))


def block_markdown(label: Column, text: Column, table_rows: Column | None = None) -> Column:
    """Markdown of one block by its label; a table with rows becomes a pipe table."""
    low, bare = F.lower(label), tx.strip(F.coalesce(text, F.lit("")))
    table = _wrap("**Table**\n\n", bare)
    if table_rows is not None:
        table = F.when(F.size(table_rows) > 0, tx.rows_to_markdown_table(table_rows, 1)).otherwise(table)
    named = F.concat(F.lit("**"), F.initcap(F.replace(low, F.lit("_"), F.lit(" "))), F.lit("**\n\n"), bare)
    return (
        F.when(bare == "", "").when(low.isin(*HEADINGS), _wrap("## ", bare)).when(low == "table", table)
        .when(low == "code_block", _wrap("```text\n", bare, "\n```")).when(low.isin(*FORMULAS), _wrap("$$\n", bare, "\n$$"))
        .when(low.isin(*NAMED), named).when(low.isin(*ITALIC), _wrap("*", bare, "*")).otherwise(bare))


def block_html(label: Column, text: Column, block_id: Column | None = None) -> Column:
    """HTML of one block; blank where it shows nothing."""
    words = F.replace(tx.escape_html(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("<br/>"))
    kind = tx.escape_html(F.coalesce(label, F.lit("text")))
    attributes = F.concat(F.lit(" class='block block-"), kind, F.lit("'"))
    if block_id is not None:
        ident = tx.escape_html(F.coalesce(block_id, F.lit("")))
        attributes = F.concat(attributes, F.when(ident != "", _wrap(" data-block-id='", ident, "'")).otherwise(""))

    def tag(name: str, content: Column) -> Column:
        return F.concat(F.lit(f"<{name}"), attributes, F.lit(">"), content, F.lit(f"</{name}>"))

    return (
        F.when(kind.isin(*HEADINGS) & (words != ""), tag("h3", words)).when(kind == "image", tag("figure", F.lit("")))
        .when(kind.isin(*PREFORMATTED) & (words != ""), tag("pre", words)).when(words != "", tag("p", words)).otherwise(""))


def _in_order(value: Column, order: str = "seq") -> Column:
    """Values of a page's rows in list order, blanks and nulls left out."""
    listed = F.sort_array(F.collect_list(F.when(value != "", F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(listed, lambda s: s["v"])


def listed_text(blocks: Column) -> Column:
    """``page_text`` of an array of a page's blocks."""
    listed = F.filter(F.transform(blocks, lambda b: F.struct(b["seq"].alias("o"), tx.strip(b["text"]).alias("v"))), lambda s: s["v"] != "")
    return F.array_join(F.transform(F.sort_array(listed), lambda s: s["v"]), "\n")


def page_text(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.array_join(_in_order(tx.strip(F.col("text"))), "\n").alias("page_text"))


def document_text(page_texts: DataFrame) -> DataFrame:
    """Full text of a document: its non-blank pages with a blank line between."""
    full = F.array_join(_in_order(F.col("page_text"), "page_no"), "\n\n")
    return page_texts.groupBy("doc_id").agg(full.alias("full_text"))


def _piece(title: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", F.when(title != "", _wrap("## ", title)), F.nullif(body, F.lit("")))


def _marked(pieces: Column) -> Column:
    content = F.coalesce(F.nullif(pieces, F.lit("")), F.when(tx.strip(F.col("page_text")) != "", F.col("page_text")), F.lit(""))
    return F.concat(F.lit("# Page "), F.col("page_no"), F.lit("\n\n"), content).alias("page_markdown")


def page_markdown(page_texts: DataFrame, articles: DataFrame) -> DataFrame:
    """``# Page n`` and its articles, or the page text where there are none."""
    piece = _piece(tx.strip(F.col("title")), tx.strip(F.col("body_text")))
    merged = articles.groupBy(*PAGE).agg(F.array_join(_in_order(piece, "article_order"), "\n\n").alias("pieces"))
    return page_texts.join(merged, PAGE, "left").select(*PAGE, _marked(F.col("pieces")))


def page_markdown_of(pages: DataFrame) -> DataFrame:
    """The same of pages that carry their text and their ``articles`` in order, page by page."""
    pieces = F.transform("articles", lambda a: _piece(tx.strip(a["title"]), tx.strip(a["body_text"])))
    return pages.select(*PAGE, _marked(F.array_join(F.filter(pieces, lambda p: p != ""), "\n\n")))


def page_html(blocks: DataFrame, block_ids: bool = False) -> DataFrame:
    shown = block_html(F.col("label"), F.col("text"), F.col("block_id") if block_ids else None)
    pages = blocks.withColumn("shown", shown).groupBy(*PAGE).agg(
        F.array_join(_in_order(F.col("shown")), "").alias("body"),
        F.array_join(_in_order(tx.strip(F.col("text"))), "\n").alias("words"))
    fallback = F.concat(F.lit("<p>"), F.replace(tx.escape_html(F.col("words")), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    number = F.col("page_no").cast("string")
    return pages.select(*PAGE, F.concat(
        F.lit("<section data-page='"), number, F.lit("'><h2>Page "), number, F.lit("</h2>"),
        F.when(F.col("body") != "", F.col("body")).otherwise(fallback), F.lit("</section>")).alias("page_html"))


def join_pages(pages: DataFrame, column: str, paginate: bool = False, html: bool = False) -> DataFrame:
    """Pages of a document as one text; a separator carries the number of the page after it.

    The text of one document is one value of the result, so its pages meet in one row.
    """
    number = F.col("page_no").cast("string")
    mark = (F.concat(F.lit("<hr data-page-break='"), number, F.lit("'/>")) if html
            else F.concat(number, F.lit("-" * 48)))
    filled = pages.where(tx.strip(F.col(column)) != "").select("doc_id", F.struct("page_no", mark.alias("mark"), F.col(column).alias("v")).alias("p"))
    listed = filled.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    glue = "" if html else "\n\n"
    marked = F.transform("ps", lambda p, i: F.when((i > 0) & F.lit(paginate), F.concat_ws(glue, p["mark"], p["v"])).otherwise(p["v"]))
    text = F.array_join(marked, glue)
    if html:
        text = F.concat(F.lit("<html><body>"), text, F.lit("</body></html>"))
    return listed.select("doc_id", text.alias(column.replace("page_", "document_")))


def chunks(blocks: DataFrame, files: DataFrame | None = None, markdown: bool = False) -> DataFrame:
    """One row per block with its page and file, and its Markdown if asked for."""
    out = blocks.select(*PAGE, "seq", "block_id", "label", *Box._fields, "text", "confidence",
                        *([block_markdown(F.col("label"), F.col("text")).alias("markdown")] if markdown else []))
    return out if files is None else out.join(files.select("doc_id", "file_name"), "doc_id")


FORMATS = ("json", "markdown", "html", "chunks")


def output_formats(text: str | None) -> list[str]:
    """Formats asked for, in order and once each; Markdown if none is named."""
    asked = list(dict.fromkeys(part for part in ((text or "").replace(" ", "").lower().split(",")) if part))
    if any(name not in FORMATS for name in asked):
        raise ValueError("output_format must contain only: " + ", ".join(sorted(FORMATS)))
    return asked or ["markdown"]


def convert(blocks: DataFrame, articles: DataFrame, formats: str | None = None, paginate: bool = False, block_ids: bool = False) -> DataFrame:
    """One row per document with a column per requested format; only those are computed."""
    return convert_marked(blocks, page_markdown(page_text(blocks), articles), formats, paginate, block_ids)


def convert_marked(blocks: DataFrame, marked: DataFrame, formats: str | None = None, paginate: bool = False, block_ids: bool = False) -> DataFrame:
    """``convert`` with the pages' Markdown given."""
    parts = []
    for name in output_formats(formats):
        if name == "markdown":
            parts.append(join_pages(marked, "page_markdown", paginate).withColumnRenamed("document_markdown", "markdown"))
        elif name == "html":
            parts.append(join_pages(page_html(blocks, block_ids), "page_html", paginate, html=True)
                         .withColumnRenamed("document_html", "html"))
        else:
            item = F.struct("page_no", "seq", "block_id", "label", *Box._fields, "text", "confidence")
            parts.append(blocks.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "doc_id", "full_outer")
    return out


def ocr_lines(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("label") != "image").select(*PAGE, "seq", "text", *Box._fields, "label", "confidence")


# -- exports ---------------------------------------------------------------------------------

def crop_manifest(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Assets of a page: its own image and one crop per distinct picture box.

    A box is clamped only for its size; the crop's number follows the first block with that box.
    """
    page_rows = pages.select(*PAGE, F.lit("page").alias("kind"), F.lit(0).alias("image_order"), *[F.lit(None).cast("int").alias(s) for s in Box._fields],
                             F.col("width").alias("crop_width"), F.col("height").alias("crop_height"),
                             F.format_string("page-%04d.png", F.col("page_no")).alias("name"))
    first = blocks.where(F.col("label").isin(*IMAGE_LABELS)).groupBy(*PAGE, *Box._fields).agg(
        F.min("seq").alias("seq"), F.max("width").alias("width"), F.max("height").alias("height"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq"))
    box = clamp_bbox(Box.named(), F.col("width"), F.col("height"))
    crops = first.withColumn("image_order", order).select(
        *PAGE, F.lit("crop").alias("kind"), "image_order", *Box._fields, (box.x1 - box.x0).alias("crop_width"),
        (box.y1 - box.y0).alias("crop_height"), F.format_string("page-%04d-image-%04d.png", F.col("page_no"), F.col("image_order")).alias("name"))
    return page_rows.unionByName(crops)


def _with_crops(blocks: DataFrame, crops: DataFrame) -> DataFrame:
    names = crops.where(F.col("kind") == "crop").select(*PAGE, *Box._fields, F.col("name").alias("crop_name"))
    return blocks.join(names, [*PAGE, *Box._fields], "left")


def export_markdown(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Markdown of a page in block order, pictures as references to their crops."""
    rows = _with_crops(blocks, crop_manifest(pages, blocks))
    label = F.lower("label")
    image = F.when(F.col("crop_name").isNotNull(), F.concat(F.lit("![Page "), F.col("page_no"), F.lit(" image](images/"), F.col("crop_name"), F.lit(")"))).otherwise("")
    shown = F.when(label.isin(*IMAGE_LABELS), image).when(label == "footnote", tx.strip(F.col("text"))).otherwise(block_markdown(label, F.col("text")))
    body = rows.withColumn("shown", shown).groupBy(*PAGE).agg(F.array_join(_in_order(F.col("shown")), "\n\n").alias("body"))
    number = F.col("page_no").cast("string")
    head = F.concat(F.lit("# Page "), number, F.lit("\n\n![Page "), number, F.lit("](images/"), F.format_string("page-%04d.png", F.col("page_no")), F.lit(")"))
    return body.select(*PAGE, F.concat_ws("\n\n", head, F.nullif("body", F.lit(""))).alias("export_markdown"))


def export_html(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """HTML sections of the pages in block order, pictures as figures."""
    rows = _with_crops(blocks, crop_manifest(pages, blocks))
    label = tx.escape_html(F.lower("label"))
    words = F.replace(tx.escape_html(tx.strip(F.col("text"))), F.lit("\n"), F.lit("<br>"))
    ident = F.concat(F.lit(' data-block-id="'), tx.escape_html(F.col("block_id")), F.lit('"'))

    def tag(name: str, css: str) -> Column:
        return F.concat(F.lit(f'<{name} class="block {css}block-'), label, F.lit('"'), ident, F.lit(">"), words, F.lit(f"</{name}>"))

    figure = F.when(F.col("crop_name").isNotNull(), F.concat(
        F.lit('<figure class="block-image"><img src="images/'), F.col("crop_name"), F.lit('"></figure>'))).otherwise("")
    shown = (
        F.when(label.isin(*IMAGE_LABELS), figure).when(words == "", "").when(label.isin(*HEADINGS), tag("h2", ""))
        .when(label.isin(*PREFORMATTED), tag("pre", "block-structured "))
        .when(label.isin("caption", "pageheader", "pagefooter", "header", "footer"), tag("p", "block-caption ")).otherwise(tag("p", "")))
    body = rows.withColumn("shown", shown).groupBy(*PAGE).agg(F.array_join(_in_order(F.col("shown")), "").alias("body"))
    number = F.col("page_no").cast("string")
    return body.select(*PAGE, F.concat(F.lit('<section class="page" data-page="'), number, F.lit('"><h1>Page '), number, F.lit("</h1>"),
                                       F.col("body"), F.lit("</section>")).alias("export_html"))


def export_blocks_text(blocks: DataFrame) -> DataFrame:
    """A numbered listing of a page's blocks with label, box and text on one line each."""
    numbered = blocks.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq")))
    line = F.concat(F.lit("  "), F.format_string("%02d", F.col("n")), F.lit(". "), F.col("label"), F.lit(" bbox="), Box.named().text(),
                    F.lit(" "), F.replace(tx.strip(F.col("text")), F.lit("\n"), F.lit(" ")))
    listed = numbered.withColumn("line", line).groupBy(*PAGE).agg(F.array_join(_in_order(F.col("line")), "\n").alias("body"))
    return listed.select(*PAGE, F.concat(F.lit("Page "), F.col("page_no"), F.lit("\n"), F.col("body")).alias("blocks_text"))


def segment_document(blocks: DataFrame, articles: DataFrame) -> DataFrame:
    """Per document: pages, articles and full text."""
    texts = page_text(blocks)
    pages = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    counted = articles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_articles"))
    return pages.join(document_text(texts), "doc_id").join(counted, "doc_id", "left").na.fill(0, ["total_articles"])


def batch_run(collections: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of an operation for every member of each collection, and the runs' outcome.

    ``results`` is ``(file_id, result)``; a member without a result is a failed row.
    """
    members = collections.select("collection_id", F.explode("file_ids").alias("file_id"))
    rows = members.join(results, "file_id", "left")
    ok = F.col("result").isNotNull()
    rows = rows.select("collection_id", "file_id", F.when(ok, "complete").otherwise("failed").alias("status"), "result",
                       F.when(~ok, F.concat(F.lit("file not found: "), F.col("file_id"))).alias("error"))
    runs = rows.groupBy("collection_id").agg(
        F.count_if(F.col("status") == "complete").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failure_count"))
    return rows, runs.withColumn("status", F.when(F.col("failure_count") > 0, "completed_with_errors").otherwise("completed"))
