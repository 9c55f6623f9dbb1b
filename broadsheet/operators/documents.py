"""Whole documents: pages with the articles found on them (D9), and operations over collections of documents (D10).

Pages stay rows until a document's value is asked for. A document's text is one value of the result, so only its texts meet in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.functions.geometry import Box
from broadsheet.operators import cluster, convert, extract

PAGE = ["doc_id", "page_no"]
OPERATIONS = ("convert_document", "segment_document", "extract_structured_data")


def segmented_pages(blocks: DataFrame) -> DataFrame:
    """One row per page: size, text, ``articles`` in reading order and the ``unassigned`` text blocks."""
    pages = cluster.cluster_pages(blocks, page_text=convert.listed_text(F.col("blocks")))
    article = F.transform("articles", lambda a, i: F.struct((i + 1).alias("article_order"), *[a[n].alias(n) for n in (
        "title", "body_text", *Box._fields, "confidence", "layout_type", "image_count", "caption_count")]))
    free = F.filter("blocks", lambda b: (b["article"] < 0) & b["textish"] & ~b["aux"] & ~b["merged"])
    unassigned = F.transform(free, lambda b: F.struct(*[b[n].alias(n) for n in ("block_id", "label", *Box._fields, "text")]))
    return pages.select(*PAGE, "width", "height", article.alias("articles"), unassigned.alias("unassigned"), "page_text")


def page_articles(pages: DataFrame) -> DataFrame:
    """The articles of ``segmented_pages`` as rows."""
    return pages.select(*PAGE, F.explode("articles").alias("a")).select(*PAGE, "a.*")


def segment_totals(pages: DataFrame) -> DataFrame:
    """Per document of ``segmented_pages``: pages, articles, unassigned blocks and the text of its pages that have some."""
    text = F.when(tx.strip(F.col("page_text")) != "", F.struct("page_no", "page_text"))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(F.size("articles")).alias("total_articles"), F.sum(F.size("unassigned")).alias("total_unassigned"),
        F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda t: t["page_text"]), "\n\n").alias("full_text"))


def convert_documents(blocks: DataFrame, formats: str | None = None, paginate: bool = False) -> DataFrame:
    """``convert`` with the articles that the clustering finds."""
    return convert.convert_marked(blocks, convert.page_markdown_of(segmented_pages(blocks)), formats, paginate)


def extract_documents(blocks: DataFrame, fields: list[dict]) -> DataFrame:
    """``extract_fields`` of whole documents: their text, and the title and text of their first article."""
    pages = segmented_pages(blocks)
    first = page_articles(pages).groupBy("doc_id").agg(F.min(F.struct("page_no", "article_order", "title", "body_text")).alias("a"))
    docs = segment_totals(pages).join(first, "doc_id", "left").select(
        "doc_id", "full_text", F.coalesce("a.title", F.lit("")).alias("article_title"), F.coalesce("a.title", F.lit("")).alias("title_block"),
        F.coalesce("a.body_text", F.lit("")).alias("article_body"))
    return extract.extract_fields(docs, fields)


def run_batch(collections: DataFrame, blocks: DataFrame, operation: str, fields: list[dict] | None = None, formats: str | None = None):
    """(rows, runs) of one operation over every member of each collection (collection_id, file_ids).

    A document in several collections is worked on once; documents in none are not. ``result`` is JSON: the formats, the totals or the
    values by field. A member without blocks is a failed row with its reason, and the run goes on.
    """
    if operation not in OPERATIONS:
        raise ValueError("operation must be one of: " + ", ".join(OPERATIONS))
    members = collections.select(F.explode("file_ids").alias("doc_id")).distinct()
    blocks = blocks.join(members, "doc_id", "left_semi")
    if operation == "convert_document":
        done = convert_documents(blocks, formats)
        results = done.select("doc_id", F.to_json(F.struct(*[c for c in done.columns if c != "doc_id"])).alias("result"))
    elif operation == "segment_document":
        done = segment_totals(segmented_pages(blocks))
        results = done.select("doc_id", F.to_json(F.struct(*[c for c in done.columns if c != "doc_id"])).alias("result"))
    else:
        values = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
        results = extract_documents(blocks, fields or []).groupBy("doc_id").agg(F.to_json(values).alias("result"))
    return convert.batch_run(collections, results.withColumnRenamed("doc_id", "file_id"))
