"""Article bundles, page manifests and Markdown as written to disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx


def bundle_path(job_key: Column, pdf_name: Column, page: Column, order: Column, title: Column) -> Column:
    """``job/pdf-slug/parsed/page_0001/article_01_slug``."""
    stem = F.regexp_replace(pdf_name, r"(?<=[^/])\.[^./]+$", "")
    return F.concat(job_key, F.lit("/"), tx.slugify(stem), F.format_string("/parsed/page_%04d/article_%02d_", page, order),
                    tx.slugify(F.substring(title, 1, 80)))


def article_record(df: DataFrame) -> Column:
    """JSON record of an article row; ``images`` and ``captions`` are arrays of structs."""
    skip = ("images", "captions")
    rest = [F.col(c) for c in df.columns if c not in skip]
    return F.to_json(F.struct(*rest, F.size("images").alias("image_count"), F.col("images"), F.size("captions").alias("caption_count"),
                              F.col("captions")))


def write_article_bundles(articles: DataFrame, root: str) -> None:
    """One JSON record per article below job, document and page folders."""
    keys = ["job_key", "pdf_slug", "page_number"]
    rows = articles.select(*keys, article_record(articles).alias("value"))
    rows.write.mode("overwrite").partitionBy(*keys).text(root)


def page_manifest(articles: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Per page its articles in order, their number and the page's grade."""
    listed = F.sort_array(F.collect_list(F.struct("article_order", "article_id", "title", "bundle_dir")))
    pages = articles.groupBy("job_key", "pdf_file", "page_number").agg(F.count(F.lit(1)).alias("article_count"), listed.alias("articles"))
    return pages if quality is None else pages.join(quality, ["job_key", "pdf_file", "page_number"], "left")


def write_page_manifest(articles: DataFrame, root: str, quality: DataFrame | None = None) -> None:
    page_manifest(articles, quality).write.mode("overwrite").partitionBy("job_key").json(root)


def article_markdown(pdf: Column, page: Column, order: Column, title: Column, body: Column, images: Column, captions: Column) -> Column:
    """Article as Markdown: title, metadata, paragraphs, then pictures with captions, else captions.

    ``images`` is ``array<struct<file_name, relative_path, captions: array<string>>>``.
    """
    head = F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")), F.lit("\n\n- PDF: "), pdf, F.lit("\n- Page: "),
                    page, F.lit("\n- Article: "), order)
    paragraphs = tx.non_empty_lines(body)

    def filled(texts: Column) -> Column:
        return F.filter(F.transform(texts, lambda c: tx.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")

    def picture(i: Column) -> Column:
        ref = F.concat(F.lit("!["), F.coalesce(i["file_name"], F.lit("image")), F.lit("]("),
                       F.replace(F.coalesce(i["relative_path"], F.lit("")), F.lit("\\"), F.lit("/")), F.lit(")"))
        lines = F.transform(filled(i["captions"]), lambda c: F.concat(F.lit("Caption: "), c))
        return F.array_join(F.concat(F.array(ref), lines), "\n")

    pictures = F.concat(F.array(F.lit("## Images")), F.transform(images, picture))
    loose = F.concat(F.array(F.lit("## Captions")), filled(captions))
    tail = F.when(F.size(images) > 0, pictures).when(F.size(captions) > 0, loose).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.concat(F.array(head), paragraphs, tail), "\n\n"), F.lit("\n"))
