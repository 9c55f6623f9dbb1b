r"""Exact dedup (13) by content-defined chunk recipes, in DataFrame functions only.

1. Chunks: the text without blanks is cut where a sentence seems to start (punctuation, then a capital or a letter without case), at
   the first such place at least LEAST characters after the last cut; a run of MOST characters without one is cut there. Cuts depend on
   the text alone, so copies are cut alike; after an edit cuts meet again within some chunks, which saves moves but decides nothing.
2. Identifiers: a chunk's identifier is 128 bits of hash. (identifier, chunk) pairs are made distinct, which moves each chunk
   once per scan task however often it occurs, and no identifier may then stand for two texts. If one does, all
   identifiers are drawn again under another salt, so equal identifiers mean equal chunks, without trust in the hash.
3. Recipes: a document is its ordered list of identifiers, some 16 bytes for LEAST characters and more. Documents are equal when
   their lists are; whole lists are compared, long texts are not moved again.
4. Groups: counted per list and scan task first, then per list; the result goes back to the tasks' shares of a group, so
   a group of a third of all rows is never one task's work.

Null texts count as empty; texts of blanks only equal them: the empty recipe. Very long texts are cut by one linear match. Of equal
texts, the most code points and then the smallest doc_id stay, null ids last; of rows alike in both, the one first in
the stored table. Repeated rows are documents of their own, so one of them stays. Other columns are ignored, and an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import BLANKS, stored, table

LEAST = 256
MOST = 1024


def without_blanks(text: Column) -> Column:
    """``text`` without the six ASCII blanks; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """``text`` cut into chunks, which give it again when joined; none for the empty text."""
    pattern = rf"(?s).{{{least - 1},{most - 1}}}?\p{{P}}(?=[\p{{Lu}}\p{{Lo}}])|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hash_pair(chunk: Column, salt: int) -> Column:
    """Two 64-bit hashes of a chunk under a salt."""
    return F.array(F.xxhash64(F.lit(2 * salt), chunk), F.xxhash64(F.lit(2 * salt + 1), chunk))


def chunk_store(docs: DataFrame, salt: int = 0, identify: Callable[[Column, int], Column] = hash_pair) -> DataFrame:
    """(id, chunk): every chunk of ``docs`` once."""
    found = docs.select(F.explode(chunks(without_blanks(F.col("text")))).alias("chunk"))
    return found.select(identify(F.col("chunk"), salt).alias("id"), "chunk").distinct()


def verified_salt(docs: DataFrame, identify: Callable[[Column, int], Column] = hash_pair) -> int:
    """The first salt under which no identifier stands for two chunks."""
    salt = 0
    while not chunk_store(docs, salt, identify).groupBy("id").count().filter("count > 1").isEmpty():
        salt += 1
    return salt


def recipes(docs: DataFrame, salt: int = 0, identify: Callable[[Column, int], Column] = hash_pair) -> DataFrame:
    """row_id, doc_id, points (code points of the text), text_sha256 (of the text without blanks) and recipe of every row."""
    text = without_blanks(F.col("text"))
    recipe = F.flatten(F.transform(chunks(text), lambda c: identify(c, salt)))
    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"),
                       F.sha2(text, 256).alias("text_sha256"), recipe.alias("recipe"))


def exact_groups(docs: DataFrame, identify: Callable[[Column, int], Column] = hash_pair) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    salt = verified_salt(docs, identify)
    rows = stored(recipes(docs, salt, identify), "recipes").withColumn("share", F.shiftright("row_id", 33))  # the task that wrote the row
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")
    shares = rows.groupBy("recipe", "share").agg(F.count("*").alias("n"), F.min(best).alias("best"))
    groups = shares.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_list("share").alias("shares"))
    verdicts = groups.select("recipe", F.explode("shares").alias("share"), "group_size", "best")
    return rows.join(verdicts, ["recipe", "share"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op13_chunk_recipes": op13_chunk_recipes}
ORACLES = {"op13_chunk_recipes": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST, r)"""}
