"""Corpus pipeline: rules, quality classifier, near duplicates, packing. Each stage reads what the one before kept.

Rows are documents, whatever their ids: rows that repeat an id stand or fall each by its own text, and of rows with near-equal
texts one stays, the first in the stored table. Null and empty texts fail the rules, as do texts of fewer than 20 words; null ids,
languages and sources are kept as they are. Very long texts go through whole. Scores that reach the cut exactly pass. Columns other than
COLUMNS are left behind, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import near_dup, packing, pairwise_quality, quality_rules
from broadsheet.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OWN = "corpus_pipeline_verdict"


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs.select(*COLUMNS))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise quality score reaches the cut; learned from the whole table, since the rules took most bad texts."""
    scored = pairwise_quality.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), out=_OWN,
                                    learn_from=table(spark, sf_dir, "documents"))
    # A generator evaluates the score once a row; a filter would be pushed down and evaluate it several times.
    good = F.explode(F.filter(F.array(_OWN), lambda s: s >= pairwise_quality.CUT)).alias(_OWN)
    return scored.select(*COLUMNS, good).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8. Rows are told apart by numbers, not by their ids."""
    docs = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(_OWN)), "numbered")
    verdicts = near_dup.near_duplicates(docs.select(F.col(_OWN).alias("doc_id"), "text"), width=5)
    dropped = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias(_OWN))
    return docs.join(dropped, _OWN, "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, every window mixed like the whole."""
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality rules", by_rules), ("quality classifier", by_quality), ("near duplicates", without_near_copies), ("packing", packed)]

#: The classifier's weights and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
