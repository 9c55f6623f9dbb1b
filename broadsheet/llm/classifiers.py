"""Labels for the classifiers, never from held-out rows, and bounded samples of them chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import held_out


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled documents that may be learned from.

    Held-out rows, null ids and null labels never count; an id with labels that differ has the largest one.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training_rows(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most ``per_class`` of the ``known_labels`` of each class, and how many there are of each."""
    known = known_labels(labels, label)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1]), counts
