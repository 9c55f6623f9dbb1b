"""Toxicity (7): a factorization machine over hashed terms.

A text's terms are its lower-case runs of letters, the first PREFIXES characters of each run (so that compounds of one stem
are one term) and its pairs of neighbouring runs, each kind hashed into BUCKETS of its own, and each with how often it
stands there: a bucket that occurs n times gives one term for every step of TIMES up to n. Terms that the labelled sample
ties to the label (chi-square of at least CHI_SQUARE) are the machine's features; a pair of neighbours is judged by itself, whatever
its words do alone. It learns a weight per feature and a vector of FACTORS numbers per feature; a pair of features adds the
product of their vectors, so that a word can weigh more beside another one than the two do alone.

The machine is trained on a bounded labelled sample (PER_CLASS rows a class, weighted back to the labels' own shares); scoring is one pass
over all rows, with a model of fixed size sent along. Null and empty texts have no terms and get the base rate. Repeated
rows are scored each on its own; no other column is read. Without labels of both classes every score is the share of label
1, or 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.classifiers import training_rows
from broadsheet.llm.common import held_out, stored, table
from broadsheet.llm.wordhash import mix, non_letters, slices, word_and_prefix_hashes

BUCKETS = 1 << 20
PER_CLASS = 8_000
CHI_SQUARE = 12.0
FACTORS = 6
CUT = 0.3
#: Lengths of word beginnings, in characters.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A bucket's occurrences from which on it has a further term; ascending from 1.
TIMES = (1, 2, 4)
KINDS = 3  # words, beginnings, pairs of neighbours


def terms(texts, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, bounds) per slice of an Arrow array: row r's distinct terms, ascending, are terms[bounds[r]:bounds[r + 1]].

    ``wanted``: which of all KINDS * BUCKETS buckets count; others give no terms.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    separators, space = non_letters(), KINDS * BUCKETS
    for first, blob, offsets in slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        rows = len(offsets) - 1
        (words, row), beginnings = word_and_prefix_hashes(blob, offsets, separators, PREFIXES)
        pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]), row[:-1]
        beside = row[:-1] == row[1:]
        keys = []
        for kind, (hashes, of) in [(0, (words, row)), *((1, x) for x in beginnings), (2, tuple(x[beside] for x in pairs))]:
            bucket = kind * BUCKETS + (hashes >> np.uint64(44)).astype(np.int64) % BUCKETS
            if wanted is not None:
                hit = wanted[bucket]
                bucket, of = bucket[hit], of[hit]
            keys.append(of * space + bucket)
        keys = np.sort(np.concatenate(keys))
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        times, keys = np.diff(np.append(begin, len(keys))), keys[begin]
        found = np.sort(np.concatenate([keys[times >= n] * len(TIMES) + i for i, n in enumerate(TIMES)]))
        of, found = np.divmod(found, space * len(TIMES))
        yield first, found, np.searchsorted(of, np.arange(rows + 1))


def term_counts(chosen: DataFrame) -> DataFrame:
    """term, with_0, with_1: how many of ``chosen`` (y, text) of either label have a term."""
    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            y = b.column(0).to_numpy().astype(np.int64)
            for first, found, bounds in terms(b.column(1)):
                label = np.repeat(y[first:first + len(bounds) - 1], np.diff(bounds))
                key, n = np.unique(found * 2 + label, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key // 2).astype(np.int32)), pa.array(np.where(key % 2, 0, n)), pa.array(np.where(key % 2, n, 0))],
                                                 ["term", "with_0", "with_1"])

    parts = chosen.select("y", "text").mapInArrow(counted, "term int, with_0 long, with_1 long")
    return parts.groupBy("term").agg(F.sum("with_0").alias("with_0"), F.sum("with_1").alias("with_1"))


def select_terms(counted: DataFrame, n0: int, n1: int, least: float = CHI_SQUARE) -> np.ndarray:
    """Terms whose presence depends on the label, by Pearson's chi-square on sample counts, ascending."""
    with_0, with_1 = (F.col(c).cast("double") for c in ("with_0", "with_1"))
    n, seen = float(n0 + n1), with_0 + with_1
    off = with_1 * (n0 - with_0) - with_0 * (n1 - with_1)
    chi = n * off * off / F.greatest(n1 * float(n0) * seen * (n - seen), F.lit(1e-9))
    found = counted.filter((seen >= 2) & (chi >= least)).select("term").collect()
    return np.sort(np.array([r.term for r in found], np.int64))


class Machine:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, through the logistic function."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.bias, self.w, self.v = buckets, bias, w, v

    def features(self, found: np.ndarray, bounds: np.ndarray):
        """(feature, row) of the terms that are features."""
        at = np.minimum(np.searchsorted(self.buckets, found), max(len(self.buckets) - 1, 0))
        hit = self.buckets[at] == found if len(self.buckets) else np.zeros(len(found), bool)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return at[hit], row[hit]

    def margin(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.w[feature], rows)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out


def train(buckets: np.ndarray, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, factors: int = FACTORS,
          passes: int = 60, batch: int = 512, rate: float = 0.05, ridge: float = 2e-4) -> Machine:
    """Adam on the weighted logistic loss of ``rows`` with the features ``buckets``; the seed is fixed, so one sample gives one machine."""
    base = float((weight * y).sum() / weight.sum())
    rng = np.random.default_rng(11)
    m = Machine(buckets, float(np.log(base / (1 - base))), np.zeros(len(buckets)), rng.normal(0, 0.02, (len(buckets), factors)))
    if not len(buckets):
        return m
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    feature, row = m.features(np.concatenate(rows), bounds)
    start = np.searchsorted(row, np.arange(len(rows) + 1))
    state = [np.zeros_like(a) for a in (m.w, m.w, m.v, m.v)]
    bias_state, t = [0.0, 0.0], 0
    for _ in range(passes):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            size = start[part + 1] - start[part]
            local = np.repeat(np.arange(len(part)), size)
            at = np.repeat(start[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            f = feature[at]
            p = 1 / (1 + np.exp(-np.clip(m.margin(f, local, len(part)), -30, 30)))
            g = weight[part] * (p - y[part]) / weight[part].sum()
            g_w = np.bincount(f, g[local], len(buckets)) + ridge * m.w
            g_v = ridge * m.v
            for k in range(factors):
                x = m.v[f, k]
                total = np.bincount(local, x, len(part))
                g_v[:, k] += np.bincount(f, g[local] * (total[local] - x), len(buckets))
            t += 1
            fade = rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
            for i, (value, slope) in enumerate(((m.w, g_w), (m.v, g_v))):
                a, b = state[2 * i], state[2 * i + 1]
                a += 0.1 * (slope - a)
                b += 0.001 * (slope * slope - b)
                value -= fade * a / (np.sqrt(b) + 1e-8)
            bias_state[0] += 0.1 * (g.sum() - bias_state[0])
            bias_state[1] += 0.001 * (g.sum() ** 2 - bias_state[1])
            m.bias -= fade * bias_state[0] / (bias_state[1] ** 0.5 + 1e-8)
    return m


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample, counts = training_rows(labels, label, per_class)
    if not (counts.get(0) and counts.get(1)):
        return docs.select("doc_id", F.lit(1.0 if counts.get(1) else 0.0).alias("score"))

    sample = stored(sample, "sample")
    chosen = docs.join(F.broadcast(sample), "doc_id")
    n = {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return docs.select("doc_id", F.lit(float(max(n, default=0))).alias("score"))
    buckets = select_terms(term_counts(chosen), n[0], n[1])
    wanted = np.zeros(KINDS * BUCKETS, bool)
    wanted[buckets // len(TIMES)] = True
    packed = np.packbits(wanted)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mask = np.unpackbits(packed).astype(bool)
        for b in batches:
            for first, found, bounds in terms(b.column(1), mask):
                parts = [found[a:z].astype("<i4").tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(parts)), pa.array(parts, pa.binary())], ["y", "terms"])

    # At most 2 * per_class rows of two numbers: the broadcast has a fixed bound, and so has what the driver learns from: a row has
    # only terms of buckets that were selected.
    chosen = chosen.select("y", "text").mapInArrow(hashed, "y int, terms binary").collect()
    chosen.sort(key=lambda r: (r.y, bytes(r.terms)))  # rows arrive in any order; the machine must not depend on it
    y = np.array([r.y for r in chosen])
    share = {k: counts[k] / n[k] for k in (0, 1)}
    machine = train(buckets, [np.frombuffer(r.terms, "<i4").astype(np.int64) for r in chosen], y, np.where(y == 1, share[1], share[0]))

    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mask = np.unpackbits(packed).astype(bool)
        for b in batches:
            for first, found, bounds in terms(b.column(1), mask):
                rows = len(bounds) - 1
                margin = machine.margin(*machine.features(found, bounds), rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))], ["doc_id", "score"])

    return docs.mapInArrow(scored, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
