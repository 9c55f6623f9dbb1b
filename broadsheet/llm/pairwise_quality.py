"""Quality classifier (5): Bradley-Terry ranking of documents by pairs.

A document's strength is a weighted sum of features of its text: shares of symbols, capitals, digits, marks and stop words,
how often words and lines repeat, lengths. The weights are learned from preference pairs, a document of label 1 over one of
label 0, by logistic loss on the difference of their features. Strength is then cut at the quantile of the learned
documents' strengths that best tells the labels apart, and mapped to 0..1 so that the cut is at CUT.

Every labelled document that is not held out is learned from. Features are one Spark projection; the documents of both classes are
dealt by hash into blocks, in which each one of the larger class meets OPPONENTS of the smaller, whose documents play in several blocks
where they are few. A step of Newton's method is a pass over the blocks, of which each task sends one sum to the driver; the cut comes
from counts of all strengths in BINS bins. Null and empty texts have the features of no words and get a score as well. Repeated rows are scored each on its
own, other columns are not read. Without labelled texts of both classes nothing can be told apart and every score is CUT. An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.classifiers import known_labels
from broadsheet.llm.common import BLANK, BLANKS, held_out, let, stored, table, words_of
from broadsheet.llm.quality_rules import STOP_WORDS

OPPONENTS = 16
#: Documents of the larger class that play in one block, opponents it has at least on average, and bins that strengths are counted in.
BLOCK, RIVALS, BINS = 256, 64, 1 << 16
CUT = 0.7
RIDGE = 1e-3


def features(text: Column) -> Column:
    """An array of doubles, the same length for every text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(text, BLANKS, "")).cast("double")
    share = lambda part, whole: F.log1p(F.lit(100.0) * part / F.greatest(whole, F.lit(1.0)))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    among = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANK.replace("[", "[^")))
    bare = lambda x: F.lower(F.rtrim(x, F.lit(".,;:")))

    def of(w: Column, s: Column) -> Column:
        n, m = F.size(w).cast("double"), F.size(s).cast("double")
        repeats = F.size(F.filter(w, lambda x, i: F.get(w, i - 1).eqNullSafe(x)))
        return F.array(
            F.log1p(n), F.log1p(m), share(among("#*$%&<>@^~="), n), share(among("!"), n), share(among("|"), n), share(among(".,;:?"), n),
            share(without(r"\p{Lu}+"), chars), share(without(r"\p{N}+"), chars), F.log1p(chars / F.greatest(n, F.lit(1.0))),
            share(F.size(F.array_distinct(w)), n), share(repeats, n), share(F.size(F.filter(w, lambda x: bare(x).isin(STOP_WORDS))), n),
            share(m - F.size(F.array_distinct(s)), m), (n > 0).cast("double"))

    return let(words_of(text), lambda w: let(lines, lambda s: of(w, s)))


def dealt(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Blocks of ``rows`` (y, x, h): arrays of about BLOCK documents of the larger class and RIVALS or more of the smaller."""
    few = 0 if counts[0] <= counts[1] else 1
    blocks = -(-counts[1 - few] // BLOCK)
    copies = min(blocks, -(-RIVALS * blocks // counts[few]))
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == few, copies - 1).otherwise(0)))
    return rows.withColumn("turn", turn).groupBy(F.pmod(F.col("h") + F.col("turn"), F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("h", "y", "x"))).alias("rows")).select("block", "rows.y", "rows.x")


def pair_sums(w: np.ndarray, few: int, opponents: int = OPPONENTS):
    """Function for mapInArrow: slope and curve of the logistic loss of the blocks' pairs, and their number, summed over the task."""
    def run(batches):
        n = len(w)
        slope, curve, pairs = np.zeros(n), np.zeros((n, n)), 0
        for batch in batches:
            ys, xs = batch.column("y"), batch.column("x")
            for i in range(len(batch)):
                y, x = ys[i].values.to_numpy(zero_copy_only=False), xs[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                mine, other = x[y != few], x[y == few]
                if not len(mine) or not len(other):
                    continue
                met = other[np.random.default_rng(7).integers(0, len(other), len(mine) * opponents)]
                d = (np.repeat(mine, opponents, 0) - met) * (1 if few == 0 else -1)
                q = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                slope += d.T @ q
                curve += (d * (q * (1 - q))[:, None]).T @ d
                pairs += len(d)
        yield pa.RecordBatch.from_pydict({"pairs": [pairs], "slope": [slope.tolist()], "curve": [curve.ravel().tolist()]})

    return run


def fit(rows: DataFrame, counts: dict[int, int], ridge: float = RIDGE, steps: int = 30) -> list[float]:
    """Weights from all ``rows`` (y, x, h): strength is the sum of x times weights."""
    width = len(rows.first().x)
    spread = np.maximum(rows.agg(*[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]).first(), 1e-6)
    blocks = stored(dealt(rows, counts), "pairs")
    few = 0 if counts[0] <= counts[1] else 1
    w = np.zeros(width)
    for _ in range(steps):  # Newton's method on the mean logistic loss of the differences, over features of spread 1
        found = blocks.mapInArrow(pair_sums(w / spread, few), "pairs long, slope array<double>, curve array<double>").collect()
        pairs = max(sum(r.pairs for r in found), 1)
        slope = ridge * w - sum(np.array(r.slope) for r in found) / spread / pairs
        curve = sum(np.array(r.curve).reshape(width, width) for r in found) / np.outer(spread, spread) / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return (w / spread).tolist()


def strength(x: Column, weights: list[float]) -> Column:
    terms = F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def best_cut(rows: DataFrame, weights: list[float]) -> float:
    """The quantile of the strengths of all ``rows`` from which on label 1 is likelier: the one with most of both labels on their side."""
    strengths = rows.select("y", strength(F.col("x"), weights).alias("s"))
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    if not high > low:
        return low
    size = (high - low) / BINS
    binned = strengths.groupBy(F.least(F.floor((F.col("s") - low) / size), F.lit(BINS - 1)).alias("bin")).agg(
        F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")).orderBy("bin").collect()
    at, good, bad = (np.array([r[k] for r in binned], dtype=float) for k in ("bin", "good", "bad"))
    below_good, below_bad = np.cumsum(good) - good, np.cumsum(bad) - bad
    # A cut in front of a bin lies halfway to the one before.
    cuts = low + size * np.concatenate([at[:1], (at[:-1] + 1 + at[1:]) / 2])
    right = below_bad / bad.sum() - below_good / good.sum()
    steps = np.searchsorted(np.cumsum(good + bad), np.linspace(0, 1, 401)[1:-1] * (good.sum() + bad.sum()))
    steps = np.unique(np.concatenate([steps, np.minimum(steps + 1, len(at) - 1)]))
    best = steps[np.isclose(right[steps], right[steps].max())]
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def learn(features_of: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[list[float], float] | None:
    """(weights, cut) from the labelled documents among ``features_of`` (doc_id, x); None if they are not of both classes."""
    known = known_labels(labels, label)
    rows = stored(features_of.join(known, "doc_id").select("y", "x", F.xxhash64("doc_id", "x").alias("h")), "learned")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    weights = fit(rows, counts)
    return weights, best_cut(rows, weights)


def scored(x: Column, model: tuple[list[float], float] | None) -> Column:
    if model is None:
        return F.lit(CUT)
    weights, cut = model
    return 1 / (1 + F.exp(-((strength(x, weights) - cut) + math.log(CUT / (1 - CUT)))))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", out: str = "score", learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with the score column; its columns other than doc_id and text are passed on unread.

    ``learn_from``: where the labelled texts are, if ``docs`` has lost some of them to an earlier filter.
    """
    # Labels meet texts before the features, so that only labelled texts get them; ids alone decide.
    texts = (docs if learn_from is None else learn_from).select("doc_id", "text")
    wanted = texts.join(known_labels(labels, label).select("doc_id"), "doc_id", "left_semi")
    model = learn(wanted.select("doc_id", features(F.col("text")).alias("x")), labels, label)
    return docs.withColumn(out, scored(features(F.col("text")), model))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    x = stored(docs.select("doc_id", features(F.col("text")).alias("x")), "features")
    rated = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("x"), learn(x, table(spark, sf_dir, "labels"))).alias("score"))
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_pairwise_quality": op5_pairwise_quality}
