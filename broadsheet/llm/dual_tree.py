r"""Ranked lexical search (12): exact top-k by a dual-tree search over items and documents.

1. Postings: one scan hashes each document's terms and keeps those that some item has, with their counts; document frequencies,
   the number of documents and their length are sums over tasks.
2. Trees: items stand in a tree, neighbours sharing frequent terms; each task puts its documents, a block at a time, into trees of
   their own, ordered by the item node they resemble most and how much. A node holds, per term, the largest weight
   (items) or the largest contribution (documents) below it.
3. Bounds: the product of two nodes' maxima is at least the score of every pair below them. A pair of nodes goes on only if it
   reaches the weakest kth score of its items; otherwise the whole batch is left out. Pairs of one item and one
   document are exact, in integers.
4. kth scores: first from SEED of the documents, by hash, which every item's true kth score is at least; then each task's own, as it
   goes on. All documents are searched either way. Each task's best k per item meet in one window.

Items are taken in groups of about ITEMS items and TERMS terms (by hash), so what is sent to tasks does not grow with the tables; a group is
one pass over the documents. Terms are compared as 64-bit hashes.

Null and empty texts have no terms: such documents count in nothing, such items find nothing. Very long texts are hashed in one piece;
at most TERMS or so of their terms go on. Ties go to the smaller doc_id, null ids last. Repeated documents count and
rank each on its own; rows that share an item_id, null too, are one item. Other columns are ignored; an empty table gives no rows.
Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored, table
from broadsheet.llm.wordhash import slices, word_hashes

ITEMS, TERMS = 2048, 32_768
BLOCK, ENTRIES = 4096, 2_000_000
FAN = 4
SEED = 16


def term_separators() -> np.ndarray:
    """Bytes between terms: ASCII but letters and digits."""
    mask = np.zeros(256, bool)
    mask[:0x30] = mask[0x3A:0x41] = mask[0x5B:0x61] = mask[0x7B:0x80] = True
    return mask


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms (hashes) of ``items`` (item_id, text)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        separators = term_separators()
        for b in batches:
            for first, blob, offsets in slices(b.column(1)):
                words, row = word_hashes(blob, offsets, separators)
                cuts = np.searchsorted(row, np.arange(1, len(offsets) - 1))
                found = [np.unique(part).view(np.int64) for part in np.split(words, cuts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(found)), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"])

    given = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = given.mapInArrow(run, "item_id long, terms array<long>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms in all), and the places in the sorted ``vocabulary`` and counts (int32) of the terms found there."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        separators, size = term_separators(), len(vocabulary)
        for b in batches:
            for first, blob, offsets in slices(b.column(1)):
                rows = len(offsets) - 1
                words, row = word_hashes(blob, offsets, separators)
                place = np.minimum(np.searchsorted(vocabulary, words), size - 1)
                hit = vocabulary[place] == words
                key, times = np.unique(row[hit] * size + place[hit], return_counts=True)
                cuts = np.searchsorted(key, np.arange(rows + 1) * size) * 4
                places, times = (key % size).astype("<i4").tobytes(), times.astype("<i4").tobytes()
                parts = [pa.array([raw[a:z] for a, z in zip(cuts[:-1], cuts[1:])], pa.binary()) for raw in (places, times)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(np.bincount(row, minlength=rows)), *parts],
                                                 ["doc_id", "n", "places", "times"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, places binary, times binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["place", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("places").mapInArrow(run, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():  # a row per term
        out[r.place] = r.df
    return out


class Rows:
    """Sparse rows: row r holds terms[bounds[r]:bounds[r + 1]] and their values."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.bounds, self.terms, self.values = bounds, terms, values

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def entries(self, rows: np.ndarray):
        """(place among ``rows``, term, value) of the entries of ``rows``."""
        n = self.bounds[rows + 1] - self.bounds[rows]
        at = np.repeat(self.bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.terms[at], self.values[at]

    def times(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The products of ``rows`` with a vector over all terms; whole numbers below 2**53 stay exact."""
        owner, term, value = self.entries(rows)
        return np.bincount(owner, weights=weights[term] * value, minlength=len(rows))

    def parents(self, fan: int) -> Rows:
        """Each run of ``fan`` rows as one row of the largest values."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.bounds)) // fan
        order = np.lexsort((self.terms, owner))
        owner, terms, values = owner[order], self.terms[order], self.values[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1]))) if len(owner) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(values, first) if len(first) else values
        return Rows(np.searchsorted(owner[first], np.arange(-(-len(self) // fan) + 1)), terms[first], best)

    def tree(self, fan: int) -> list[Rows]:
        levels = [self]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].parents(fan))
        return levels


class Search:
    """One task's search: the items' tree, their best k so far, and the blocks of documents that are shown to it."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, df: np.ndarray, n_docs: int, length: int, k: int, least: np.ndarray, fan: int = FAN):
        rank = np.argsort(np.argsort(-df, kind="stable"), kind="stable")
        self.order = np.array(sorted(range(len(items)), key=lambda i: np.sort(rank[items[i]]).tolist()))
        held = [items[i] for i in self.order]
        bounds = np.cumsum([0, *(len(h) for h in held)])
        terms = np.concatenate(held)
        self.tree = Rows(bounds, terms, weights[terms].astype(float)).tree(fan)
        self.size, self.n_docs, self.length, self.k, self.fan = len(weights), n_docs, length, k, fan
        self.least = np.maximum(least[self.order], 1)  # the kth scores, once k are known; a score counts above 0
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items)
        self.exact = self.pairs = 0

    def contributions(self, n: np.ndarray, times: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A term's part of the score beside its weight, for the entries of documents of ``n`` terms."""
        if 50 * self.n_docs * int(n.max(initial=0)) >= 1 << 63:
            n = n.astype(object)
        m = (50 + 50 * n * self.n_docs // self.length).astype(np.int64)
        times = times.astype(np.int64)
        return 1_000_000_000 * times // (1000 * times + 20 * np.repeat(m, counts))

    def weights_of(self, level: int, node: int) -> np.ndarray:
        rows, out = self.tree[level], np.zeros(self.size)
        mine = slice(rows.bounds[node], rows.bounds[node + 1])
        out[rows.terms[mine]] = rows.values[mine]
        return out

    def arranged(self, docs: Rows) -> np.ndarray:
        """An order of the documents: by the item node one above the leaves that they resemble most, then by how much."""
        level, every = min(1, len(self.tree) - 1), np.arange(len(docs))
        near, most = np.zeros(len(docs), np.int64), np.full(len(docs), -1.0)
        for node in range(len(self.tree[level])):
            product = docs.times(every, self.weights_of(level, node))
            better = product > most
            near[better], most[better] = node, product[better]
        return np.lexsort((-most, near))

    def show(self, ids: np.ndarray, unnamed: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """A block of documents: ids, which have none, numbers of terms, and their entries (``counts`` of them each)."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        docs = Rows(bounds, terms, self.contributions(n, times, counts).astype(float))
        order = self.arranged(docs)
        owner, terms, values = docs.entries(order)
        tree = Rows(np.searchsorted(owner, np.arange(len(order) + 1)), terms, values).tree(self.fan)
        ids, unnamed = ids[order], unnamed[order]
        self.pairs += len(ids) * len(self.order)
        self.descend(tree, len(self.tree) - 1, 0, len(tree) - 1, np.zeros(1, np.int64), ids, unnamed)

    def descend(self, tree: list[Rows], level: int, node: int, below: int, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """Item node ``node`` of ``level`` against the document nodes ``rows`` of level ``below``."""
        if level == 0 and below == 0:
            self.exact += len(rows)
            self.take(node, ids[rows], unnamed[rows], tree[0].times(rows, self.weights_of(0, node)).astype(np.int64))
            return
        span = self.fan ** level
        weakest = self.least[node * span:(node + 1) * span].min()
        rows = rows[tree[below].times(rows, self.weights_of(level, node)) >= weakest]
        if not len(rows):
            return
        # The larger side goes down one level; documents to their leaves before items do.
        if below > 0 and (below >= level or level == 0):
            rows = (rows[:, None] * self.fan + np.arange(self.fan)).ravel()
            self.descend(tree, level, node, below - 1, rows[rows < len(tree[below - 1])], ids, unnamed)
        else:
            for child in range(node * self.fan, min((node + 1) * self.fan, len(self.tree[level - 1]))):
                self.descend(tree, level - 1, child, below, rows, ids, unnamed)

    def take(self, item: int, ids: np.ndarray, unnamed: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least[item]
        if not some.any():
            return
        scores, ids, unnamed = (np.concatenate([old, new[some]]) for old, new in zip(self.best[item], (scores, ids, unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[:self.k]
        self.best[item] = scores[order], ids[order], unnamed[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])

    def results(self):
        """(item, score, id, unnamed) of the best of every item, as columns."""
        item = np.repeat(self.order, [len(b[0]) for b in self.best])
        return item, *(np.concatenate(part) for part in zip(*self.best))


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, group_items: int = ITEMS, group_terms: int = TERMS, block: int = BLOCK, fan: int = FAN,
           seed: int = SEED) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "items")
    size = wanted.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    groups = max(1, -(-size.items // group_items), -(-(size.terms or 0) // group_terms))
    found = [_group(docs, wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect(), k, block, fan, seed)  # about TERMS terms
             for g in range(groups)]
    found = [f for f in found if f is not None] or [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    best = found[0]
    for f in found[1:]:
        best = best.union(f)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _group(docs: DataFrame, rows: list, k: int, block: int, fan: int, seed: int) -> DataFrame | None:
    """Candidates for one group of items: item_id, doc_id, score."""
    if not rows:
        return None
    item_ids = [r.item_id for r in rows]
    terms = [np.array(r.terms, np.int64).view(np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(terms))
    held = [np.searchsorted(vocabulary, t) for t in terms]
    found = stored(postings(docs, vocabulary), "postings")
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    if not total.docs:
        return None
    n_docs, length = total.docs, total.length
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()])

    def search(part: DataFrame, least: np.ndarray) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            task = Search(held, weights, df, n_docs, length, k, least, fan)
            waiting, rows, entries = [], 0, 0

            def show() -> None:
                ids, places = (pa.chunked_array([w.column(c) for w in waiting]) for c in ("doc_id", "places"))
                raw = [b"".join(b for w in waiting for b in w.column(c).to_pylist()) for c in ("places", "times")]
                counts = np.array([len(p) // 4 for p in places.to_pylist()])
                n = np.concatenate([w.column("n").to_numpy() for w in waiting])
                task.show(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), n, counts, *(np.frombuffer(r, "<i4") for r in raw))

            for b in batches:
                at = 0
                while at < len(b):
                    piece = b.slice(at, block - rows)
                    at += len(piece)
                    waiting.append(piece)
                    rows, entries = rows + len(piece), entries + piece.column("places").nbytes // 4
                    if rows >= block or entries >= ENTRIES:
                        show()
                        waiting, rows, entries = [], 0, 0
            if rows:
                show()
            item, score, ids, unnamed = task.results()
            names = pa.array([item_ids[i] for i in item.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), names, pa.array(ids, mask=unnamed), pa.array(score)],
                                             ["item", "item_id", "doc_id", "score"])

        return part.mapInArrow(run, "item int, item_id long, doc_id long, score long")

    some = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seed)) == 0)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = np.zeros(len(rows), np.int64)
    for r in search(some, least).withColumn("place", place).filter(F.col("place") == k).collect():  # a row per item of the group
        least[r.item] = r.score
    return search(found, least).select("item_id", "doc_id", "score")


def op12_dual_tree_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_dual_tree_ranking": op12_dual_tree_ranking}
ORACLES = {"op12_dual_tree_ranking": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS length FROM d),
e AS (SELECT r, unnest(terms) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
p AS (
  SELECT r, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(terms) * n_docs) // length)) AS part FROM f JOIN d USING (r), c),
s AS (SELECT item_id, r, sum(w * part)::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, r),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""}
