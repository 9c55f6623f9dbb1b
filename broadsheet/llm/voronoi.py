"""Exact top-k search (6): a Voronoi kNN join on inner products of integer vectors.

1. Pivots: a bounded sample of vectors, by hash of their values. Every row goes to the cell of its nearest pivot.
2. Summaries: per cell the number of vectors, the range of their products with the unit pivot, the largest norm of what
   is left, and bounds on the best members' own products. They number PIVOTS rows, whatever the table.
3. Bounds: for a query q and a cell, with q = a p + q' and x = b p + x' (p the unit pivot), a b - |q'||x'| <= q.x <= a b + |q'||x'|.
   The lower bounds of all cells, counted with their members, give a score that k others surely reach; cells whose upper
   bound stays below it are skipped, the query is sent to the others only.
4. Local solve: cells are cut into tiles of SLOT vectors and of as many queries as PART bytes hold. Vectors and queries
   are dealt out together by tile, a row each, and sorted so that a tile's queries come first: they are held, the vectors
   pass by in blocks, one matrix product each. A tile gives its best k per query; the best of all tiles are the result.

No task holds more than a tile's queries and a block of products, however large the table, and nothing goes through the
driver but PIVOTS rows. A vector that a third of all rows share is spread over the slots. Vectors that are null or hold
null or non-finite components take no part; shorter vectors count as padded with zeros; an empty vector scores 0. A
query never meets rows of its own id, repeated ones included; rows with one id, however many, are listed once, with
their best score.
Null ids are neither queries nor candidates. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored, table

PIVOTS = 32
BLOCK = 1024
SLOT = 16_384
PART = 32 << 20
_VECTORS = "id long, cell int, x binary"


def integers(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null if the vector can't take part."""
    whole = F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, whole)


def _matrix(arrays) -> np.ndarray:
    """Rows of 64-bit integers, padded with zeros to one width."""
    width = max((len(a) for a in arrays), default=0)
    out = np.zeros((len(arrays), width), np.int64)
    for k, a in enumerate(arrays):
        out[k, :len(a)] = a
    return out


def _packed(v) -> bytes:
    """The integers of a vector in as few bytes each as its largest needs; their number leads."""
    a = np.asarray(v, np.int64)
    low, high = (a.min(), a.max()) if len(a) else (0, 0)
    size = next(s for s in (2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
    return bytes([size]) + a.astype(f"<i{size}").tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """Rows of 64-bit integers from what ``_packed`` made, padded with zeros to one width."""
    alike = defaultdict(list)
    for i, x in enumerate(packed):
        alike[x[0], (len(x) - 1) // x[0]].append(i)
    out = np.zeros((len(packed), max((n for _, n in alike), default=0)), np.int64)
    for (size, n), at in alike.items():
        if n:
            raw = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1)[:, 1:]
            out[at, :n] = np.ascontiguousarray(raw).view(f"<i{size}")
    return out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _parts(x: np.ndarray, unit: np.ndarray):
    """Product with the unit pivot and norm of the rest, for each row of x and each unit vector."""
    x = x.astype(float)
    along = x @ unit.T
    return along, np.sqrt(np.maximum((x * x).sum(1)[:, None] - along * along, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while they fit 53 bits, in integers beyond."""
    width = max(q.shape[1], x.shape[1])
    q, x = _fit(q, width), _fit(x, width)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if top < 2 ** 52 else q @ x.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool):
    """The k best ids of one row: higher score first, then smaller id; an id that is repeated counts once."""
    if len(ids) > 4 * k and not repeated:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= edge)
        ids, scores = ids[pick], scores[pick]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if repeated:
        first = np.sort(np.unique(ids, return_index=True)[1])
        ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


class _Nearest:
    """The best k of each of a block of queries among the vectors met so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.reach = np.full(len(ids), np.iinfo(np.int64).min)  # a score that k others reach
        self.kept = (np.zeros(0, np.int64),) * 3  # places of queries, ids, scores

    def meet(self, ids: np.ndarray, x: np.ndarray, copies: int) -> None:
        """``copies``: how often an id stands in ``ids`` at most."""
        scores = _products(self.q, x)
        enough = (self.k + 1) * copies  # so many rows are of k ids beside the query's own
        new = self.reach == np.iinfo(np.int64).min
        if enough <= len(ids) and new.any():
            self.reach[new] = np.partition(scores[new], len(ids) - enough, 1)[:, len(ids) - enough]
        near = scores >= self.reach[:, None]
        parts = [self.kept]
        for i in np.flatnonzero(near.sum(1) > 8 * enough):  # many ties, or few vectors
            other = near[i] & (ids != self.ids[i])
            found, best = _best(ids[other], scores[i, other], self.k, copies > 1)
            parts.append((np.full(len(found), i), found, best))
            near[i] = False
        i, j = np.nonzero(near)
        other = ids[j] != self.ids[i]
        parts.append((i[other], ids[j[other]], scores[i[other], j[other]]))
        if any(len(p[0]) for p in parts[1:]):
            self._settle(*map(np.concatenate, zip(*parts)))

    def _settle(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((~scores, ids, at))  # an id's best row first
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]
        at, ids, scores = at[first], ids[first], scores[first]
        order = np.lexsort((ids, ~scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.reach[at[last]] = np.maximum(self.reach[at[last]], scores[last])
        self.kept = tuple(a[rank < self.k] for a in (at, ids, scores))


def search(vectors: DataFrame, k: int, is_query: Column, pivots: int = PIVOTS, block: int = BLOCK, slot: int = SLOT, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score of ``vectors`` (id, v: array of long); ``is_query`` marks the queries by id."""
    valid = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v")
    # Hashes alone are shuffled; vectors with the least of them are few.
    hashed = valid.select("v", F.xxhash64("v").alias("h"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(pivots).collect()]
    sample = hashed.filter(F.col("h").isin(least)).distinct().orderBy("h", "v").limit(pivots).collect() if least else []
    if not sample:
        return valid.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    centres = _matrix([r.v for r in sample]).astype(float)
    norms = np.sqrt((centres * centres).sum(1))
    unit = np.divide(centres, norms[:, None], out=np.zeros_like(centres), where=norms[:, None] > 0)

    def cells(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            x = _fit(_matrix(list(b["v"])), centres.shape[1]).astype(float)
            away = (centres * centres).sum(1)[None] - 2 * (x @ centres.T)
            yield pd.DataFrame({"id": b["id"], "cell": away.argmin(1).astype(np.int32), "x": [_packed(v) for v in b["v"]]})

    placed = stored(valid.mapInPandas(cells, _VECTORS), "voronoi")
    low = k + 1  # one more than asked for: a query's own row may be among them

    def summarise(batches: Iterator) -> Iterator:
        import pandas as pd

        kept: dict[int, list] = {}
        for b in batches:
            for cell, rows in b.groupby("cell"):
                whole = _unpacked(list(rows["x"]))
                x, full = _fit(whole, unit.shape[1]), np.square(whole.astype(float)).sum(1)
                along = x.astype(float) @ unit[cell]
                rest = np.sqrt(np.maximum(full - along * along, 0))
                s = kept.setdefault(int(cell), [0, np.inf, -np.inf, 0.0, np.zeros(0, np.int64), np.zeros((0, 2)), 0])
                s[6] = max(s[6], whole.shape[1])
                s[0], s[1], s[2], s[3] = s[0] + len(x), min(s[1], along.min()), max(s[2], along.max()), max(s[3], rest.max())
                ids, near = np.concatenate([s[4], rows["id"].to_numpy(np.int64)]), np.concatenate([s[5], np.stack([along, rest], 1)])
                by_key = np.argsort(near[:, 1] - near[:, 0], kind="stable")
                best = by_key[np.sort(np.unique(ids[by_key], return_index=True)[1])[:low]]  # an id once, by its best row
                s[4], s[5] = ids[best], near[best]
        for cell, (n, a, z, r, ids, near, width) in kept.items():
            yield pd.DataFrame([{"cell": cell, "n": n, "width": width, "least": a, "most": z, "rest": r, "ids": ids.tolist(),
                                 "along": near[:, 0].tolist(), "left": near[:, 1].tolist()}])

    partial = stored(placed.mapInPandas(
        summarise, "cell int, n long, width long, least double, most double, rest double, ids array<long>, along array<double>, left array<double>"), "voronoi-cells")
    summary = {r.cell: r for r in partial.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("width").alias("width"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("rest").alias("rest")).collect()}  # a row per pivot
    members = partial.select("cell", F.explode(F.arrays_zip("ids", "along", "left")).alias("e")).select(
        "cell", F.col("e.ids").alias("id"), F.struct((F.col("e.left") - F.col("e.along")).alias("key"), "e.along", "e.left").alias("e"))
    best_first = F.row_number().over(Window.partitionBy("cell").orderBy("e.key", "id"))
    members = members.groupBy("cell", "id").agg(F.min("e").alias("e")).withColumn("place", best_first).filter(F.col("place") <= low)
    known: dict[int, list] = {}
    for r in members.select("cell", "id", "e.along", "e.left").collect():  # at most ``low`` rows per pivot
        known.setdefault(r.cell, []).append((r.id, r.along, r.left))
    copies = max(Counter(i for rows in known.values() for i, _, _ in rows).values())
    order = sorted(summary)
    asked = placed.filter(is_query)
    held = max(block, part // (8 * max(1, max(r.width for r in summary.values()))))  # queries of a tile
    number = asked.count()
    parts = max(1, -(-number // held))
    slot = max(slot, min(held, number))  # tiles about as wide as high: neither side is sent much oftener than the other
    slots = [-(-summary[c].n // slot) if c in summary else 1 for c in range(len(unit))]

    def bounds(batches: Iterator) -> Iterator:
        import pandas as pd

        u = unit[order]
        least, most, rest = (np.array([getattr(summary[c], f) for c in order]) for f in ("least", "most", "rest"))
        near = [np.array([e[1:] for e in known[c]]) for c in order]
        enough = k * copies + 1  # so many members are of k ids beside the query's own, if an id stands in several cells too
        for b in batches:
            raw, cells = list(b["x"]), []
            for at in range(0, len(b), block):
                whole = _unpacked(raw[at:at + block])
                q, full = _fit(whole, unit.shape[1]), np.square(whole.astype(float)).sum(1)
                along = q.astype(float) @ u.T
                left = np.sqrt(np.maximum(full[:, None] - along * along, 0))
                lower = np.concatenate([along[:, [j]] * e[:, 0] - left[:, [j]] * e[:, 1] for j, e in enumerate(near)], 1)
                sure = np.sort(lower, 1)[:, -enough] if lower.shape[1] >= enough else np.full(len(q), -np.inf)
                upper = np.maximum(along * least, along * most) + left * rest
                slack = 1e-9 * (np.abs(sure)[:, None] + np.abs(upper)) + 1e-6
                cells += [np.asarray(order)[need].tolist() for need in upper + slack >= sure[:, None]]
            yield pd.DataFrame({"id": b["id"], "x": b["x"], "cells": cells})

    def solve(batches: Iterator) -> Iterator:
        """Rows sorted by tile, a tile's queries first."""
        import pandas as pd

        tile, ids, xs, blocks = None, [], [], []

        def found():
            out = [(n.ids[n.kept[0]], *n.kept[1:]) for n in blocks]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

        for b in batches:
            keys = b[["cell", "slot", "part", "is_vector"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for start, end in zip(starts, [*starts[1:], len(b)]):
                *at, is_vector = keys[start].tolist()
                if at != tile:
                    if blocks:
                        yield found()
                    tile, ids, xs, blocks = at, [], [], []
                some, packed = b["id"].to_numpy()[start:end], list(b["x"].iloc[start:end])
                if not is_vector:
                    ids.append(some)
                    xs += packed
                elif ids or blocks:
                    if ids:
                        every, q = np.concatenate(ids), _unpacked(xs)
                        blocks, ids, xs = [_Nearest(every[i:i + block], q[i:i + block], k) for i in range(0, len(q), block)], [], []
                    for i in range(0, len(some), block):
                        x, own = _unpacked(packed[i:i + block]), some[i:i + block]
                        most = int(np.unique(own, return_counts=True)[1].max())
                        for n in blocks:
                            n.meet(own, x, most)
        if blocks:
            yield found()

    def spread(name: str, number: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), number - 1)).alias(name)

    slots_of = F.element_at(F.array(*map(F.lit, slots)), F.col("cell") + 1)
    place = F.xxhash64("id", "x")
    queries = asked.dropDuplicates(["id", "x"]).mapInPandas(bounds, "id long, x binary, cells array<int>").select("id", "x", F.explode("cells").alias("cell"))
    queries = queries.select("cell", F.pmod(place, F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("is_vector"), "id", "x", spread("slot", slots_of))
    data = placed.select("cell", F.pmod(place, slots_of).cast("int").alias("slot"), F.lit(1).alias("is_vector"), "id", "x", spread("part", F.lit(parts)))
    tiles = data.unionByName(queries).repartition("cell", "slot", "part").sortWithinPartitions("cell", "slot", "part", "is_vector")
    local = tiles.mapInPandas(solve, "query_id long, vec_id long, score long")
    single = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), integers(F.col("embedding")).alias("v"))
    return search(rows, 5, F.col("id") % 50 == 0)


QUERIES = {"op6_voronoi_top_k": op6_voronoi_top_k}
ORACLES = {"op6_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""}
