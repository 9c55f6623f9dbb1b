"""Near duplicates (8) by bottom-k sketches from one hash function.

1. A document's shingles are hashed once; its sketch is the SKETCH smallest distinct hashes. Documents with equal shingle sets
   form a class at once; of copies in one task only the sketch of the first one that has an id goes on.
2. Inverted lists: documents of Jaccard similarity 0.8 share at least SHARED retained values (for sets that fit
   their sketch, exactly 80 % of them; for larger ones with a chance of failure below 1e-9, the tail of a binomial of mean
   0.8 * SKETCH). So two such documents share one of their m - SHARED + 1 rarest retained values, and only
   these are listed. Rarity puts passages that many documents hold last.
3. Documents that meet in lists form clusters. Each cluster is compared in tasks of bounded size; a large one is split by set
   size (partners' sizes differ by at most a quarter) and hash, and its blocks are compared pair by pair.
4. Within a task the retained values' inverted lists give overlaps, the union of two sketches an estimate; a pair that
   can still reach the threshold is compared on full sets. Pairs that are already linked through others are skipped, so a
   group of copies gives a tree of links, not all pairs.
5. Links are joined into components by large-star and small-star rounds on tables in the shared folder.

Null and empty texts have an empty set: no links, a component of their own. Texts shorter than a shingle are one shingle
of all their words. Rows that repeat an id are one document: it is linked with whatever any of its texts is linked with, so all
of them get the same component (each its own n_shingles). Very long texts are hashed whole, by one task. Rows with a null id
are not linked, have a null component and are kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import stored, table
from broadsheet.llm.wordhash import blanks, distinct_sorted, mix, shingle_hashes, slices, word_hashes

WIDTH = 4
SKETCH = 128
SHARED = 72
#: Shingles in a block of a comparison task.
BLOCK = 250_000
_SIZE_STEP = math.log(1.26)  # a little over 1 / 0.8, so partners are in the same or the next size class


def shingle_sets(texts, width: int):
    """(first row, values, bounds) per slice: row r's distinct shingle hashes, ascending, are values[bounds[r]:bounds[r + 1]]."""
    separators = blanks()
    for first, blob, offsets in slices(texts):
        rows = len(offsets) - 1
        words, row = word_hashes(blob, offsets, separators)
        yield first, *distinct_sorted(*shingle_hashes(words, row, rows, width), rows)


def sketches(docs: DataFrame, width: int = WIDTH, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), key_a and key_b (128 bits of the set), retained (k smallest; null if this task had the set before, or without an id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for b in batches:
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, values, bounds in shingle_sets(b.column(1), width):
                n = np.diff(bounds)
                some = n > 0
                keys = np.zeros((2, len(n)), np.uint64)
                if some.any():
                    keys[0, some] = np.add.reduceat(mix(values), bounds[:-1][some])
                    keys[1, some] = np.bitwise_xor.reduceat(mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), bounds[:-1][some])
                kept = []
                for r, pair in enumerate(zip(keys[0].tolist(), keys[1].tolist())):
                    if some[r] and named[first + r] and pair not in seen:  # lists() has no use for a row without an id
                        seen.add(pair)
                        kept.append(values[bounds[r]:min(bounds[r + 1], bounds[r] + k)].view(np.int64))
                    else:
                        kept.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in keys),
                     pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "n", "key_a", "key_b", "retained"])

    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n long, key_a long, key_b long, retained array<long>")


def lists(sketched: DataFrame, classes: DataFrame, k: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """v, rep, n: which classes stand in the inverted list of which retained value, for their rarest values only."""
    posts = sketched.filter(F.col("retained").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "n", F.explode("retained").alias("v"))
    # A value that only one document retains gives no list, but takes a place among its document's rarest.
    common = stored(posts.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "frequent")
    of_doc = Window.partitionBy("doc_id", "n")
    rank = F.row_number().over(of_doc.orderBy("df", "v"))
    m = F.least(F.col("n"), F.lit(k))
    # Partners of sets up to 80 % of k fit their sketch as well, so for these the bound is exact.
    least = F.when(F.col("n") <= k * 4 // 5, F.expr("(4 * n + 4) div 5")).otherwise(F.lit(shared))
    places = m - least + 1 - (m - F.count("*").over(of_doc))
    rare = posts.join(common, "v").withColumn("rank", rank).withColumn("places", places).filter("rank <= places").select("v", "doc_id", "n")
    named = sketched.filter(F.col("retained").isNotNull()).select("doc_id", "n", "key_a", "key_b").join(classes, ["key_a", "key_b"]).select("doc_id", "n", "rep")
    return rare.join(named, ["doc_id", "n"]).select("v", "rep", "n").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; the root is the smallest node of a component.

    Large-star and small-star in turn until nothing changes; every round is a stored table.
    """
    def tally(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def turned(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    edges = stored(turned(edges).distinct(), "edges")
    before = None
    while (now := tally(edges)) != before:
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = turned(large).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = stored(turned(small).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def tasks_of(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` (rep, n, cluster) with tasks: (key, side) of every comparison task that a member takes part in."""
    sized = members.withColumn("size_class", F.floor(F.log("n") / _SIZE_STEP).cast("int"))
    cells = sized.groupBy("cluster", "size_class").agg(F.sum("n").alias("n"))
    parts = F.struct(F.col("size_class"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    clusters = cells.groupBy("cluster").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(parts)).alias("parts"))
    key = lambda b, i, c, j: F.concat_ws("/", F.col("cluster").cast("string"), *(x.cast("string") for x in (b, i, c, j)))
    b = F.col("size_class")
    here = lambda c: F.coalesce(F.try_element_at("parts", c), F.lit(0))
    i = F.pmod(F.xxhash64("rep"), here(b)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda k, side: F.struct(k.alias("key"), side.alias("side"))
    inside = F.transform(upto(here(b)), lambda j: task(key(b, F.least(F.col("i"), j), b, F.greatest(F.col("i"), j)), (F.col("i") > j).cast("int")))
    above = F.transform(upto(here(b + 1)), lambda j: task(key(b, F.col("i"), b + 1, j), F.lit(0)))
    below = F.transform(upto(here(b - 1)), lambda j: task(key(b - 1, j, b, F.col("i")), F.lit(1)))
    whole = F.array(task(F.col("cluster").cast("string"), F.lit(0)))
    return sized.join(clusters, "cluster").withColumn("i", i).select(
        "rep", F.when(F.col("total") <= block, whole).otherwise(F.concat(inside, above, below)).alias("tasks"))


def _lookup(values: np.ndarray, row: np.ndarray, rows: int):
    """A function from a row to how many of its values each row shares."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.cumsum(fresh) - 1
    first = np.append(np.flatnonzero(fresh), len(values))
    owner = row[order]
    code = np.empty(len(values), np.int64)
    code[order] = number
    often = (first[1:] - first[:-1])[code] > 1
    code, row = code[often], row[often]
    begin = np.searchsorted(row, np.arange(rows + 1))

    def shares(r: int) -> np.ndarray:
        mine = code[begin[r]:begin[r + 1]]
        size = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(owner[at], minlength=rows)

    return shares


def links_in_task(ids: list, sets: list[np.ndarray], side: list[int], k: int = SKETCH, shared: int = SHARED, percent: int = 80):
    """A forest of links among the documents of a task (across its two sides, if it has two) of the wanted similarity."""
    rows = len(ids)
    n = np.array([len(s) for s in sets])
    side = np.array(side)
    two = len(set(side.tolist())) > 1
    row = np.repeat(np.arange(rows), n)
    full = np.concatenate(sets)
    first = np.repeat(np.cumsum(n) - n, n)
    retained = np.arange(len(full)) - first < k
    by_sketch, by_set = _lookup(full[retained], row[retained], rows), None
    m = np.minimum(n, k)
    group, found = np.arange(rows), []
    for r in range(rows):
        over = by_sketch(r)
        estimate = over / np.maximum(m + m[r] - over, 1)  # of the union of both sketches, the share in both
        whole = (n <= k) & (n[r] <= k)
        enough = np.where(whole, 100 * over >= percent * (m + m[r] - over), estimate >= shared / (2 * k - shared))
        small, large = np.minimum(n, n[r]), np.maximum(n, n[r])
        open_ = enough & (np.arange(rows) > r) & (100 * small >= percent * large) & (group != group[r])
        if two:
            open_ &= side != side[r]
        if not open_.any():
            continue
        by_set = by_set or _lookup(full, row, rows)
        both = by_set(r)
        for other in np.flatnonzero(open_ & (100 * both >= percent * (n + n[r] - both))):
            if group[other] != group[r]:
                found.append((ids[r], ids[other]))
                group[group == group[other]] = group[r]
    return found


def links_of_ids(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id that stands at several classes, with the representative of each."""
    differs = F.min("key_a") != F.max("key_a")
    several = sketched.groupBy("doc_id").agg((differs | (F.min("key_b") != F.max("key_b"))).alias("several")).filter("several").select("doc_id")
    rows = sketched.select("doc_id", "key_a", "key_b").join(several, "doc_id", "left_semi").distinct()
    return rows.join(classes, ["key_a", "key_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, k: int = SKETCH, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of ``docs`` (doc_id, text)."""
    sketched = stored(sketches(docs, width, k), "sketches")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = stored(sketched.filter(linked).groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")), "classes")
    listed = stored(lists(sketched, classes, k, shared), "lists")
    centre = listed.groupBy("v").agg(F.min("rep").alias("b"), F.count("*").alias("many")).filter("many > 1").select("v", "b")
    clusters = components(listed.join(centre, "v").select(F.col("rep").alias("a"), "b").filter("a <> b"))
    sizes = listed.select("rep", "n").distinct()
    roots = clusters.select(F.col("root").alias("node"), "root").distinct()
    members = clusters.union(roots).join(sizes, F.col("node") == F.col("rep")).select("rep", "n", F.col("root").alias("cluster"))
    tasks = tasks_of(members, block).groupBy("rep").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(tasks, "rep")

    def to_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, values, bounds in shingle_sets(b.column(1), width):
                sets = [values[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), b.column(2).slice(first, len(sets)), pa.array(sets, pa.binary())],
                                                 ["rep", "tasks", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = texts.select("rep", "text", "tasks").mapInArrow(to_sets, f"rep {kind}, tasks array<struct<key:string,side:int>>, hashes binary")
    spread = sets.select("rep", "hashes", F.explode("tasks").alias("t")).select("rep", "hashes", F.col("t.key").alias("key"), F.col("t.side").alias("side"))

    def compare(rows):
        import pandas as pd

        found = links_in_task(rows["rep"].tolist(), [np.frombuffer(h, np.uint64) for h in rows["hashes"]], rows["side"].tolist(), k, shared)
        return pd.DataFrame(found, columns=["a", "b"])

    links = spread.groupBy("key").applyInPandas(compare, f"a {kind}, b {kind}")
    joined = components(links.union(links_of_ids(sketched.filter(linked), classes)))
    named = stored(classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "key_a", "key_b", F.coalesce("root", "rep").alias("component")), "components")
    out = sketched.select("doc_id", "n", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
    component = F.when(linked, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    found = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dup": op8_near_dup}
