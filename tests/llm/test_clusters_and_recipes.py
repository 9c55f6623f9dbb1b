"""Ptolemaic clustering (11) and chunk recipes (13) against plain versions, on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import chunk_recipes, ptolemaic
from broadsheet.llm.voronoi import integers

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


# -- 11: centroid clustering ---------------------------------------------------------------------

def plain_clusters(rows, k, rounds, seed=3):
    """{row number: (cluster, distance)} and the centroids, one vector at a time in Python integers."""
    def far(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b))

    def place(i):
        vec_id, v = rows[i]
        return vec_id is None, hashlib.sha256(f"{seed}:{vec_id}".encode()).hexdigest(), v

    centroids = [rows[i][1] for i in sorted(range(len(rows)), key=place)[:k]]
    for step in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in rows]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, b) in zip(rows, best) if b == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return best, centroids


def clustered(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    return ptolemaic.clusters(df, **options)


def check_clusters(spark, rows, k, rounds, dimensions):
    best, centroids = plain_clusters(rows, k, rounds)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for d, j in best if j == n) for n in range(k)]
    expected = sorted((str(i), j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(rows, best))
    found = clustered(spark, rows, k=k, rounds=rounds, dimensions=dimensions).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == expected


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v) for i, v in enumerate(rng.integers(-50, 50, (120, 6)).tolist())]
    check_clusters(spark, rows, 5, 4, 6)


def test_clusters_with_ties_repeats_and_null_ids(spark):
    rows = [(i, [i % 3, 0]) for i in range(30)] + [(7, [9, 9]), (7, [9, 9]), (7, [-9, 9]), (None, [5, 5]), (None, [5, 5])]
    check_clusters(spark, rows, 4, 3, 2)
    check_clusters(spark, [(1, [2, 2])] * 9, 4, 2, 2)  # all pivots and centroids are one point


def test_clusters_with_few_or_no_rows(spark):
    found = clustered(spark, [(1, [0, 0]), (2, [3, 4])], k=8, dimensions=2).collect()
    assert sorted((r.cluster, r.distance) for r in found) == [(0, 0), (1, 0)]
    empty = clustered(spark, [], dimensions=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.25], 3), (2, None, 3), (3, [1.0], 3), (4, [1.0, None], 3), (5, [inf, 0.0], 3), (6, [nan, 0.0], 3), (7, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    found = ptolemaic.clusters(df.select("vec_id", integers(F.col("embedding"), 1024).alias("v")), dimensions=2).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in found] == [(1, 0, 0)]


def test_components_beyond_the_range_raise(spark):
    with pytest.raises(Exception, match="do not fit"):
        clustered(spark, [(1, [1 << 28, 0])], dimensions=2)


def test_bounds_never_exceed_distances_and_skip_far_centroids(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (8, 16))
    rows = [(i, (centres[i % 8] + rng.integers(-40, 40, 16)).tolist()) for i in range(800)]
    x = np.array([v for _, v in rows])
    pivots, centroids = rng.integers(-5000, 5000, (9, 16)), rng.integers(-5000, 5000, (7, 16))
    known = np.sqrt(np.stack([ptolemaic.squared(x, p[None]) for p in pivots], 1))
    exact = np.stack([ptolemaic.squared(x, c[None]) for c in centroids], 1)
    assert (ptolemaic.Bounds(pivots, centroids)(known) <= exact).all()
    measured = []
    clustered(spark, rows, k=8, rounds=3, dimensions=16, measured=measured).count()
    assert len(measured) == 4 and all(done < 0.5 * pairs for done, pairs in measured)


# -- 13: exact dedup -----------------------------------------------------------------------------

def plain_groups(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha256) by comparing whole texts."""
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(text.translate(BLANK), []).append((-len(text), doc_id is None, doc_id or 0, n, doc_id))
    out = []
    for bare, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out += [(str(m[4]), str(best[4]), len(members), m is best, digest) for m in members]
    return sorted(out)


def grouped(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, group_size int, kept boolean").repartition(3)
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in chunk_recipes.exact_groups(df, **options).collect())


def long_text(seed, n=4000):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé,"), rng.integers(2, 9))) for _ in range(n)]
    return " ".join(w + ". X" if rng.random() < 0.08 else w for w in words)


DOCUMENTS = [
    (1, "One text. And more"), (2, "One  text.\nAnd more"), (3, "One text.And more!"), (None, "Onetext.Andmore"), (None, None), (4, None), (5, ""), (6, " \t\r\n"),
    (7, "no break space stays"), (8, "no break spacestays"), (9, "twice"), (9, "twice"), (9, "once"), (10, "tie a"), (11, "tiea "), (12, "ti ea"),
    (13, long_text(1)), (14, long_text(1).replace(" ", "\n ")), (15, long_text(1) + "x"), (16, "x" + long_text(1)), (17, long_text(1)[:-1]),
    (18, "z" * 5000), (19, "z" * 5001), (20, " ".join("z" * 5000)), (21, "\U0001f600" * 1500), (22, "\U0001f600" * 1500 + " "),
]


def test_groups_match_whole_texts(spark):
    assert grouped(spark, DOCUMENTS) == plain_groups(DOCUMENTS)
    assert grouped(spark, []) == []


def test_chunks_join_to_the_text_and_meet_again_after_an_edit(spark):
    text = long_text(2)
    df = spark.createDataFrame([(1, text), (2, "An inserted sentence. " + text), (3, ""), (4, "z" * 3000)], "doc_id long, text string")
    cut = {r.doc_id: r.c for r in df.select("doc_id", chunk_recipes.chunks(chunk_recipes.without_blanks(F.col("text"))).alias("c")).collect()}
    bare = text.translate(BLANK)
    assert "".join(cut[1]) == bare and "".join(cut[2]) == "Aninsertedsentence." + bare and cut[3] == [] and [len(c) for c in cut[4]] == [1024, 1024, 952]
    assert all(len(c) <= 1024 for c in cut[1]) and len(cut[1]) > 20
    assert len(set(cut[1]) & set(cut[2])) > 0.8 * len(cut[1])
    assert chunk_recipes.chunk_store(df).count() == len(set(cut[1]) | set(cut[2]) | set(cut[4]))


def test_identifiers_that_collide_are_drawn_again(spark):
    def weak(chunk, salt):
        return F.array(F.xxhash64(chunk) % 3) if salt < 2 else chunk_recipes.hash_pair(chunk, salt)

    df = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    assert chunk_recipes.verified_salt(df, weak) == 2
    assert grouped(spark, DOCUMENTS, identify=weak) == plain_groups(DOCUMENTS)


def test_a_hot_group_over_many_tasks(spark):
    rows = [(i, "the same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(200)]
    assert grouped(spark, rows) == plain_groups(rows)


def test_recipes_stay_in_the_jvm(spark):
    df = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    plan = chunk_recipes.exact_groups(df)._jdf.queryExecution().toString() + chunk_recipes.chunk_store(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
