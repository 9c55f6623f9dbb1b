"""Dual-tree ranking (12) against a plain double loop."""

import math
import re

import numpy as np

from broadsheet.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_ranking(docs, items, k):
    """Sorted (item_id, rank, doc_id, score), every item with every document."""
    words = [terms(t) for _, t in docs]
    n_docs, length = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, mine in wanted.items():
        scores = []
        for (doc_id, _), w in zip(docs, words):
            m = 50 + (50 * len(w) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                        for t in mine if t in w)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(str(item_id), rank, str(s[3]), -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, docs, items, k, **options):
    d = spark.createDataFrame([(*r, 0.5, 1) for r in docs], "doc_id long, text string, score double, rank int").repartition(3)
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id int")
    found = sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in dual_tree.ranked(d, i, k, **options).collect())
    assert found == plain_ranking(docs, items, k)


def texts(seed, n, languages=3, words=60):
    """Texts over vocabularies of their own, frequent words first."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        pick = np.minimum(rng.geometric(0.08, words), 200) if i % 7 else rng.integers(1, 200, 3)
        out.append(" ".join(f"w{i % languages}x{p}" for p in pick))
    return out


def test_ranking_matches_a_double_loop(spark):
    docs, items = list(enumerate(texts(0, 300))), list(enumerate(texts(1, 40, words=12)))
    check(spark, docs, items, 5, block=64, fan=4)
    check(spark, docs, items, 7, block=50, fan=3, group_items=11, seed=2)  # several groups of items


def test_ranking_with_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, "Alpha beta"), (2, "alpha BETA"), (3, "alpha-beta"), (None, "alpha beta"), (4, None), (5, ""), (6, "!? .."), (7, "Été ÉTÉ été alpha"),
            (8, "naïve word x"), (9, "alpha " * 20_000), (1, "alpha beta"), (1, "gamma"), (10, "İ ß ẞ"), (None, None)]
    items = [(1, "alpha Beta beta"), (2, None), (3, ""), (4, "nowhere"), (5, "ÉTÉ été"), (None, "gamma alpha"), (1, "gamma"), (6, "naïve word"), (7, "ß x")]
    check(spark, docs, items, 4)
    check(spark, docs, items, 100)
    check(spark, docs * 5, items, 3, block=4, fan=2)


def test_ranking_of_empty_tables(spark):
    check(spark, [], [(1, "a")], 3)
    check(spark, [(1, "a")], [], 3)
    check(spark, [(1, None)], [(1, "a")], 3)


def test_batches_are_left_out():
    """With kth scores from a part of the documents, most pairs are never scored, and the best stay the same."""
    rng = np.random.default_rng(3)
    size, n = 400, 4096
    items = [np.unique(rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 12)) for i in range(64)]
    held = [np.unique(rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 20)) for i in range(n)]
    df = np.bincount(np.concatenate(held), minlength=size)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    counts = np.array([len(h) for h in held])

    def run(least, rows):
        task = dual_tree.Search(items, weights, df, n, int(counts.sum()), 5, least)
        task.show(rows, np.zeros(len(rows), bool), counts[rows], counts[rows], np.concatenate([held[r] for r in rows]), np.ones(counts[rows].sum(), np.int64))
        return task

    everything = run(np.zeros(64, np.int64), np.arange(n))
    part = run(np.zeros(64, np.int64), np.sort(rng.permutation(n)[:512]))
    least = np.zeros(64, np.int64)
    for item, best in zip(part.order, part.best):
        least[item] = best[0][-1]
    quick = run(least, np.arange(n))
    found = [sorted(zip(*(c.tolist() for c in t.results()))) for t in (everything, quick)]
    assert found[0] == found[1] and len(found[0]) == 64 * 5
    assert quick.pairs == 64 * n and quick.exact < 0.5 * quick.pairs


def test_node_products_bound_every_pair_below():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(37)]
    leaf = dual_tree.Rows(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), rng.integers(1, 1000, sum(map(len, rows))).astype(float))
    tree, weights = leaf.tree(3), rng.integers(0, 100, 50).astype(float)
    exact = leaf.times(np.arange(37), weights)
    for level, nodes in enumerate(tree):
        bound = nodes.times(np.arange(len(nodes)), weights)
        assert (bound[np.arange(37) // 3 ** level] >= exact).all()
    assert len(tree[-1]) == 1
