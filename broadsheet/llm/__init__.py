"""Operators for training-data pipelines, their queries and oracle SQL."""

import importlib

MODULES = ("warc", "packing", "chat", "token_count", "pairwise_quality", "voronoi", "toxicity", "near_dup", "chunked_bpe",
           "quality_rules", "ptolemaic", "dual_tree", "chunk_recipes")


def load_catalog():
    """The queries of this subpackage by name, and the oracle SQL of those that SQL can express."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"broadsheet.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    return queries, oracles
