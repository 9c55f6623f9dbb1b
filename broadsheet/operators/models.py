"""Page models and scorers as user functions over batches of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from broadsheet.operators.blocks import pending_pages


def run_page_model(pages: DataFrame, runner: Callable[[list[dict]], Sequence[str]], batch_size: int = 1,
                   stored: DataFrame | None = None) -> DataFrame:
    """Outputs of ``runner`` for every page that has none stored yet.

    The runner gets up to ``batch_size`` pages as dicts and must return one output for each.
    Concurrency is the number of partitions; a model may be loaded once per worker by the runner.
    """
    if batch_size <= 0:
        raise ValueError("Batch size must be greater than zero.")
    todo = pages if stored is None else pending_pages(pages, stored)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                outputs = list(runner(part.to_dict("records")))
                if len(outputs) != len(part):
                    raise RuntimeError("The page model returned an unexpected number of outputs.")
                yield part[["doc_id", "page_no"]].assign(output=outputs)

    return todo.mapInPandas(run, "doc_id long, page_no int, output string")


def score_with_model(pages: DataFrame, scorer: Callable[[dict], str | None]) -> DataFrame:
    """Reply of ``scorer`` per page, null where it fails, for ``relevance.apply_model_replies``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            replies = []
            for row in frame.to_dict("records"):
                try:
                    replies.append(scorer(row))
                except Exception:  # noqa: BLE001 - a failed page falls back to the heuristic
                    replies.append(None)
            yield frame[["doc_id", "page_no"]].assign(reply=pd.Series(replies, index=frame.index, dtype="object"))

    return pages.mapInPandas(run, "doc_id long, page_no int, reply string")
