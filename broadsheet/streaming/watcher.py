"""Folder watch as a stream of scan rows with state per path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "scan_id long, path string, size long, mtime_ns long"
STATE = "scan_id long, size long, mtime_ns long, lasted int"


def stable_files_stream(scans: DataFrame, stable_scans: int = 2, forget_after_hours: float = 24) -> DataFrame:
    """Releases of ``registry.stable_files`` from a stream of ``(scan_id, path, size, mtime_ns)``.

    The state of a path is its last scan, fingerprint and how many scans that has lasted; rows of a
    batch are taken by scan id, whatever order they came in. A path missing from a scan starts
    over, as its next scan id is not the one expected. Repeated rows of a scan count once, by their
    largest values; rows of scans already seen are skipped. State of paths silent for
    ``forget_after_hours`` (longer than the time between scans) is dropped, which keeps the query
    making batches; give it a processing-time trigger of the poll interval.
    """

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(frames)).groupby("scan_id", as_index=False)[["size", "mtime_ns"]].max().sort_values("scan_id")
        if last is not None:
            rows = rows[rows["scan_id"] > last[0]]
        for scan_id, size, mtime in zip(rows["scan_id"], rows["size"], rows["mtime_ns"]):
            same = last is not None and last[0] + 1 == scan_id and last[1:3] == (size, mtime)
            lasted = last[3] + 1 if same else 0
            last = (int(scan_id), int(size), int(mtime), int(lasted))
            if lasted == stable_scans:
                out.append((last[0], key[0], last[1], last[2]))
        state.update(last)
        state.setTimeoutDuration(int(forget_after_hours * 3600 * 1000))
        if out:
            yield pd.DataFrame(out, columns=["scan_id", "path", "size", "mtime_ns"])

    return scans.groupBy("path").applyInPandasWithState(
        release, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
