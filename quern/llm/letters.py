"""Packed messages between slices of a corpus and groups of keys: one row per sender and group, with arrays as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: kind: what the letter is; at: the group that gets it; of: its sender; n, v: numbers to sum up; parts: arrays.
LETTERS = "kind byte, at long, of long, n long, v long, parts array<binary>"


def _bytes(part) -> bytes:
    return part if isinstance(part, bytes) else np.ascontiguousarray(part).tobytes()


def letters(rows: list[tuple], table: bool = False):
    """Rows (kind, at, of, n, v, arrays or bytes) in Arrow."""
    cols = list(zip(*rows)) if rows else [()] * 6
    types = [pa.int8(), *[pa.int64()] * 4]
    parts = pa.array([[_bytes(p) for p in ps] for ps in cols[5]], pa.list_(pa.binary()))
    return (pa.Table if table else pa.RecordBatch).from_arrays([*(pa.array(c, t) for c, t in zip(cols[:5], types, strict=True)), parts], ["kind", "at", "of", "n", "v", "parts"])


def grouped(frame: DataFrame, run) -> DataFrame:
    """run(at, rows by kind, each in order of sender) for every group of letters; it returns rows."""

    def go(table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for r in sorted(table.to_pylist(), key=lambda r: r["of"]):
            by.setdefault(r["kind"], []).append(r)
        return letters(run(table.column("at")[0].as_py(), by), True)

    return frame.groupBy("at").applyInArrow(go, LETTERS)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """Groups are ranges of the leading bits, so ids in order are groups in order."""
    return ((ids >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()
