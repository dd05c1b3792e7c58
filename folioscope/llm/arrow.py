"""Arrow helpers of the operators: whole batches in, whole batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with a state that is built once per task by make()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for b in batches:
            step = step or make()
            out = step(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a result of bounded size, without a Python object per row."""
    t = df.toArrow()
    return {c: t[c].to_numpy() for c in t.column_names}


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset of each text (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; in place for a uint64 array."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
