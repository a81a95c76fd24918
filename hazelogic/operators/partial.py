"""Vectors that tasks add up: they meet by place, so the driver gets one however many tasks there are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of what `at_places` gives.
PLACES = "i long, v double"


def at_places(v: np.ndarray) -> pa.RecordBatch:
    """A task's vector as rows of place and value."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(v.size)), pa.array(np.asarray(v, float).ravel())], names=["i", "v"])


def sum_places(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors; zeros without any."""
    got, out = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow(), np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out
