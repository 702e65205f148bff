"""What the operators on embeddings share: reading columns of vectors into arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_vector(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Only the two columns (id, vector of doubles), whatever else the table has."""
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places in the batch, matrix) of the vectors of each width that are not null, not empty, and hold neither
    null nor non-finite entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null entries become NaN
    widths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(widths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (widths > 0) & (bad[ends] == bad[ends - widths])
    for width in np.unique(widths[good]).tolist():
        places = np.flatnonzero(good & (widths == width))
        yield width, places, flat[(ends[places] - width)[:, None] + np.arange(width)]
