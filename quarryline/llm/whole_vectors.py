"""Vectors as whole numbers, in which scores and distances are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Components up to this size keep 64 products or squares within 64 bits.
LIMIT = 1 << 27


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def takes_part(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector has no null or non-finite component, nor one of over 2^27 scaled."""

    def usable(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT / scale)

    return vector.isNotNull() & F.coalesce(F.forall(vector, usable), F.lit(False))


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, vector) of the rows whose vector takes part, as whole numbers."""
    vector = F.col(vector_column)
    return rows.where(takes_part(vector, scale)).select(
        F.col(id_column).cast("long").alias("id"), whole_numbers(vector, scale).alias("vector")
    )


def as_matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows of 64-bit integers; a list that is shorter than the longest ends in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out
