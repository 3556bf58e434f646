"""Reading embedding columns inside tasks, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    vector = F.col(embedding).cast("array<double>")
    return df.select(F.col(vec_id).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
