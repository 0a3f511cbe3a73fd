"""Which rows of a table of vectors count, and vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector is not null and holds no null or non-finite entry, and the vectors' length.

    All vectors of a table have one length: the commonest of the usable rows
    (of equally common ones the longest). A row of another length is no vector
    of that space and is dropped like one with a null entry. The length of an
    empty table is 0.
    """
    finite = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))))
    found = finite.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = found["length"] if found else 0
    return finite.where(F.size(vector) == length), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length): the numbers of a batch of lists that all have ``length`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
