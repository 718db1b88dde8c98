"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    return np.array(column.tolist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
