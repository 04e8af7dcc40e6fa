"""User functions over Arrow batches: a grouped aggregate and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def mean_absolute_change(values: pd.Series, order: pd.Series) -> float:
    """The mean absolute step of a group's values in their order; null for fewer than two."""
    return float(values.iloc[order.argsort(kind="stable")].diff().abs().mean()) if len(values) > 1 else None


@F.arrow_udtf(returnType="key long, step int, level double")
class Ladder:
    """Price levels around the prices of a batch of rows: two to each side, half a unit apart."""

    STEPS, WIDTH = np.arange(-2, 3), 0.5

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, prices = (np.asarray(rows.column(k)) for k in (0, 1))
        n = len(self.STEPS)
        levels = (prices[:, None] + self.STEPS * self.WIDTH).ravel()
        yield pa.table({"key": np.repeat(keys, n), "step": np.tile(self.STEPS.astype(np.int32), len(keys)), "level": levels})
