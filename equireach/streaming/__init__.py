"""Year-partitioned inputs are batch; a stream of rows needs only the sums below.

The ordered statistics need all rows of a group, but counts, sums and means by key can follow a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.functions.clean import divided, to_double


def running_means(rows: DataFrame, value: str, weight: str, keys: Sequence[str], event_time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(keys, [window,] grid_num, pop_num, pop_mean) over a stream or a table; with event_time, by tumbling window."""
    x, w = to_double(F.col(value)), to_double(F.col(weight))
    valid = rows.withColumns({"_x": x, "_w": w}).where(F.col("_x").isNotNull() & (F.col("_w") > 0))
    by = [F.col(k) for k in keys]
    if event_time:
        valid = valid.withWatermark(event_time, late)
        by.append(F.window(event_time, window))
    return valid.groupBy(*by).agg(F.count(F.lit(1)).alias("grid_num"), F.sum("_w").alias("pop_num"), divided(F.sum(F.col("_x") * F.col("_w")), F.sum("_w")).alias("pop_mean"))
