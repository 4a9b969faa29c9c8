"""Row numbers for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_row_number(
    df: DataFrame, group: Sequence[str], coarse: Sequence[str], fine: Sequence[str], name: str
) -> DataFrame:
    """Row number per group ordered by (coarse, fine), without one task per group.

    ``coarse`` columns cut a group into consecutive runs.  Run sizes are counted with a map-side
    combine, their running sum gives each run its first number, and only runs are sorted.  A hot
    group so spreads over as many tasks as it has runs; the data is exchanged once.
    """
    keys = [*group, *coarse]
    before = Window.partitionBy(*group).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys).agg(F.count("*").alias("run_size"))
        .withColumn("run_start", F.coalesce(F.sum("run_size").over(before), F.lit(0)))
        .drop("run_size")
    )
    run = Window.partitionBy(*keys).orderBy(*fine)
    return (
        df.join(starts, keys)
        .withColumn(name, F.row_number().over(run) + F.col("run_start"))
        .drop("run_start")
    )
