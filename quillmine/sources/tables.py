"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task gets at most when a table is dealt anew.
TASK_ROWS = 100_000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one whose rows lie in fewer tasks than there are cores is dealt over them.

    Spark cuts files by bytes but never splits a row group, and a row group of a small, well packed
    table may hold a million rows: a few tasks would get all rows, and every text step with them, while
    the other cores idle.  So rows count, not splits (from the files' footers).  A table without a split
    of more than twice its share is left as it lies: no exchange.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    rows = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.sum("count"), F.max("count")).first()
    total, largest = rows[0] or 0, rows[1] or 0
    if total and largest * cores <= 2 * total:
        return df
    return df.repartition(max(cores, -(-total // TASK_ROWS)))
