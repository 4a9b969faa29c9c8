"""What the operators of this folder share: tables, row keys and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.translate(col, UPPER, LOWER)


def row_key(*cols: str) -> Column:
    """64-bit key of a row's identity and text: rows with equal values share it."""
    return F.xxhash64(*(F.col(c) for c in cols))


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a table that one run writes."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there.

    Unlike a checkpoint the copy is columnar, and Spark knows its size when it plans joins.
    ``within``: a folder of its caller's, who discards it once no table in it is read any more.
    """
    spark = df.sparkSession
    folder = f"{within}/{name}-{uuid.uuid4().hex}" if within else own_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))
