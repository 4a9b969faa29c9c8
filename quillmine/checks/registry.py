"""Registry of checked queries: a Spark job and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmine.checks.inputs import Inputs, with_inputs


@dataclass(frozen=True)
class Checked:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


CHECKED: dict[str, Checked] = {}


def checked(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under an operator id."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Inputs(spark, sf_dir)))

        if name in CHECKED:
            raise ValueError(f"{name} is registered twice")
        CHECKED[name] = Checked(build, with_inputs(oracle) if oracle else None)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in types every engine shares: BIGINT, DOUBLE to 6 digits, strings."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.array_join(col, "|")
        out.append(col.alias(field.name))
    return df.select(*out)
