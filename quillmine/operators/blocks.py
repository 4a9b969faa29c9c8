"""Tiles of a corpus against blocks of questions, and batches of texts in small pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of a piece of a batch.
PIECE_CHARS = 1 << 20


def pieces(batches: Iterator[pd.DataFrame], text: str, chars: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """Batches cut after about so many characters of a column, rows in order and each in one piece.

    A batch holds up to 64 MB of texts; what a step makes of it, several times as much, leaves the
    task piece by piece.
    """
    for batch in batches:
        ends = np.cumsum([len(t) if t else 0 for t in batch[text]])
        cuts = np.flatnonzero(np.diff(ends // chars)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            if end > start:
                yield batch.iloc[start:end]


def block_count(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def block_of(n_blocks: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))


def meet(tiles: DataFrame, blocks: DataFrame, n_blocks: int, tile_keys: tuple[str, ...], salts: int | None = None) -> DataFrame:
    """Every tile with every block, as an equi-join on the block number and a salt.

    Spark broadcasts the blocks where their size allows and shuffles both sides otherwise.  All
    tiles meet each block, so the salt, a hash of what tells tiles apart, spreads a block's tiles over
    as many tasks as the session has shuffle partitions for it.
    """
    if salts is None:
        salts = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    salt = F.pmod(F.xxhash64(*tile_keys), F.lit(salts)).cast("int")
    placed = tiles.withColumn("salt", salt).withColumn("block", F.explode(numbers))
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return placed.join(copies, ["block", "salt"])


class TopRows:
    """The best ``k`` rows per question among all that a task has seen; ties follow ``order``."""

    def __init__(self, k: int, order: list[str], ascending: list[bool], hold: int = 200_000):
        self.k, self.order, self.ascending, self.hold = k, order, ascending, hold
        self.parts: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, part: pd.DataFrame) -> None:
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > self.hold:
            kept = self.best()
            self.parts, self.rows = [kept], len(kept)
            self.hold = max(self.hold, 2 * len(kept))

    def best(self) -> pd.DataFrame:
        rows = pd.concat(self.parts, ignore_index=True)
        return rows.sort_values(self.order, ascending=self.ascending, kind="stable").groupby("query_id", sort=False).head(self.k)
