"""Best-fit packing into sequences of several permitted lengths.

Lengths are whole numbers up to the largest permitted one, so all a packing needs to know of a
corpus is how many pieces have each length: a table no longer than that capacity, whatever the
corpus holds.  The driver packs this table.  The longest piece left opens a bin; every permitted
size that holds it is filled best-fit (always the longest piece that still fits), the size with the
least cost per packed token is opened, shrunk to the smallest permitted size that holds its
contents, and repeated for as long as the counts allow.  The tasks then number the pieces of each
length and look their place up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import without
from quillmine.session import ship_package

#: Permitted sequence lengths and what a sequence of each costs: its length and a fixed overhead.
SIZES = {512: 576.0, 1024: 1088.0, 2048: 2112.0, 4096: 4160.0}
BLOCK_ROWS = 4096
RANKS = 1 << 44


def words(text: str = "text") -> Column:
    """Words of a text, a length that ``sequences`` can cut by: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def pack(docs: DataFrame, key: str = "doc_id", length: str = "n_tokens", sizes: Mapping[int, float] = SIZES) -> DataFrame:
    """One row per piece: ``key, piece, start, n_tokens, bin_id, bin_size, bin_offset``.

    A document is cut into pieces of the largest size and a rest; ``piece`` counts from 0, ``start`` is the
    piece's first token in the document, ``bin_offset`` its first token in the bin.  No bin holds more
    than its size.  A null, zero or negative length gives one row of 0 tokens with null bin columns, so no
    document is lost.  Repeated rows are packed as often as they come; ties between pieces of one length
    are broken by ``key`` and ``piece``.  Other columns do not pass through.
    """
    ship_package(docs.sparkSession)
    most = max(sizes)
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("bigint")
    counted = docs.select(F.col(key), n.alias("total"))
    last = F.greatest(F.ceil(F.col("total") / most).cast("bigint") - 1, F.lit(0))
    pieces = counted.select(key, "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        key, "piece", (F.col("piece") * most).alias("start"),
        F.least(F.col("total") - F.col("piece") * most, F.lit(most)).alias("n_tokens"))
    # at most as many rows as the largest size
    counts = {r.n_tokens: r.n for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = ranked(pieces.where("n_tokens > 0"), "n_tokens", (key, "piece"), max(counts.values(), default=0))
    places = plan(counts, sizes)
    schema = placed.drop("rank").schema.simpleString()[7:-1] + ",bin_id:bigint,bin_size:int,bin_offset:int"
    packed = placed.mapInPandas(_placer(places), schema)
    empty = pieces.where("n_tokens = 0").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (
        ("bin_id", "bigint"), ("bin_size", "int"), ("bin_offset", "int"))))
    return packed.unionByName(empty)


def ranked(rows: DataFrame, group: str, order: tuple[str, ...], largest: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``rank``, numbering the rows of each group from 0.

    Groups are cut into blocks by a hash, so a group that holds a third of all rows is numbered by many
    tasks; a block's first number is the running sum of the block sizes before it.
    """
    blocks = max(1, -(-largest // block_rows))
    cut = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = cut.groupBy(group, "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(group, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(group, "block").orderBy(*order))
    numbered = cut.withColumn("own", own).join(firsts, [group, "block"])
    return numbered.select(*rows.columns, (F.col("first") + F.col("own") - 1).alias("rank"))


def plan(counts: Mapping[int, int], sizes: Mapping[int, float]) -> pd.DataFrame:
    """Where pieces go: ``length, rank, each, bin, size, offset``, by length and first rank.

    Pieces of a length from ``rank`` on lie ``each`` to a bin, in bins from ``bin`` on, the first at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, used, out, bins = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        size, contents = min((_filled(s, lengths, left) for s in sizes if s >= lengths[-1]),
                             key=lambda f: (sizes[_shrunk(f, sizes)] / _sum(f[1]), -_sum(f[1])))
        size = _shrunk((size, contents), sizes)
        times = min(left[n] // each for n, each in contents)
        offset = 0
        for n, each in contents:
            out.append((n, used[n], each, bins, size, offset))
            offset += n * each
            used[n] += times * each
            left[n] -= times * each
            if left[n] == 0:
                del lengths[bisect_right(lengths, n) - 1]
        bins += times
    return pd.DataFrame(sorted(out), columns=["length", "rank", "each", "bin", "size", "offset"]).astype("int64")


def _filled(size: int, lengths: list[int], left: Mapping[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """A bin's contents as (length, how many): the longest pieces first that still fit."""
    space, at, contents = size, len(lengths), []
    while at and (at := bisect_right(lengths, space, 0, at)):
        n = lengths[at - 1]
        each = min(left[n], space // n)
        contents.append((n, each))
        space -= n * each
        at -= 1
    return size, contents


def _sum(contents: list[tuple[int, int]]) -> int:
    return sum(n * each for n, each in contents)


def _shrunk(filled: tuple[int, list[tuple[int, int]]], sizes: Mapping[int, float]) -> int:
    held = _sum(filled[1])
    return min(s for s in sizes if s >= held)


def _placer(places: pd.DataFrame):
    table = {c: places[c].to_numpy() for c in places.columns}
    keys = table["length"] * RANKS + table["rank"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            length, rank = part["n_tokens"].to_numpy(), part["rank"].to_numpy()
            at = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
            step = rank - table["rank"][at]
            yield part.drop(columns="rank").assign(
                bin_id=table["bin"][at] + step // table["each"][at],
                bin_size=table["size"][at].astype("int32"),
                bin_offset=(table["offset"][at] + step % table["each"][at] * length).astype("int32"))

    return run


def sequences(docs: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per bin: ``bin_id, bin_size, keys, texts``, pieces in the order of their offsets.

    A bin holds at least one token per piece, so its lists are no longer than the largest size.
    Expects one text per key, and lengths that were counted in ``words``.
    """
    split = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = packed.where("bin_id IS NOT NULL").join(without(docs, "piece").select(key, split.alias("w")), key)
    part = F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")), " ")
    rows = cut.select("bin_id", "bin_size", F.struct("bin_offset", F.col(key).alias("key"), part.alias("part")).alias("p"))
    bins = rows.groupBy("bin_id", "bin_size").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return bins.select("bin_id", "bin_size", F.col("p.key").alias("keys"), F.col("p.part").alias("texts"))
