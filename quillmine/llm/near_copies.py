"""Near copies by the Jaccard similarity of their five-word shingles.

A document's signature is one byte at each of ``BYTES`` positions, the low byte of the minimum of its shingle hashes
under that position's permutation: a positional byte is equal in two signatures as often as the shingle sets are
alike.  An inverted index lists signatures by the bytes at ``RUN`` positions at a time; documents of similarity 0.8
share a list with probability 0.9996.  The shared positional bytes of a pair are tallied, pairs below the
minimum go, and the exact similarity of the shingle sets decides about the others.

In rounds one member of every list is its centre, first the one in the fullest lists, and each document that is not
in its centre's group yet is held against one centre of its lists: pairs grow linearly with the documents, however
large a list is.  When a round links few of its pairs, what is left of the lists is compared in blocks of
bounded size: signatures of different groups are tallied there and close ones checked in place, so that only links
leave the task and no pair of a list is passed over.  Documents with equal shingle sets are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm import simhash
from quillmine.llm.common import discard, own_folder, row_key, written
from quillmine.llm.components import connected_components
from quillmine.llm.simhash import _hashes
from quillmine.session import ship_package

SHINGLE = 5
LEAST = 0.8
BYTES = 100
RUN = 5
#: Shared positional bytes that a pair must have, as a share of those expected at the least similarity: five deviations below.
TALLY = 0.75
#: Rounds of one centre a list go on while so large a share of their pairs is linked.
WORTHWHILE = 0.05
#: Members of a list that are tallied against each other in one task.
BLOCK = 1024
SEED = 7


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles, words and cases as in ``simhash.fingerprints``."""
    parts = [np.array(h, dtype=np.uint64) for h in _hashes((text or "").encode("utf-8", "surrogatepass").lower(), size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """The positional bytes of a set of hashes; none for an empty set."""
    if not len(hashes):
        return b""
    draw = np.random.default_rng(SEED)
    factor, shift, mix = (draw.integers(0, 1 << 63, BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    least = np.full(BYTES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at:at + 1024, None] * factor + shift).min(axis=0), out=least)
    return ((least * mix) >> np.uint64(56)).astype(np.uint8).tobytes()


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST, bits: int | None = None
) -> DataFrame:
    """``docs`` with one row of every group of near copies: the smallest key, then the smallest text hash.

    ``bits``: documents whose ``simhash`` fingerprints differ in at most so many bits are proposed first and checked
    like any other pair; the lists go on from these groups and find what fingerprints miss.

    Texts without words are copies of each other.  Rows with a null key come last, and rows equal in key and
    text count as one, whichever stays.  A text's shingle set is one cell while it is compared, 8 bytes a word.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = own_folder(spark, "near-copies")
    named = docs.select(F.col(key).alias("key"), *(c.alias(n) for n, c in _row(key, text).items()), F.col(text).alias("text"))
    linked = simhash.fingerprints(named) if bits is not None else named
    prints = written(_prints(linked, size), "prints", scratch)
    row = F.struct(F.col("key").isNull().alias("last"), "key", "hash", "check")
    kinds = written(prints.groupBy("sid").agg(F.min(row).alias("least"), F.min("n").alias("n"), F.min("signature").alias("signature")), "kinds", scratch)
    first = spark.createDataFrame([], "left bigint, right bigint")
    if bits is not None:
        pairs = written(_fingerprint_pairs(prints, bits), "fingerprint-pairs", scratch)
        first = written(_similar(pairs, kinds, named, size, least, scratch), "fingerprint-links", scratch)
    links = _links(kinds, named, first, size, least, scratch)
    roots = _roots(links)
    rooted = kinds.select("sid", "least").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least"))
    kept = written(kept.select(F.col("least.hash").alias("__row"), F.col("least.check").alias("__check")), "near-copies-kept")
    discard(spark, scratch)
    # two hashes, 96 bits, stand for key and text: one exchange of the texts serves the join and the removal of repeats
    mine = _row(key, text)
    hashed = docs.withColumns({"__row": mine["hash"], "__check": mine["check"]})
    same = ["__row", "__check"]
    return hashed.join(kept, same, "left_semi").dropDuplicates(same).select(*(F.col(f"`{c}`") for c in docs.columns))


def _row(key: str, text: str) -> dict[str, Column]:
    return {"hash": row_key(key, text), "check": F.hash(F.col(key), F.col(text))}


def _prints(named: DataFrame, size: int) -> DataFrame:
    """Every row's key and hashes, a hash of its shingle set, the set's size and its signature."""

    @F.pandas_udf("sid bigint, n int, signature binary")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for batch in texts:
            out = []
            for one in batch:
                some = shingles(one, size)
                out.append((xxh64_intdigest(some.tobytes()), len(some), signature(some)))
            ids = np.array([o[0] for o in out], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"sid": ids, "n": [o[1] for o in out], "signature": [o[2] for o in out]})

    return named.withColumn("__s", column("text")).select(*(c for c in named.columns if c != "text"), "__s.*")


def _fingerprint_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """``left, right``: every shingle set of a group of linked fingerprints, and the smallest one of the group."""
    sets = prints.select("sid", "simhash").distinct()
    groups = sets.join(simhash.link_groups(sets.select("simhash"), "simhash", bits), "simhash", "left").select(
        "sid", F.coalesce("root", "simhash").alias("group")).distinct()
    smallest = groups.groupBy("group").agg(F.min("sid").alias("right"))
    return groups.join(smallest, "group").where("sid <> right").select(F.col("sid").alias("left"), "right")


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links, "left", "right").select(F.col("node").alias("sid"), F.col("component").alias("root"))


def _links(kinds: DataFrame, named: DataFrame, first: DataFrame, size: int, least: float, scratch: str) -> DataFrame:
    """``left, right``: the ``first`` links, and pairs of shingle sets of at least the given similarity that connect the groups."""
    places = [F.xxhash64(F.lit(at), F.substring("signature", at + 1, RUN)) for at in range(0, BYTES, RUN)]
    rooted = kinds.where("n > 0").join(_roots(first), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lists = rooted.select("sid", F.explode(F.array(*places)).alias("value"), "root")
    spark, found = kinds.sparkSession, first
    worthwhile = True
    for step in count():
        folder = f"{scratch}/round{step}"
        ends = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        # lists whose members are one group already are done
        apart = written(lists.join(ends.where("low < high").select("value", "size"), "value"), "apart", folder)
        if apart.isEmpty():
            return found
        if not worthwhile:
            return found.unionByName(written(_links_in_lists(apart, kinds, named, size, least, folder), "last", scratch))
        pairs = written(_tallied(_with_centres(apart, step), kinds, least), "pairs", folder)
        new = written(_similar(pairs, kinds, named, size, least, folder), f"links{step}", scratch)
        found = found.unionByName(new)
        worthwhile = new.count() > WORTHWHILE * pairs.count()
        lists = written(apart.select("value", "sid").join(_roots(found), "sid", "left").withColumn("root", F.coalesce("root", "sid")), f"lists{step}", scratch)
        discard(spark, folder)


def _with_centres(apart: DataFrame, step: int) -> DataFrame:
    """``left, right``: every document and one centre of its lists that is of another group."""
    if step == 0:
        order = apart.groupBy("sid").agg(F.sum("size").alias("order"))
        apart = apart.join(order, "sid")
    else:
        # another order of the members, and so other centres, in every round
        apart = apart.withColumn("order", F.xxhash64(F.lit(step), "sid"))
    centres = apart.groupBy("value").agg(F.max(F.struct("order", "sid", "root")).alias("centre"))
    met = apart.select("value", "sid", "root").join(centres, "value").where("root <> centre.root")
    return met.groupBy("sid").agg(F.max("centre").alias("centre")).select(F.col("sid").alias("left"), F.col("centre.sid").alias("right"))


def _tally(x: pd.Series, y: pd.Series) -> pd.Series:
    """How many positional bytes signatures share."""
    a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), BYTES) for s in (x, y))
    return pd.Series((a == b).sum(axis=1, dtype=np.int32))


def _tallied(pairs: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures share enough bytes."""
    tally = F.pandas_udf(_tally, "int")
    x, y = (kinds.select(F.col("sid").alias(side), F.col("n").alias(n), F.col("signature").alias(sig))
            for side, n, sig in (("left", "nx", "sx"), ("right", "ny", "sy")))
    both = pairs.join(x, "left").join(y, "right").where(F.least("nx", "ny") >= least * F.greatest("nx", "ny"))
    return both.where(tally("sx", "sy") >= TALLY * least * BYTES).select("left", "right")


def _links_in_lists(lists: DataFrame, kinds: DataFrame, named: DataFrame, size: int, least: float, folder: str) -> DataFrame:
    """Links between different groups of a list, each list in blocks of bounded size.

    A pair that shares several lists is looked at in the first of them only.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    cut = lists.select("value", "sid", "root", blocks.alias("blocks"), own.alias("own"))
    met = cut.select("value", "sid", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("value", "sid", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = _sets(lists.select("sid").distinct(), kinds, named, size, folder)
    rows = met.join(kinds.select("sid", "signature").join(sets, "sid"), "sid")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sid")
        sids, block, some = part["sid"].to_numpy(), part["own"].to_numpy(), part["set"].tolist()
        root, n = part["root"].to_numpy().copy(), np.array([len(s) for s in some])
        signs = np.frombuffer(b"".join(part["signature"]), dtype=np.uint8).reshape(len(part), BYTES)
        run = int((signs == signs[0]).all(axis=0).reshape(-1, RUN).all(axis=1).argmax()) * RUN
        across = part["i"].iloc[0] != part["j"].iloc[0]
        found = []
        for at in range(len(part)):
            fit = (root[at + 1:] != root[at]) & ((block[at + 1:] != block[at]) | (not across))
            fit &= np.minimum(n[at + 1:], n[at]) >= least * np.maximum(n[at + 1:], n[at])
            spot = np.flatnonzero(fit) + at + 1
            same = signs[spot] == signs[at]
            first = ~same[:, :run].reshape(len(spot), run // RUN, RUN).all(axis=2).any(axis=1)
            for other in spot[first & (same.sum(axis=1) >= TALLY * least * BYTES)]:
                if root[other] != root[at]:
                    both = len(np.intersect1d(some[at], some[other], assume_unique=True))
                    if both >= least * (n[at] + n[other] - both):
                        found.append((sids[at], sids[other]))
                        root[root == root[other]] = root[at]
        return pd.DataFrame(found, columns=["left", "right"], dtype="int64")

    return rows.groupBy("value", "i", "j").applyInPandas(links, "left bigint, right bigint")


def _sets(sids: DataFrame, kinds: DataFrame, named: DataFrame, size: int, folder: str) -> DataFrame:
    """``sid, set``: shingle sets, made anew for the members asked for."""

    @F.pandas_udf("array<bigint>")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size).view(np.int64) for t in texts])

    rows = kinds.join(sids, "sid", "left_semi").select("sid", F.col("least.hash").alias("hash"), F.col("least.check").alias("check"))
    some = named.join(rows, ["hash", "check"]).select("sid", column("text").alias("set"))
    return written(some.dropDuplicates(["sid"]), "sets", folder)


def _similar(pairs: DataFrame, kinds: DataFrame, named: DataFrame, size: int, least: float, folder: str) -> DataFrame:
    """The pairs whose shingle sets have at least the given Jaccard similarity."""
    some = _sets(pairs.select(F.col("left").alias("sid")).union(pairs.select("right")).distinct(), kinds, named, size, folder)
    x, y = (some.select(F.col("sid").alias(side), F.col("set").alias(name)) for side, name in (("left", "x"), ("right", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "left").join(y, "right").where(both >= least * (F.size("x") + F.size("y") - both)).select("left", "right")
