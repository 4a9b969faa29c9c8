"""Near duplicates by SimHash: linked fingerprints form groups.

Fingerprints that differ in at most 3 of 64 bits agree in at least 5 of their 8 bytes.  The inverted
index lists fingerprints by the values at 5 byte positions at a time, so two of them stand in a common
list exactly if their count of shared positional bytes reaches that guaranteed minimum.  Inside a
list the differing bits are counted; what leaves it is a spanning forest, never all pairs.  Equal
fingerprints are one entry, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import row_key, without, written
from quillmine.llm.components import connected_components
from quillmine.session import cut_lineage, ship_package

SHINGLE = 3
BITS = 3
SEED = 42
PIECE = 1 << 20
#: Up to so many fingerprints are compared with each other; longer lists look neighbours up by flipped bits.
PAIRWISE = 4096


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``simhash`` (long): a bit is 1 if set in over half of the shingles' XXH64.

    A-Z count as a-z; words are runs without ASCII white space, shingles ``shingle`` words joined by
    single spaces, repeats included; a text of fewer words is one shingle, a text of none (null, empty,
    blank) has fingerprint 0.  Rows one for one; a column ``simhash`` is replaced.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("bigint")
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return without(docs, "simhash").withColumn("simhash", column(F.col(text)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes((text or "").encode("utf-8", "surrogatepass").lower(), shingle):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def _hashes(raw: bytes, shingle: int) -> Iterator[list[int]]:
    """Hashes of a text's shingles, a piece of the text at a time so that a long one needs little memory."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    short = True
    for piece in _pieces(raw):
        held += piece.split()
        if len(held) >= shingle:
            yield [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(held[i:] for i in range(shingle)), strict=False)]
            held, short = held[len(held) - shingle + 1:], False
    if short and held:
        yield [xxh64_intdigest(b" ".join(held), SEED)]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut at white space into pieces of about a megabyte."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end]
        at = end


def link_groups(prints: DataFrame, column: str = "simhash", bits: int = BITS) -> DataFrame:
    """``column, root``: every fingerprint that has a link, and the smallest one it is connected to."""
    ship_package(prints.sparkSession)
    spans = combinations(range(8), 8 - bits)
    value = F.col(column)
    entries = [
        F.struct(F.lit(i).cast("byte").alias("positions"), value.bitwiseAND(F.lit(_mask(chosen))).alias("shared"))
        for i, chosen in enumerate(spans)
    ]
    lists = prints.select(column).where(value.isNotNull()).distinct().select(column, F.inline(F.array(*entries)))
    lists = lists.repartition("positions", "shared").sortWithinPartitions("positions", "shared")
    edges = lists.mapInArrow(_forest(column, bits), "left bigint, right bigint")
    return connected_components(edges, "left", "right").select(F.col("node").alias(column), F.col("component").alias("root"))


def _mask(chosen: tuple[int, ...]) -> int:
    """The bits of the chosen bytes, as a signed 64-bit number."""
    return int(np.array(sum(0xFF << (8 * i) for i in chosen), dtype=np.uint64).view(np.int64))


def _forest(column: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, starts in _lists(batches, column):
            ends = np.append(starts[1:], len(values))
            pairs = starts[ends - starts == 2]
            near = pairs[np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= bits]
            found = [(values[near], values[near + 1])]
            long = ends - starts > 2
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                found.append(spanning_links(np.sort(values[a:b]), bits))
            left, right = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
            yield pa.record_batch([pa.array(left), pa.array(right)], ["left", "right"])

    return run


def _lists(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole lists: their fingerprints and where each list starts.  The open last list is carried on."""
    held = None
    for batch in batches:
        part = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (column, "positions", "shared")])
        part = part if held is None else np.concatenate([held, part], axis=1)
        new = np.flatnonzero((part[1:, 1:] != part[1:, :-1]).any(axis=0)) + 1
        last = new[-1] if len(new) else 0
        held = part[:, last:]
        if last:
            yield part[0, :last].view(np.uint64), np.append(0, new[:-1])
    if held is not None and held.shape[1]:
        yield np.ascontiguousarray(held[0]).view(np.uint64), np.zeros(1, dtype=np.int64)


def spanning_links(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distances of at most ``bits`` connect among ascending distinct fingerprints.

    Breadth first: from a group's frontier to every value not reached yet.  Short lists measure all their
    distances; in long ones, whose values share all but ``bits`` bytes, a value's neighbours are looked up.
    """
    left = np.arange(len(values))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    find = _by_distance if len(values) <= PAIRWISE else _by_flips
    flips = None if len(values) <= PAIRWISE else _flips(values, bits)
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            hit, source = find(values, frontier, left, bits, flips)
            out.append((values[source], values[left[hit]]))
            frontier, left = left[hit], left[~hit]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _by_distance(values, frontier, left, bits, _):
    """Which of ``left`` a frontier value reaches, and for those, one such value."""
    hit, source = np.zeros(len(left), dtype=bool), np.zeros(len(left), dtype=np.int64)
    for at in range(0, len(frontier), 256):
        some = frontier[at:at + 256]
        near = np.bitwise_count(values[left][:, None] ^ values[some][None, :]) <= bits
        new = near.any(axis=1) & ~hit
        source[new] = some[near[new].argmax(axis=1)]
        hit |= new
    return hit, source[hit]


def _by_flips(values, frontier, left, bits, flips):
    """As ``_by_distance``, by looking every neighbour of a frontier value up among the sorted values."""
    source = np.full(len(values), -1, dtype=np.int64)
    for at in range(0, len(frontier), 256):
        some = frontier[at:at + 256]
        near = (values[some][:, None] ^ flips[None, :]).ravel()
        place = np.minimum(np.searchsorted(values, near), len(values) - 1)
        found = values[place] == near
        source[place[found]] = np.repeat(some, len(flips))[found]
    hit = source[left] >= 0
    return hit, source[left[hit]]


def _flips(values: np.ndarray, bits: int) -> np.ndarray:
    """All changes of up to ``bits`` of the bits in which the values differ at all."""
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    places = [i for i in range(64) if varying >> i & 1]
    return np.array([sum(1 << i for i in some) for n in range(1, bits + 1) for some in combinations(places, n)], dtype=np.uint64)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``key, simhash, component_id``: one row per row of ``docs``.

    Documents link if their fingerprints differ in at most ``bits`` bits; ``component_id`` is the smallest
    ``key`` a document is connected to, itself included.  Null and empty texts have fingerprint 0 and link
    like any other; repeated rows come back as often; rows with a null key get the smallest non-null key
    of their group, or null.
    """
    prints, groups = _grouped(docs, key, text, shingle, bits)
    return prints.join(groups, "simhash").select(key, "simhash", F.col("least.key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of every group of near duplicates: the smallest key, then the smallest text hash.

    Rows with a null key come last, and rows equal in key and text count as one, whichever stays.
    """
    _, groups = _grouped(docs, key, text, shingle, bits)
    kept = written(groups.select(F.col("least.hash").alias("__row"), F.col("least.check").alias("__check")).distinct(), "simhash-kept")
    # two hashes, 96 bits, stand for key and text: one exchange of the texts serves the join and the removal of repeats
    hashed = docs.withColumns({"__row": row_key(key, text), "__check": F.hash(F.col(key), F.col(text))})
    same = ["__row", "__check"]
    return hashed.join(kept, same, "left_semi").dropDuplicates(same).select(*(F.col(f"`{c}`") for c in docs.columns))


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Every row's key, hash and fingerprint; and for every fingerprint the first row of its group."""
    named = docs.select(F.col(key), F.col(text).alias("__text"), row_key(key, text).alias("hash"), F.hash(F.col(key), F.col(text)).alias("check"))
    prints = written(fingerprints(named, "__text", shingle).select(key, "hash", "check", "simhash"), "simhash")
    row = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "hash", "check")
    first = cut_lineage(prints.groupBy("simhash").agg(F.min(row).alias("least")))
    roots = link_groups(first, "simhash", bits)
    rooted = cut_lineage(first.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash")))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    # checkpointed: a fingerprint of very many copies then meets two plain sides that Spark can split
    return prints, cut_lineage(rooted.drop("least").join(least, "root").select("simhash", "least"))
