import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillmine.llm import simhash
from quillmine.llm.components import connected_components
from quillmine.llm.queries import op9_simhash_groups
from tests.llm.conftest import clashing


def brute_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace(
        "\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """(key, fingerprint) -> smallest key reachable over links of at most 3 bits, by comparing all pairs."""
    values = sorted({v for _, v in rows})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for key, v in rows:
        least[find(v)].append(key)
    return {v: min((k for k in least[find(v)] if k is not None), default=None) for v in values}


def unsigned(v):
    return v & 0xFFFFFFFFFFFFFFFF


def test_fingerprints(docs, texts):
    rows = simhash.fingerprints(clashing(docs, "simhash", "hash")).collect()
    assert Counter((r.doc_id, unsigned(r.simhash)) for r in rows) == Counter((i, brute_print(t)) for i, t in texts)


def test_long_texts_are_hashed_in_pieces(monkeypatch, texts):
    whole = [simhash.fingerprint(t) for _, t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t) for _, t in texts] == whole


def chained(seed, n):
    """Fingerprints in chains and clusters around few centres, and far ones."""
    draw, out = random.Random(seed), set()
    while len(out) < n:
        v = draw.getrandbits(64)
        for _ in range(draw.choice((1, 1, 5, 40))):
            out.add(v)
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                v ^= 1 << bit
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 3])
def test_groups_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIRWISE", limit)
    values = chained(1, 900)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "simhash bigint")
    got = {unsigned(r.simhash): r.root for r in simhash.link_groups(frame).collect()}
    want = brute_groups([(v, v) for v in values])
    assert {v: len({w for w in values if want[w] == want[v]}) for v in values} == {
        v: sum(got.get(w, w) == got.get(v, v) for w in values) for v in values}


def test_spanning_links_in_one_dense_list(monkeypatch):
    draw = random.Random(2)
    values = np.array(sorted({0xABCD << 40 | sum(1 << b for b in draw.sample(range(24), draw.randint(0, 5))) for _ in range(1500)}), dtype=np.uint64)
    want = brute_groups([(int(v), int(v)) for v in values])
    for limit in (10_000, 1):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        left, right = simhash.spanning_links(values)
        assert len(left) == len(values) - len(set(want.values()))
        assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in zip(left, right))


def rows_of(texts):
    return [(i, brute_print(t)) for i, t in texts]


def test_near_groups(docs, texts):
    want = brute_groups(rows_of(texts))
    got = simhash.near_groups(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, want[v]) for i, v in rows_of(texts))
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(docs, texts):
    want = brute_groups(rows_of(texts))
    got = simhash.keep_one(clashing(docs, "hash", "least", "simhash")).collect()
    assert Counter(r.doc_id for r in got) == Counter(set(want.values()))
    assert got[0].hash == "mine"


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(draw.randint(2000, 2300), draw.randint(2000, 2300)) for _ in range(150)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]] + [(5, 5), (7, None)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    root = {}
    for a, b in edges:
        if b is not None and a != b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            if root[a] is not root[b]:
                joined = root[a] | root[b]
                for v in joined:
                    root[v] = joined
    assert got == {v: min(members) for v, members in root.items()}
    assert connected_components(frame.limit(0), "a", "b").count() == 0


def test_query(spark, folder, texts):
    rows = rows_of([t for t in texts if t[0] is not None])
    want = brute_groups(rows)
    got = op9_simhash_groups(spark, folder).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, f"{v:016x}", want[v]) for i, v in rows)
