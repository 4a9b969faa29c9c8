import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmine.llm import packing
from quillmine.llm.queries import op10_best_fit_packing, vocabulary
from tests.llm.conftest import clashing


def check(rows, lengths, sizes):
    """Every token of every document exactly once; bins hold what they can, without overlap, and no smaller size would do."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        if r.n_tokens:
            bins[r.bin_id, r.bin_size].append((r.bin_offset, r.n_tokens))
        else:
            assert r.bin_id is None
    for key, copies in Counter(i for i, _ in lengths).items():
        total = max(next(n for i, n in lengths if i == key) or 0, 0)
        got = Counter(pieces[key])
        assert set(got.values()) == {copies}
        at = 0
        for start, n in sorted(got):
            assert start == at
            at += n
        assert at == total
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert size == min(s for s in sizes if s >= at)
    return bins


def brute(counts, sizes):
    """The same rule, piece by piece and bin by bin: how many bins of each size."""
    left, out = Counter(counts), Counter()
    while +left:
        best = None
        for size in sizes:
            if size < max(+left):
                continue
            have, space, held = Counter(left), size, 0
            while fits := [n for n in +have if n <= space]:
                n = max(fits)
                have[n] -= 1
                space -= n
                held += n
            shrunk = min(s for s in sizes if s >= held)
            rank = (sizes[shrunk] / held, -held)
            if best is None or rank < best[0]:
                best = (rank, shrunk, left - have)
        while all(left[n] >= each for n, each in best[2].items()):  # the same bin as long as there are pieces for it
            out[best[1]] += 1
            left -= best[2]
    return out


SIZES = {8: 9.0, 16: 17.0, 32: 33.0}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=12))
def test_plan_equals_packing_bin_by_bin(counts):
    table = packing.plan(counts, SIZES)
    bins = {}
    for r in table.itertuples():
        stop = min((s.rank for s in table.itertuples() if s.length == r.length and s.rank > r.rank), default=counts[r.length])
        for b in range((stop - r.rank) // r.each):
            bins[r.bin + b] = r.size
    assert Counter(bins.values()) == brute(counts, SIZES)


def test_operator_on_ties_hot_lengths_and_odd_rows(spark):
    draw = random.Random(3)
    lengths = [(i, 20 if i % 3 == 0 else draw.randint(1, 90)) for i in range(900)] + [(5000, None), (5001, 0), (5002, -4), (5003, 10_000)]
    lengths += [(7, lengths[7][1])] * 2
    frame = clashing(spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint"), "rank", "piece", "block", "bin_id")
    rows = packing.pack(frame, sizes=SIZES).collect()
    bins = check(rows, lengths, SIZES)
    # a third of the pieces are 20 long and leave gaps of 12, more than there are short pieces for
    assert sum(size for _, size in bins) < 1.1 * sum(max(n or 0, 0) for _, n in lengths)
    assert packing.pack(frame.limit(0), sizes=SIZES).count() == 0


def test_ranks_number_each_group_once(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 = 0 AS g")
    got = packing.ranked(rows, "g", ("id",), largest=700, block_rows=10).collect()
    for g, n in ((True, 334), (False, 666)):
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(n))


def test_sequences_hold_the_words(spark, docs):
    texts = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("n_tokens", packing.words())
    packed = packing.pack(texts, sizes={64: 70.0, 256: 260.0})
    parts = defaultdict(dict)
    for r in packing.sequences(texts, packed).collect():
        assert sum(len(p.split(" ")) for p in r.texts) <= r.bin_size
        for key, part in zip(r["keys"], r.texts):
            parts[key].setdefault("all", []).append(part)
    for r in texts.collect():
        words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", r.text or "") if w]
        got = [w for p in parts[r.doc_id].get("all", []) for w in p.split(" ")]
        assert Counter(got) == Counter(words)


def test_query(spark, folder, texts):
    """Lengths are the library's counts: a text without a space is as long as its tokens, and no bin holds more than its size."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    lengths = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts if i is not None]
    assert any(n > 512 and " " not in t for (_, t), (_, n) in zip([r for r in texts if r[0] is not None], lengths) if t)
    check(op10_best_fit_packing(spark, folder).collect(), lengths, packing.SIZES)
