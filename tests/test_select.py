import random

from quillmine.operators import select as sl
from quillmine.operators.dedup import dedup_basket, dedup_rounds


def plain_select(rows, chunk_cap, budget):
    """The walk as a loop: rows in rank order."""
    taken, later, used = [], [], 0

    def fits(row, page_cap):
        return (
            (chunk_cap is None or len(taken) < chunk_cap)
            and sum(t["page_url"] == row["page_url"] for t in taken) < page_cap
            and (row["source_cap"] is None or sum(t["source_type"] == row["source_type"] for t in taken) < row["source_cap"])
            and used + row["tokens"] <= budget
        )

    for row in rows:
        if not taken or fits(row, 1):
            taken.append(row)
            used += row["tokens"]
        else:
            later.append(row)
    for row in later:
        if fits(row, row["page_cap"]):
            taken.append(row)
            used += row["tokens"]
    return [r["rank"] for r in taken]


def test_fold_equals_loop(spark):
    rng = random.Random(3)
    data, want = [], {}
    for query in range(150):
        n = rng.randint(1, 20)
        cap, budget = rng.choice([None, 3, 5, 8]), rng.choice([300, 900, 5000])
        pages = {f"p{i}": (rng.choice("abc"), rng.randint(1, 4)) for i in range(rng.randint(1, 6))}
        sources = {s: rng.choice([None, 1, 2, 3]) for s in "abc"}
        rows = []
        for rank in range(1, n + 1):
            page = rng.choice(list(pages))
            kind, page_cap = pages[page]
            rows.append(dict(query_id=query, rank=rank, page_url=page, source_type=kind, tokens=rng.randint(1, 400),
                             page_cap=page_cap, source_cap=sources[kind], max_total_chunks=cap, max_input_tokens=budget))
        data += rows
        want[query] = plain_select(rows, cap, budget)
    schema = ("query_id long, rank int, page_url string, source_type string, tokens long, page_cap int, "
              "source_cap int, max_total_chunks int, max_input_tokens long")
    got: dict[int, list] = {}
    for r in sl.select_budget(spark.createDataFrame(data, schema)).sort("query_id", "select_rank").collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert got == want


def plain_dedup(rows):
    kept, urls, texts = [], set(), set()
    for row in sorted(rows, key=lambda r: (-r["priority"], -r["size_chars"], r["original_index"])):
        if (row["canonical_url"] and row["canonical_url"] in urls) or row["content_signature"] in texts:
            continue
        kept.append(row["page_id"])
        texts.add(row["content_signature"])
        urls.add(row["canonical_url"])
    return sorted(kept)


SCHEMA = ("query_id long, page_id long, page_url string, original_index int, priority double, size_chars long, "
          "canonical_url string, content_signature string")


def dedup_rows(rng, query, n, hot=0.0):
    return [
        dict(query_id=query, page_id=query * 1000 + i, page_url=f"u{i}", original_index=i,
             priority=rng.choice([0.9, 1.0, 1.1]), size_chars=rng.randint(1, 50),
             canonical_url="hot" if rng.random() < hot else rng.choice(["", *[f"c{j}" for j in range(n // 3 + 1)]]),
             content_signature="same" if rng.random() < hot else f"s{rng.randint(0, n // 3)}")
        for i in range(n)
    ]


def test_both_dedupe_forms_equal_the_loop(spark):
    rng = random.Random(5)
    groups = [dedup_rows(rng, q, rng.randint(1, 20)) for q in range(60)]
    df = spark.createDataFrame([r for g in groups for r in g], SCHEMA)
    want = sorted(p for g in groups for p in plain_dedup(g))
    fold = dedup_basket(df).filter("outcome = 'kept'").select("page_id").collect()
    rounds = dedup_rounds(df, "query_id").select("page_id").collect()
    assert sorted(r[0] for r in fold) == want
    assert sorted(r[0] for r in rounds) == want


def test_rounds_on_one_skewed_group(spark):
    rows = dedup_rows(random.Random(9), 1, 900, hot=0.34)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r[0] for r in dedup_rounds(df).select("page_id").collect())
    assert got == plain_dedup(rows)


def test_a_dropped_page_does_not_register_its_text(spark):
    rows = [
        dict(query_id=1, page_id=i, page_url=u, original_index=i, priority=1.0, size_chars=9, canonical_url=u, content_signature=s)
        for i, (u, s) in enumerate([("u1", "t1"), ("u2", "t1"), ("u2", "t2")])
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[0] for r in dedup_rounds(df).select("page_id").collect()) == [0, 2]


def test_rounds_follow_a_long_chain_to_its_end(spark):
    # a chain where every round settles one link
    rows = [
        dict(query_id=1, page_id=i, page_url="x", original_index=i, priority=1.0, size_chars=9,
             canonical_url=f"u{(i + 1) // 2}", content_signature=f"t{i // 2}")
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[0] for r in dedup_rounds(df).select("page_id").collect()) == plain_dedup(rows)
