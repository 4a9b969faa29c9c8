import re
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from quillmine import rules
from quillmine.functions import text as tx
from quillmine.operators import retrieve as rt
from quillmine.operators.chunks import hashed_counts
from quillmine.operators import responses as rs
from quillmine.plans.answer import answer_questions, extend_corpus, extend_index, search_corpus, search_rows, search_stored
from quillmine.session import CLEANUP_CONF, cut_lineage

PAGES = [
    ("https://w.example.org/overview", "Billing overview", "confluence", "# Billing overview\n\nThe billing area serves shops and partners with invoices and reminders."),
    ("https://w.example.org/deploy", "Deployment spec", "confluence", "# Deployment spec\n\nThe validation step has a timeout of 30 seconds. It makes two more tries when that fails."),
    ("https://w.example.org/qa", "QA notes", "generic", "# QA notes\n\nTesters look at invoices with odd amounts and at reminders sent twice in a row."),
    ("https://w.example.org/runbook", "Ops runbook", "generic", "# Ops runbook\n\nOperators expect the validation timeout to be 45 seconds. They make three more tries."),
    ("https://W.example.org//runbook/?v=2", "Ops runbook copy", "generic", "Copy of the runbook with other words."),
]


@pytest.mark.parametrize("encoder", [None, hashed_counts])
def test_one_conflict_end_to_end(spark, encoder):
    pages = spark.createDataFrame(PAGES, "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "What is the validation timeout?", "answer"), (2, "zzz", "critique")], "query_id long, question string, mode string")
    basket = spark.createDataFrame(
        [(q, p[0], i, "default") for q in (1, 2) for i, p in enumerate(PAGES)], "query_id long, page_url string, original_index int, context_role string"
    )
    result = answer_questions(questions, basket, pages, encoder_factory=encoder)
    clash = result.conflicts.filter("query_id = 1").collect()
    assert len(clash) == 1 and clash[0].topic == "Timeout"
    assert {clash[0].source_a_title, clash[0].source_b_title} == {"Deployment spec", "Ops runbook"}
    assert "30 seconds" in clash[0].summary and "45 seconds" in clash[0].summary
    stats = {r.query_id: r for r in result.stats.collect()}
    dedup = {r.query_id: r for r in result.dedup.collect()}
    assert dedup[1].deduped_by_url == 1 and dedup[1].prepared_pages == 4
    assert stats[1].retrieval_strategy == ("dense+hybrid" if encoder else "lexical-fallback")
    if encoder is None:
        assert stats[2].retrieval_no_match_fallback_used
        low = {r.query_id: r for r in result.confidence.collect()}
        assert low[2].low_confidence and low[2].confidence_next_step.startswith("Pin acceptance criteria")
    records = {r.query_id: r for r in result.records().collect()}
    assert len(records[1].citations) == stats[1].selected_pages
    assert records[1].conflicts[0].topic == "Timeout"


def test_oversized_requests_are_rejected_not_cut(spark):
    pages = spark.createDataFrame(PAGES, "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "validation timeout", "answer"), (2, "validation timeout", "answer")], "query_id long, question string, mode string")
    rows = [(1, PAGES[i % 5][0], i, "default") for i in range(21)] + [(2, PAGES[1][0], 0, "default")]
    basket = spark.createDataFrame(rows, "query_id long, page_url string, original_index int, context_role string")
    result = answer_questions(questions, basket, pages, max_pages=rules.MAX_PAGES_PER_REQUEST)
    assert [r.query_id for r in result.rejected.collect()] == [1]
    assert [r.query_id for r in result.stats.collect()] == [2]


def test_large_baskets_and_policies_come_out_whole(spark):
    """60 pages are no request above a limit, and a policy of 50 candidates gives 50."""
    pages = spark.createDataFrame(
        [(f"u{i:02d}", f"Page {i}", "generic", f"validation timeout number {i}") for i in range(60)],
        "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "validation timeout", "answer")], "query_id long, question string, mode string")
    basket = spark.createDataFrame([(1, f"u{i:02d}", i, "default") for i in range(60)], "query_id long, page_url string, original_index int, context_role string")
    policies = {name: values | {"max_candidates": 50} for name, values in rules.BUDGET_POLICIES.items()}
    result = answer_questions(questions, basket, pages, policies=policies)
    assert result.rejected.count() == 0
    assert result.candidates.count() == 50
    assert result.dedup.first().prepared_pages == 60


def test_a_pair_model_reads_questions_and_chunks(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "validation timeout invoices reminders", "answer")], "query_id long, question string, mode string")
    basket = spark.createDataFrame([(1, p[0], i, "default") for i, p in enumerate(PAGES[:4])], "query_id long, page_url string, original_index int, context_role string")

    def likes_testers(question, text):
        assert (question == "validation timeout invoices reminders").all()
        return text.str.contains("Testers look").astype(float) * 8 - 4

    result = answer_questions(questions, basket, pages, pair_model=likes_testers)
    first = result.filtered.filter("rank = 1").first()
    assert first.page_url.endswith("/qa")


def test_response_json_edges(spark):
    texts = ['```json\n[1]\n``` {"a": 1}', 'x {"a": {"b": 1}} y', "{'a': 1}", "", '{"a": 1} trailing }']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", rs.json_object(df.t)).sort("i").collect()]
    assert got == [None, '{"a": {"b": 1}}', None, None, None]


def test_corpus_search_uses_headings_and_drops_copies(spark):
    rows = [
        ("u1", "Notes", "generic", "# Validation timeout\n\nAll about waiting."),
        ("u2", "Notes", "generic", "All about waiting for the validation here."),
        ("u3", "Notes", "generic", "all about   waiting for the validation here. "),
    ]
    pages = spark.createDataFrame(rows, "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "validation timeout")], "query_id long, question string")
    got = search_corpus(questions, pages).sort("rank").collect()
    assert [(r.page_url, r.citation) for r in got] == [("u1", 1), ("u2", 2)]
    # chunk 2/2, heading 2/2; hybrid: base 0.72, chunk 0.20
    assert abs(got[0].score - ((0.7 + 0.1) * 0.72 + 0.20)) < 1e-9
    assert abs(got[1].score - (0.35 * 0.72 + 0.10)) < 1e-9


def test_a_stored_corpus_grows_by_new_texts_only(spark, tmp_path):
    schema = "page_url string, title string, source_type string, markdown string"
    first = spark.createDataFrame([("u1", "Notes", "generic", "Validation timeout."), ("u2", "Notes", "generic", "Other words.")], schema)
    more = spark.createDataFrame([("u0", "Notes", "generic", "validation   timeout."), ("u3", "Notes", "generic", "A timeout alone.")], schema)
    questions = spark.createDataFrame([(1, "validation timeout")], "query_id long, question string")
    path = str(tmp_path / "corpus")
    assert extend_corpus(first, path).count() == 2
    rows = extend_corpus(first.unionByName(more), path)
    assert sorted(r.page_url for r in rows.collect()) == ["u1", "u2", "u3"]
    want = search_corpus(questions, first.unionByName(more.filter("page_url = 'u3'")))
    assert search_rows(questions, rows).collect() == want.collect()


def test_a_stored_index_finds_what_its_rows_do(spark, tmp_path):
    schema = "page_url string, title string, source_type string, markdown string"
    first = spark.createDataFrame([("u1", "Notes", "generic", "Validation timeout."), ("u2", "Notes", "generic", "Other words.")], schema)
    more = spark.createDataFrame([("u0", "Notes", "generic", "validation   timeout."), ("u3", "Notes", "generic", "A timeout alone.")], schema)
    questions = spark.createDataFrame([(1, "validation timeout"), (2, "other notes")], "query_id long, question string")
    path = str(tmp_path / "index")
    extend_index(first, path)
    index = extend_index(first.unionByName(more), path)
    again = extend_index(first.unionByName(more), path)
    assert index.filter("term IS NULL").selectExpr("explode(urls)").count() == 3
    want = sorted(map(tuple, search_corpus(questions, first.unionByName(more.filter("page_url = 'u3'"))).collect()))
    assert sorted(map(tuple, search_stored(questions, again).collect())) == want and want


def test_chunks_keep_the_terms_that_their_questions_ask_for(spark, monkeypatch):
    """Overlaps are the same as over all terms, for pages with few question terms and with many."""
    schema = "query_id long, question string"
    questions = spark.createDataFrame([(1, "The billing TIMEOUT, a/b-c?"), (2, None), (3, "?"), (4, "w1 ww2 ww3 ww4 billing"), (4, "twice asked")], schema)
    shares = [("u1", 1), ("u1", 4), ("u2", 2), ("u2", 3), ("u3", 4), ("u1", 1), ("u4", 1)]
    profiles = spark.createDataFrame([(q, u, i, 0.5, 0.0) for i, (u, q) in enumerate(shares)],
                                     "query_id long, page_url string, original_index int, title_overlap double, heading_overlap double")
    found = {r.page_url: r.asked for r in rt.asked_terms(questions, profiles, 4).collect()}
    assert found["u1"] is None and found["u3"] is None and found["u2"] == ""
    assert sorted(found["u4"].split(" ")) == ["a/b-c", "billing", "timeout"]
    texts = [("u1", 0, "billing timeout ww2 more"), ("u2", 0, "billing"), ("u3", 0, "asked ww3 x"), ("u4", 0, "Timeout of a/b-c more words"), ("u4", 1, "none")]
    chunks = spark.createDataFrame(texts, "page_url string, chunk_index long, text string")
    kept = chunks.join(rt.asked_terms(questions, profiles, 4), "page_url").select("page_url", "chunk_index", rt.kept_terms(F.col("text"), F.col("asked")).alias("chunk_terms"))
    assert {(r.page_url, r.chunk_index): r.chunk_terms for r in kept.collect()} == {
        ("u1", 0): ["billing", "timeout", "ww2", "more"], ("u2", 0): [], ("u3", 0): ["asked", "ww3"], ("u4", 0): ["timeout", "a/b-c"], ("u4", 1): []}
    want = rt.score_pairs(questions, profiles, chunks.select("page_url", "chunk_index", tx.token_set(F.col("text")).alias("chunk_terms")))
    assert sorted(map(str, rt.score_pairs(questions, profiles, kept).collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(rt, "ASKED_BY", 1)
    assert {r.page_url: r.asked for r in rt.asked_terms(questions, profiles).collect() if r.page_url != "u4"} == dict.fromkeys(["u1", "u2", "u3"])


def test_an_answer_is_the_same_over_all_terms(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_url string, title string, source_type string, markdown string").withColumn("asked", F.lit("the caller's"))
    questions = spark.createDataFrame([(1, "What is the validation timeout?", "answer"), (2, "zzz", "critique")], "query_id long, question string, mode string")
    basket = spark.createDataFrame(
        [(q, p[0], i, "default") for q in (1, 2) for i, p in enumerate(PAGES)], "query_id long, page_url string, original_index int, context_role string")

    def run():
        result = answer_questions(questions, basket, pages)
        return [sorted(str(r.asDict()) for r in frame.collect()) for frame in (result.candidates, result.final, result.stats, result.context)]

    few = run()
    monkeypatch.setattr(rt, "asked_terms", partial(rt.asked_terms, most=0))
    assert run() == few


def test_terms_end_where_the_overlaps_are_known(spark):
    """The join with the profiles moves numbers, not term sets."""
    questions = spark.createDataFrame([(1, "validation timeout")], "query_id long, question string")
    profiles = spark.createDataFrame([(1, "u1", 0.5, 0.0)], "query_id long, page_url string, title_overlap double, heading_overlap double")
    found = spark.createDataFrame([(1, "u1", 0, 0.4, 1)], "query_id long, page_url string, chunk_index long, score double, rank int")
    terms = spark.createDataFrame([("u1", 0, ["timeout", "more"])], "page_url string, chunk_index long, chunk_terms array<string>")
    out = rt.with_overlaps(found, questions, profiles, terms)
    assert out.first().asDict() == {"query_id": 1, "page_url": "u1", "chunk_index": 0, "score": 0.4, "rank": 1, "chunk_overlap": 0.5, "has_terms": True,
                                    "title_overlap": 0.5, "heading_overlap": 0.0}
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "LeftOuter" in str(plan.joinType()) and not re.search("(query|chunk)_terms", plan.output().mkString(" "))


def test_no_shuffle_file_outlives_its_checkpoint(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(CLEANUP_CONF)
    held = spark.range(1000).repartition(5).groupBy((F.col("id") % 10).alias("k")).count()
    cut = cut_lineage(held)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert cut.count() == held.count() == 10
    assert spark.conf.get(CLEANUP_CONF) == setting


def test_statistics_are_made_once(spark):
    """Readers of the statistics and of the confidence find rows, not the joins that make them."""
    pages = spark.createDataFrame(PAGES[:2], "page_url string, title string, source_type string, markdown string")
    questions = spark.createDataFrame([(1, "validation timeout", "answer")], "query_id long, question string, mode string")
    basket = spark.createDataFrame([(1, p[0], i, "default") for i, p in enumerate(PAGES[:2])], "query_id long, page_url string, original_index int, context_role string")
    result = answer_questions(questions, basket, pages)
    joins = [str(frame._jdf.queryExecution().analyzed().toString()).count("Join ") for frame in (result.stats, result.confidence)]
    assert joins == [0, 1] and result.stats.first().retrieved_chunks
