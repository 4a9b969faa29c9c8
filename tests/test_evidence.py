"""Evidence of issues, and how tables that it reads are dealt."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillmine.operators import evidence as ev
from quillmine.sources.tables import read_table

ISSUE = "response_id long, issue_index long, title string, evidence string, risk string, suggestion string, severity string"
BLOCK = "response_id long, block_index long, text string"


def given(spark):
    issues = [
        (1, 1, "Check the depot", "the red boxes are stored in the depot", "late", "more boxes", "high"),
        (1, 2, "Check the large depot boxes", "orders leaving quickly", "orders may leave the depot late", "check boxes", "low"),
        (2, 1, "Nothing", None, None, None, "medium"),
    ]
    blocks = [(1, 1, "News: the  RED boxes are stored in the depot."), (1, 2, "Orders leave the large depot with boxes late today."), (2, 1, "Unrelated words of the day.")]
    return spark.createDataFrame(issues, ISSUE), spark.createDataFrame(blocks, BLOCK)


def test_matches_without_a_broadcast(spark):
    """Both sides of every join grow with the responses, however small an estimate is."""
    issues, blocks = given(spark)
    found = ev.candidates(issues)
    assert [r.candidate for r in found.where("response_id = 1 AND issue_index = 1").orderBy("candidate_rank").collect()] == [
        "Check the depot. the red boxes are stored in the depot", "the red boxes are stored in the depot", "Check the depot"]
    matched = ev.evidence_matches(issues, blocks)
    assert sorted(map(tuple, matched.collect())) == [(1, 1, 1, "exact"), (1, 2, 2, "fuzzy")]
    summary = ev.evidence_summary(issues, matched)
    assert sorted(map(tuple, summary.collect())) == [(1, 2, 2, 1, 0, 1), (2, 1, 0, 0, 0, 0)]
    for df in (ev.exact_matches(found, blocks), ev.fuzzy_matches(issues, blocks), matched, summary):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_a_table_in_few_row_groups_is_dealt(spark, tmp_path):
    """A file in many splits whose rows all lie in one row group, and so in one task."""
    one, even, none = (str(tmp_path / n) for n in ("one.parquet", "even.parquet", "none.parquet"))
    n = 50_000
    pq.write_table(pa.table({"a": list(range(n))}), one, row_group_size=n)
    spark.range(n).repartition(16).write.parquet(even)
    spark.range(0).write.parquet(none)
    cores, limit = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # the file is cut into many splits, its only row group lies in one of them
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert spark.read.parquet(one).rdd.getNumPartitions() > 1
        dealt = read_table(spark, one)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) >= cores and max(sizes) <= 2 * n / cores
        assert dealt.agg(F.sum("a")).first()[0] == n * (n - 1) // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert "Exchange" not in read_table(spark, even)._jdf.queryExecution().executedPlan().toString()
    assert read_table(spark, none).count() == 0
