from quillmine.llm.components import _mark, connected_components


def test_the_mark_of_very_many_edges(spark):
    # 2^24 hashes of 40 bits pass a bigint in sum
    edges = spark.range(18_000_000).selectExpr("id + 1 AS u", "id AS v")
    count, low, high = _mark(edges)
    assert count == 18_000_000 and low > 2**63 and high > 0
    assert _mark(edges.where("u < 1000000")) != _mark(edges.where("u < 1000001"))


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_few_edges_leave_few_files(spark):
    # a step's tasks go by the edges, not by the partitions that exchanges are set to
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = connected_components(edges, "a", "b")
        # one task for the edges, and the exchange of the components themselves
        assert found.rdd.getNumPartitions() <= 1 + 64
        assert {r.node: r.component for r in found.collect()} == dict.fromkeys(range(41), 0)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
