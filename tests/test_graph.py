import pytest

from leadtime.operators.graph import arriving, bucketed, flow_edges, flow_vertices, pagerank


def reference_ranks(flows, rounds=10):
    """The definition, on plain dicts."""
    ids = {s for s, _ in flows}
    inside = [(s, d) for s, d in flows if d in ids]
    out = {s: sum(1 for a, _ in inside if a == s) for s in ids}
    ranks = dict.fromkeys(ids, 1.0)
    for _ in range(rounds):
        gain = dict.fromkeys(ids, 0.0)
        for s, d in inside:
            gain[d] += ranks[s] / out[s]
        ranks = {i: 0.15 + 0.85 * gain[i] for i in ids}
    scale = len(ids) / sum(ranks.values())
    return {i: r * scale for i, r in ranks.items()}


# A repeated edge, a loop, a place that is only a destination, one whose only way leads there.
FLOWS = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "a"), ("c", "a"), ("d", "x"), ("b", "d")]


@pytest.mark.parametrize("rounds", [1, 10])
def test_ranks(spark, rounds):
    df = spark.createDataFrame(FLOWS + [(None, "a"), ("a", None)], "o string, d string")
    edges = flow_edges(df, "o", "d")
    assert {(r.src, r.dst): r.weight for r in edges.collect()}[("a", "b")] == 2
    vertices = flow_vertices(df.where("o is not null and d is not null"), "o")
    expected = reference_ranks(FLOWS, rounds)
    for given in (vertices, None):
        got = {r.id: r.pagerank for r in pagerank(edges, given, iterations=rounds).collect()}
        assert got == pytest.approx(expected, abs=1e-12)
    assert sum(expected.values()) == pytest.approx(4)


@pytest.mark.parametrize("rounds,hub_links", [(3, 2), (0, 1), (12, 1)])
def test_ranks_with_hubs_in_slices(spark, rounds, hub_links):
    flows = FLOWS + [("a", f"p{i}") for i in range(40)] + [(f"p{i}", "a") for i in range(40)]
    got = {r.id: r.pagerank for r in pagerank(flow_edges(spark.createDataFrame(flows, "o string, d string"), "o", "d"), iterations=rounds, hub_links=hub_links).collect()}
    assert got == pytest.approx(reference_ranks(flows, rounds), abs=1e-12)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("leadtime_")]


def test_links_stay_where_they_are(spark):
    """In a round the ranks are shuffled and the gains, the links are read from their buckets."""
    links = spark.range(5000).selectExpr("id % 100 AS src", "cast(id % 2 as int) AS slice", "id % 70 AS dst", "0.5D AS share")
    ranks = spark.range(100).selectExpr("id", "2 AS slices", "1.0D AS rank")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(links, ["src", "slice"]) as held:
            gains = arriving(held, ranks)
            assert gains.count() == 70
            plan = gains._jdf.queryExecution().executedPlan().toString()
            shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert len(shuffles) == 2 and not any("src" in line for line in shuffles) and "SortMergeJoin" in plan
            assert "Bucketed: true" in gains._sc._jvm.PythonSQLUtils.explainString(gains._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
