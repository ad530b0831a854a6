"""The shape of plans: what is pushed down, pruned and joined how."""

from concordia.plans.shapes import nodes, pushed_filters, read_columns
from concordia.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_search_is_one_scan_and_a_top_k(spark):
    plan = nodes(QUERIES["search_ranked"](spark, FOLDER))
    assert plan["TakeOrderedAndProject"] == 1 and not plan["Exchange"] and not plan["SortMergeJoin"]


def test_scans_are_pruned_and_filters_pushed(spark):
    got = QUERIES["top_k_per_query"](spark, FOLDER)
    assert {"l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"} == read_columns(got)[0]
    assert any("GreaterThanOrEqual(l_extendedprice" in f for f in pushed_filters(got))


def test_groups_are_limited_before_the_shuffle(spark):
    assert nodes(QUERIES["top_k_per_query"](spark, FOLDER))["WindowGroupLimit"] >= 1


def test_no_nested_loops(spark):
    for name in ("join_interval", "join_as_of", "join_containment", "join_anti_unread", "group_match", "join_theta_regex", "join_point_in_span"):
        plan = nodes(QUERIES[name](spark, FOLDER))
        assert not plan["BroadcastNestedLoopJoin"] and not plan["CartesianProduct"], name


def test_streams(spark, tmp_path):
    from concordia.streaming import jobs

    source = tmp_path / "in"
    spark.createDataFrame([("a" * 600, "p", "t"), (" ", "p", "t")], "question string, page string, at string").write.parquet(str(source))
    stream = spark.readStream.schema("question string, page string, at string").parquet(str(source))
    jobs.append_log(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert [len(r.question) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [500]
    (tmp_path / "requests").mkdir()
    (tmp_path / "requests" / "one.txt").write_text('{"id": "1", "method": "n", "params": {"k": "3"}}\nnot json\n{"id": "2", "method": "other"}\n')
    seen = []
    tools = {"n": lambda s, p: s.range(int(p["k"]))}
    jobs.serve(spark.readStream.text(str(tmp_path / "requests")), tools, lambda i, df, error: seen.append((i, df.count() if df else None, error)), str(tmp_path / "served")).awaitTermination()
    assert sorted(seen, key=str) == sorted([("1", 3, None), (None, None, "not a request: not json"), ("2", None, "unknown tool other")], key=str)


def test_small_tables_are_spread_and_large_ones_not(spark):
    from concordia.sources.corpus import spread

    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10).repartition(64)
    assert spread(many) is many


def test_links_meet_by_equality(spark):
    plan = nodes(QUERIES["link_candidates"](spark, FOLDER))
    assert not plan["BroadcastNestedLoopJoin"] and not plan["CartesianProduct"]
