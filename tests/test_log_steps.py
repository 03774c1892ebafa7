"""What the steps over the event log make of it: rows aren't multiplied, kept or sorted where that isn't needed."""

import pytest
from pyspark.sql import functions as F

from tracewright import catalog
from tracewright.operators import issues
from tracewright.sources import tables

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.ALL[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["actor_features", "imputed_features"])
def test_features_take_one_pass_without_an_expand(spark, name):
    text = plan(spark, name)
    assert "Expand" not in text and "InMemoryTableScan" not in text


@pytest.mark.parametrize("name", ["column_missingness", "issue_actor_counts", "role_sequences_with_noise"])
def test_a_log_that_is_read_once_is_not_kept(spark, name):
    assert "InMemoryTableScan" not in plan(spark, name)


def test_times_and_counts_of_issues_need_no_sorted_aggregate(spark):
    rows = spark.createDataFrame([("i", "a", "p", "2020-01-01 00:00:00")], "issue_id string, actor_id string, project_name string, ts string")
    zero = {c: F.lit(0) for c in ("files_changed", "lines_added", "lines_deleted")}
    events = rows.withColumns({"ts": F.col("ts").cast("timestamp"), "event_id": F.lit("e"), "source": F.lit("commit"), "event_type": F.lit("commit_authored"), "lifecycle_stage": F.lit("fix"), "commit_id": F.lit("c"), **zero})
    sets = spark.createDataFrame([("i", "p", "x", 1)], "issue_id string, project_name string, role_set_without_noise string, n_actors int")
    out = issues.lifecycle_metrics(events, sets)
    assert out.columns[:2] == ["issue_id", "project_name"] and out.first()["n_commits"] == 1
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_shares_of_tasks_do_not_grow_with_the_tables(spark, monkeypatch):
    df = tables.table(spark, DATA, "lineitem")
    monkeypatch.setattr(tables, "SHARE_BYTES", 4_000)
    assert tables.spread(df, "l_orderkey").rdd.getNumPartitions() > 20


def test_roles_by_expression_are_those_of_the_dimension(spark):
    events = tables.lifecycle_events(spark, DATA).select("actor_id").distinct()
    joined = events.join(tables.role_dimension(events), "actor_id", "left")
    direct = events.withColumns(tables.role_columns(F.col("actor_id")))
    assert sorted(map(str, joined.collect())) == sorted(map(str, direct.collect()))


def test_the_join_of_lines_takes_more_tasks_of_larger_tables(spark, monkeypatch):
    want = tables.lifecycle_events(spark, DATA).groupBy("event_type").count().orderBy("event_type").collect()
    monkeypatch.setattr(tables, "SHARE_BYTES", 4_000)
    events = tables.lifecycle_events(spark, DATA)
    assert "REPARTITION_BY_NUM" in events._jdf.queryExecution().executedPlan().toString()
    assert events.groupBy("event_type").count().orderBy("event_type").collect() == want
