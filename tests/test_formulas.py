"""Published figures that need no private data, and rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import report
from tracewright.operators import actors, cluster, extract, issues, prep, quality, selection, stats
from tracewright.plans.model_queries import K_SWEEP, SWEEP_COLUMNS


def test_rank_sums_and_recommended_k(spark):
    rows = stats.recommend_k(stats.rank_k(spark.createDataFrame(K_SWEEP, SWEEP_COLUMNS))).orderBy("k").collect()
    assert [r["combined_rank_score"] for r in rows] == [29, 43, 39, 34, 28, 17, 17, 13, 22, 23, 19]
    assert [r["k"] for r in rows if r["recommended"]] == [9]


def test_selection_score_of_the_published_model(spark):
    df = spark.createDataFrame([(6, 0.42998, 0.3), (6, 0.43029984218832196, 0.3003682272488164), (0, 1.0, 0.0)], "n int, q double, l double")
    got = [r[0] for r in df.select(cluster.selection_score(F.col("n"), F.col("q"), F.col("l"))).collect()]
    assert got[1] == pytest.approx(3.8390320883745397, abs=1e-9) and got[2] == -10_000


def test_cramers_v_of_the_published_table(spark):
    df = spark.createDataFrame([(2478.64218, 8607, 9, 5)], "x double, n long, r long, c long")
    v, fixed = df.select(*stats.cramers_v(F.col("x"), F.col("n"), F.col("r"), F.col("c"))).first()
    assert v == pytest.approx(0.2683187, abs=1e-6) and fixed == pytest.approx(0.2666429, abs=1e-6)


def test_cluster_ratios(spark):
    sizes = {-1: 818, 0: 27, 1: 195, 2: 571, 3: 58, 4: 138, 5: 94}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "label int")
    table = {r["cluster_label"]: r["ratio"] for r in cluster.size_table(df).collect()}
    assert table[2] == pytest.approx(571 / 1901)
    m = cluster.size_metrics(df).first()
    assert (m["n_clusters"], m["noise_count"], m["largest_cluster_size"]) == (6, 818, 571) and m["median_cluster_size"] == 116


def test_stability_classes_and_recommendation(spark):
    rows = [(-1, 0.9, 0.0), (0, 0.5, 0.2), (1, 0.9, 0.1), (2, 0.65, 0.4), (3, 0.8, 0.6)]
    got = {r["label"]: r["stability"] for r in stats.stable_clusters(spark.createDataFrame(rows, "label int, dominant_fraction double, noise_fraction double")).collect()}
    assert got == {0: "unstable", 1: "stable", 2: "intermediate", 3: "unstable"}
    said = spark.range(1).select(stats.recommendation(F.lit(0.8654), F.lit(0.9958), F.lit(0.4364), F.lit(1))).first()[0]
    assert said.startswith("maintain_current")


def test_bot_rules(spark):
    rows = ["jenkins", "Robot7", "my-ci-x", "Cite", "github actions", "dependabot", None, " ", "BUILD"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = [r[0] for r in df.select(actors.bot_reason(actors.clean_id(F.col("raw")))).collect()]
    assert got == ["jenkins", "contains_bot", "ci", "", "github_actions", "contains_bot;dependabot", "", "", "build"]


def test_actor_ids_and_unknown_flags(spark):
    df = spark.createDataFrame([("e1", " b "), ("e2", "a"), ("e3", None), ("e4", ""), ("e5", "b")], "event_id string, actor_id_raw string")
    mapping = actors.actor_mapping(df)
    got = {r["event_id"]: (r["actor_id"], r["actor_unknown"]) for r in actors.normalize_actors(df, mapping).collect()}
    assert got == {"e1": ("actor_000002", False), "e2": ("actor_000001", False), "e3": (None, True), "e4": (None, True), "e5": ("actor_000002", False)}


def test_closed_bug_predicates_differ(spark):
    rows = [("Bug", "Closed", None), ("bug", "closed", None), (" Bug ", "Closed", None), ("Bug", "Open", ""), ("Bug", "Open", "Unresolved"), ("Bug", "Open", "Fixed"), ("Bug", None, " fixed "), ("Task", "Closed", "Fixed"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, s string, r string")
    c = [F.col(x) for x in "tsr"]
    got = [tuple(r) for r in df.select(extract.closed_bug_strict(*c), extract.closed_bug_loose(*c)).collect()]
    assert [g[0] for g in got] == [True, False, False, False, False, True, True, False, False]
    assert [g[1] for g in got] == [True, True, True, False, False, True, True, False, False]


def test_pull_request_and_field_events(spark):
    prs = spark.createDataFrame([(1, "open", 5, 6, None), (2, "CLOSED", 5, 6, None), (3, "closed", 5, 6, 7), (4, None, 5, 6, None)], "i int, state string, c int, u int, m int")
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in prs.select("i", extract.pull_request_events(F.col("state"), F.col("c"), F.col("u"), F.col("m")).alias("e")).collect()}
    assert got == {1: [("pr_opened", 5)], 2: [("pr_opened", 5), ("pr_closed", 6)], 3: [("pr_opened", 5), ("pr_merged", 7)], 4: [("pr_opened", 5)]}
    fields = spark.createDataFrame([("status", "Closed"), ("Status ", "resolved"), ("status", None), ("assignee_id", "x"), ("priority", "x"), ("RemoteIssueLink", "x"), (None, None)], "f string, v string")
    assert [r[0] for r in fields.select(extract.issue_event_type(F.col("f"), F.col("v"))).collect()] == ["issue_closed", "issue_resolved", "status_changed", "assignee_changed", "priority_changed", "issue_field_changed", "issue_field_changed"]


def test_compressed_sequences(spark):
    rows = [("i", 1, "a", "A"), ("i", 2, "b", "A"), ("i", 3, "c", "B"), ("i", 3, "d", "A"), ("j", 1, "e", "A"), ("k", 1, "f", None), ("k", 2, "g", "")]
    df = spark.createDataFrame(rows, "issue string, ts int, event string, role string")
    assert {r["issue"]: (r["role_sequence"], r["sequence_length"]) for r in issues.sequences(df, "issue", ["ts", "event"], "role").collect()} == {"i": ("A -> B -> A", 3), "j": ("A", 1)}
    assert {(r["from_role"], r["to_role"]): r["n_transitions"] for r in issues.transitions(df, "issue", ["ts", "event"], "role").collect()} == {("A", "B"): 1, ("B", "A"): 1}


def test_preparation_caps_and_constant_columns(spark):
    df = spark.createDataFrame([(f"a{i}", float(i), 5.0) for i in range(101)], "actor_id string, n_x double, ratio double")
    out = prep.standardized(prep.transformed(df))
    stats_ = out.agg(F.avg("n_x"), F.stddev_pop("n_x"), F.max("ratio"), F.min("ratio")).first()
    assert abs(stats_[0]) < 1e-9 and abs(stats_[1] - 1) < 1e-9 and stats_[2] == stats_[3] == 0
    top = prep.transformed(df).agg(F.max("n_x")).first()[0]
    assert top == pytest.approx(__import__("math").log1p(99.0))


def test_availability_score_and_thresholds(spark):
    cols = list(selection.SCORE_WEIGHTS)
    df = spark.createDataFrame([("a", *[10] * len(cols)), ("b", *[0] * len(cols))], "project_name string, " + ", ".join(f"{c} long" for c in cols))
    got = {r["project_name"]: r["usable_score"] for r in selection.usable_score(df).collect()}
    assert got == {"a": 100.0, "b": 0.0}
    assert "n_commits=10 below minimum 500" in selection.threshold_problems(df).where("project_name = 'a'").first()["problems"]


def test_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double")
    with pytest.raises(KeyError):
        quality.require_columns(df, ["k", "zz"])
    with pytest.raises(ValueError):
        quality.require_unique(df, "k")
    with pytest.raises(ValueError):
        quality.require_complete(df, ["v"])
    with pytest.raises(ValueError):
        issues.role_lookup(spark.createDataFrame([("a", 1, None)], "actor_id string, cluster_label int, candidate_role_label string"))


def test_field_coverage_tells_missing_from_null(spark):
    docs = ['{"a": 1, "b": {"c": null}, "l": [{"x": 1}, {"x": 2}]}', '{"a": "t"}', "not json", None]
    got = {r["path"]: (r["present"], r["nulls"], r["missing"], r["types"]) for r in quality.field_coverage(spark.createDataFrame([(d,) for d in docs], "j string"), "j").collect()}
    assert got["a"] == (2, 0, 2, "int:1;str:1") and got["b.c"] == (0, 1, 3, "null:1") and got["l[].x"][0] == 1


def test_reports(spark):
    df = spark.createDataFrame([("a|b", None), ("c\nd", 1)], "x string, y int")
    assert report.markdown(df) == "| x | y |\n| --- | --- |\n| a\\|b |  |\n| c d | 1 |" and report.markdown(df.limit(0)) == ""
    assert df.limit(1).select(report.redact(F.lit("me@x.org 0123456789abcdef01234567"))).first()[0] == "<email> <id>"
    assert report.json_text({"b": 1, "a": __import__("datetime").date(2020, 1, 2)}) == '{\n  "a": "2020-01-02",\n  "b": 1\n}'
