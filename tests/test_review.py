"""Guards, the role protocol, settings and report texts on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import config, report
from tracewright.operators import prep, profiles, review


def test_settings_and_selected_projects(spark, tmp_path):
    text = report.yaml_text({"selected_projects": [{"project_id": "p1", "project_name": "a: b"}, {"project_id": "p2", "project_name": None}], "paths": {"out": "x/y"}, "none": []})
    report.write_text(spark, text, f"file://{tmp_path}/s.yaml")
    settings = config.load_settings(f"{tmp_path}/s.yaml")
    assert config.setting(settings, "paths.out") == "x/y" and config.setting(settings, "paths.zz", 5) == 5 and settings["none"] == []
    assert config.resolve(settings, "paths.out", "/r") == "/r/x/y"
    assert [tuple(r) for r in config.selected_projects(spark, f"{tmp_path}/s.yaml").collect()] == [("p1", "a: b"), ("p2", None)]
    (tmp_path / "e.json").write_text(json.dumps({"selected_projects": []}))
    with pytest.raises(ValueError):
        config.selected_projects(spark, f"{tmp_path}/e.json")
    with pytest.raises(ValueError):
        config.load_schema_map(f"{tmp_path}/e.json")
    with pytest.raises(KeyError):
        config.resolve(settings, "a.b", "/")


def test_protocol_guards(spark):
    prof = spark.createDataFrame([(0, "fixing", 0.5), (1, "review", 0.75)], "cluster_label int, dominant_stage string, dominant_stage_ratio double")
    top = spark.createDataFrame([(0, "b", "top", 2), (0, "a", "top", 1), (0, "z", "bottom", 1), (1, "c", "top", 1)], "cluster_label int, feature string, direction string, rank int")
    stable = spark.createDataFrame([(0, 0.9)], "cluster_label int, mean_dominant_fraction double")
    got = {r["cluster_label"]: (r["evidence_summary"], r["mean_dominant_fraction"]) for r in review.taxonomy(prof, top, stable, {0: "Fixer", 1: "Reviewer"}).collect()}
    assert got == {0: ("dominant stage fixing (0.500); top features a; b", 0.9), 1: ("dominant stage review (0.750); top features c", None)}
    with pytest.raises(ValueError, match="without a label"):
        review.taxonomy(prof, top, stable, {0: "Fixer"})
    with pytest.raises(ValueError, match="forbidden"):
        review.require_allowed(spark.createDataFrame([("Team Leader",), (None,)], "r string"), "r")
    review.require_allowed(spark.createDataFrame([("Fixer",), (None,)], "r string"), "r")


def test_model_input_guard(spark):
    matrix = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "actor_id string, x double")
    feats = spark.createDataFrame([("a", False, False), ("b", False, False), ("c", True, False)], "actor_id string, is_bot boolean, is_low_activity boolean")
    labels = matrix.select("actor_id", F.lit(1).alias("label"))
    prep.require_model_input(matrix, labels, feats)
    for bad in (labels.limit(1), labels.unionByName(labels)):
        with pytest.raises(ValueError):
            prep.require_model_input(matrix, bad, feats)
    with pytest.raises(ValueError):
        prep.require_model_input(matrix, labels, feats.withColumn("is_bot", F.lit(True)))


def test_representatives_by_probability(spark):
    rows = [(0, "a", 10, 0.5), (0, "b", 1, 0.9), (0, "c", 99, None), (-1, "d", 1, 0.0), (-1, "e", 5, 0.0), (-1, "f", 9, 0.0)]
    df = spark.createDataFrame(rows, "cluster_label int, actor_id string, total_events int, cluster_probability double")
    order = lambda x, k: [r["actor_id"] for r in profiles.representatives(x).where(f"cluster_label = {k}").orderBy("rank").collect()]
    assert order(df, 0) == ["b", "a", "c"] and order(df.drop("cluster_probability"), 0) == ["c", "a", "b"] and order(df, -1)[0] in ("d", "e")


def test_texts(spark, tmp_path):
    df = spark.createDataFrame([("a  b c", float("nan"))], "x string, y double")
    assert report.markdown(df) == "| x | y |\n| --- | --- |\n| a  b c |  |"
    with pytest.raises(ValueError):
        report.markdown(spark.range(3), max_rows=2)
    said = report.document("T", {"One": df.select("x"), "Two": df.limit(0), "Three": "words"})
    assert said == "# T\n\n## One\n\n| x |\n| --- |\n| a  b c |\n\n## Two\n\n(none)\n\n## Three\n\nwords\n"
    short = spark.createDataFrame([("one two  three",), ("one two three four",), (None,)], "t string").select(report.shorten(F.col("t"), 14)).collect()
    assert [r[0] for r in short] == ["one two three", "one two [...]", None]
    assert report.write_public(spark.createDataFrame([(1, "k")], "v int, internal string"), ["internal"], f"file://{tmp_path}", "vectors") == 1
    assert spark.read.parquet(f"file://{tmp_path}/vectors.parquet").columns == ["v"]
    assert report.selection_payload(spark.createDataFrame([("p", 2)], "project_id string, n int"), "project_id", ["n"]) == {"selected_projects": [{"project_id": "p", "n": 2}]}


def test_absent_inputs_and_lists(spark):
    got = {r["collection"]: tuple(r)[1:] for r in review.catalog({"a": spark.range(3), "x": spark.range(1)}, ["a", "b"]).collect()}
    assert got == {"a": (True, 3), "b": (False, 0), "x": (True, 1)}
    row = spark.range(1).select(review.split_list(F.lit(" a ;; b")), review.split_list(F.lit(None).cast("string")), review.truth(F.lit(None)), review.truth(F.lit(" YES")), review.id_text(F.lit(5))).first()
    assert tuple(row) == (["a", "b"], [], False, True, "5")
