"""The event log of a few hand-made documents."""

import datetime as dt

from tracewright.operators import extract, quality
from tracewright.plans import pipeline
from tracewright.schemas import EVENTS
from tracewright.streaming.counts import windowed_counts

T = [dt.datetime(2020, 1, d) for d in range(1, 29)]


def collections(spark):
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "issue_system": f([("is1", "p1"), ("is9", "orphan")], "_id string, project_id string"),
        "pull_request_system": f([("ps1", "p1")], "_id string, project_id string"),
        "issue": f([("i1", "is1", "Bug", "Closed", None, "K-1", "title", "desc", T[0], "u1", None), ("i2", "is1", "bug", "Open", "Fixed", "K-2", "t", None, T[1], "", "u2"), ("i3", "is1", "Task", "Closed", None, "K-3", "t", None, T[1], "u1", None), ("i4", "is9", "Bug", "Closed", None, "K-4", "t", None, T[1], "u1", None)], "_id string, issue_system_id string, issue_type string, status string, resolution string, external_id string, title string, desc string, created_at timestamp, creator_id string, reporter_id string"),
        "issue_comment": f([("c1", "i1", "u2", T[2], "héllo"), ("c2", "i3", "u2", T[2], "x")], "_id string, issue_id string, author_id string, created_at timestamp, comment string"),
        "event": f([("e1", "i1", "status", T[3], "u1", "Open", "Closed"), ("e2", "i2", "Rank", None, None, None, None)], "_id string, issue_id string, status string, created_at timestamp, author_id string, old_value string, new_value string"),
        "commit": f([("m1", "sha1", "u3", None, T[4], None, "fix", ["i1", "zz"], ["i1"]), ("m2", "sha2", None, "u4", None, T[5], None, ["i2"], None)], "_id string, revision_hash string, author_id string, committer_id string, author_date timestamp, committer_date timestamp, message string, linked_issue_ids array<string>, fixed_issue_ids array<string>"),
        "file_action": f([("a1", "m1", 5, 2), ("a2", "m1", None, 1)], "_id string, commit_id string, lines_added int, lines_deleted int"),
        "pull_request": f([("q1", "ps1", "u5", T[6], "closed", "t", None, T[8], T[7], None, None, None, None, None), ("q2", "ps1", "u5", T[9], "closed", "t", None, T[10], None, None, None, None, None, "sha2"), ("q3", "ps1", "u6", T[11], "open", "t", None, T[11], None, None, None, None, None, None), ("q4", "ps1", "u6", T[12], "open", "t", None, T[12], None, None, None, None, None, None)], "_id string, pull_request_system_id string, creator_id string, created_at timestamp, state string, title string, description string, updated_at timestamp, merged_at timestamp, merge_commit_id string, source_commit_id string, target_commit_id string, source_commit_sha string, target_commit_sha string"),
        "pull_request_commit": f([("b1", "q1", "unknown", "sha1"), ("b2", "q3", "nope", "nope")], "_id string, pull_request_id string, commit_id string, commit_sha string"),
        "pull_request_review": f([("r1", "q1", "u7", T[7], "ok")], "_id string, pull_request_id string, creator_id string, submitted_at timestamp, description string"),
        "pull_request_comment": f([("k1", "q4", "u8", T[13], "hm")], "_id string, pull_request_id string, author_id string, created_at timestamp, comment string"),
        "pull_request_review_comment": f([("w1", "r1", None, None, "nit")], "_id string, pull_request_review_id string, creator_id string, created_at timestamp, comment string"),
    }


def test_event_log(spark):
    projects = spark.createDataFrame([("p1", "kafka")], "project_id string, project_name string")
    log = extract.extract_events(collections(spark), projects, project_level_prs=1)
    assert [(f.name, f.dataType) for f in log.schema.fields] == [(f.name, f.dataType) for f in EVENTS.fields]
    rows = log.collect()
    by = {}
    for r in rows:
        by.setdefault(r["event_type"], []).append(r)
    assert {r["issue_id"]: r["actor_id_raw"] for r in by["issue_created"]} == {"i1": "u1", "i2": "u2"}
    assert by["issue_comment_added"][0]["text_length"] == 5 and len(by["issue_comment_added"]) == 1
    assert [r["actor_id_raw"] for r in by["issue_closed"]] == ["u1"] and by["issue_field_changed"][0]["lifecycle_stage"] == "unknown"
    commits = sorted((r["issue_id"], r["commit_id"], r["files_changed"], r["lines_added"], r["lines_deleted"], r["actor_id_raw"]) for r in by["commit_authored"])
    assert commits == [("i1", "m1", 2, 5, 3, "u3"), ("i1", "m1", 2, 5, 3, "u3"), ("i2", "m2", 0, 0, 0, "u4")]
    assert sorted((r["pr_id"], r["issue_id"], r["event_scope"]) for r in by["pr_opened"]) == [("q1", "i1", "issue_linked"), ("q2", "i2", "issue_linked"), ("q4", None, "project_level")]
    assert [r["timestamp"] for r in by["pr_merged"]] == [T[7]] and [r["timestamp"] for r in by["pr_closed"]] == [T[10]]
    assert sorted((r["source"], r["pr_id"]) for r in by["review_comment_added"]) == [("pull_request_comment", "q4"), ("pull_request_review_comment", "q1")]
    assert quality.duplicates(log).collect()[0]["n_copies"] == 2
    warned = {(r["warning_type"], r["event_id"]) for r in extract.event_warnings(log).collect()}
    assert ("missing_timestamp", "event:issue_field_changed:e2") in warned and sum(w == "missing_actor" for w, _ in warned) == 2


def test_log_stage_writes_what_later_stages_read(spark, tmp_path):
    projects = spark.createDataFrame([("p1", "kafka")], "project_id string, project_name string")
    log = pipeline.build_log(spark, collections(spark), projects, str(tmp_path))
    assert {"ts", "actor_id", "actor_unknown", "is_bot"} <= set(log.columns)
    assert spark.read.parquet(f"{tmp_path}/actor_mapping.parquet").count() == 8
    from tracewright.operators.features import ORDER, actor_features

    assert actor_features(log).columns == ORDER and len(ORDER) == 58


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [("a", T[0], "x"), ("a", T[0], "x"), ("b", T[0], "x"), ("c", T[1], "y")]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp, event_type string")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["n_events"]) for r in spark.table("counts").collect()}
    assert got == {("x", 2), ("y", 1)} == {(r["event_type"], r["n_events"]) for r in windowed_counts(df).collect()}
