"""From document collections to the event log: predicates, bridges and emitters, one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import EVENTS
from tracewright.sources.tables import stage_of

#: Newest project-level pull requests that are kept per project.
PROJECT_LEVEL_PRS = 200


def closed_bug_strict(issue_type: Column, status: Column, resolution: Column) -> Column:
    """Type is bug in any case; status is Closed or Resolved as spelled, or there is a resolution but Unresolved."""
    done = status.isin("Closed", "Resolved") | (resolution.isNotNull() & ~resolution.isin("", "Unresolved"))
    return F.coalesce((F.lower(issue_type) == "bug") & F.coalesce(done, F.lit(False)), F.lit(False))


def closed_bug_loose(issue_type: Column, status: Column, resolution: Column) -> Column:
    """The same with all three trimmed and in any case."""
    t, s, r = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (issue_type, status, resolution))
    return (t == "bug") & (s.isin("closed", "resolved") | ~r.isin("", "unresolved"))


def issue_event_type(field: Column, new_value: Column) -> Column:
    """Event type of a field change."""
    f, v = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (field, new_value))
    status = F.when(v == "closed", "issue_closed").when(v == "resolved", "issue_resolved").otherwise("status_changed")
    return F.when(f == "status", status).when(f == "priority", "priority_changed").when(f.isin("assignee", "assignee_id"), "assignee_changed").when(f == "resolution", "resolution_changed").otherwise("issue_field_changed")


def pull_request_events(state: Column, created: Column, updated: Column, merged: Column) -> Column:
    """array<struct<event_type, at>>: opened, and merged or else closed (at the last update)."""
    pair = lambda name, at: F.struct(F.lit(name).alias("event_type"), at.alias("at"))
    end = F.when(merged.isNotNull(), pair("pr_merged", merged)).when(F.lower(state) == "closed", pair("pr_closed", updated))
    return F.filter(F.array(pair("pr_opened", created), end), lambda x: x.isNotNull())


def text_length(*texts: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.length(t), F.lit(0)) for t in texts]).cast("long")


def linked_commits(commits: DataFrame, issues: DataFrame, id_col: str = "_id") -> DataFrame:
    """(issue_id, commit_id) from both reference arrays, repeats kept, of the given issues."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("linked_issue_ids", none), F.coalesce("fixed_issue_ids", none))
    pairs = commits.select(F.explode(both).alias("issue_id"), F.col(id_col).alias("commit_id"))
    return pairs.join(issues.select(F.col("_id").alias("issue_id")).distinct(), "issue_id", "left_semi")


def of_selected(rows: DataFrame, key: str, selected: DataFrame, selected_key: str) -> DataFrame:
    """rows whose key is among the selected ones."""
    return rows.join(selected.select(F.col(selected_key).alias(key)), key, "left_semi")


def commit_churn(actions: DataFrame, key: str = "commit_id") -> DataFrame:
    """Files, added and deleted lines per commit."""
    s = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return actions.groupBy(key).agg(F.count("*").alias("files_changed"), s("lines_added"), s("lines_deleted"))


def bridge_with_fallback(rows: DataFrame, by_id: DataFrame, by_sha: DataFrame, id_col: str, sha_col: str) -> DataFrame:
    """rows with the target of their id, or of their sha where the id leads nowhere; rows without either are left out.

    by_id: (key, target); by_sha: (key, target).
    """
    a = by_id.select(F.col("key").alias("__i"), F.col("target").alias("__ti"))
    b = by_sha.select(F.col("key").alias("__s"), F.col("target").alias("__ts"))
    out = rows.join(a, F.col(id_col) == F.col("__i"), "left").join(b, F.col("__ti").isNull() & (F.col(sha_col) == F.col("__s")), "left")
    return out.withColumn("target", F.coalesce("__ti", "__ts")).drop("__i", "__ti", "__s", "__ts").where("target is not null")


def any_key_matches(rows: DataFrame, id_col: str, key_cols: list[str], keys: DataFrame) -> DataFrame:
    """Distinct (id, target) where any of several key columns matches (key, target): keys exploded, then one equi-join."""
    long = rows.select(F.col(id_col), F.explode(F.array(*key_cols)).alias("key")).where("key is not null")
    return long.join(keys, "key").select(id_col, "target").distinct()


def newest_others(rows: DataFrame, exclude: DataFrame, id_col: str, group: str, at: str, n: int) -> DataFrame:
    """The newest n rows of each group that exclude doesn't list; ties go to the larger id."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(at), F.desc(id_col))
    return rows.join(exclude.select(id_col).distinct(), id_col, "left_anti").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def _events(df: DataFrame, **cols) -> DataFrame:
    """The common schema; what an emitter leaves out is null, or 0 for numbers, and the stage follows from the type."""
    cols["lifecycle_stage"] = stage_of(cols["event_type"])
    out = []
    for f in EVENTS.fields:
        c = cols.get(f.name)
        if c is None:
            c = F.lit(0) if f.dataType.simpleString() == "bigint" else F.lit(None)
        out.append((c if isinstance(c, Column) else F.lit(c)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def _json(*names: str) -> Column:
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def extract_events(c: dict[str, DataFrame], projects: DataFrame, project_level_prs: int = PROJECT_LEVEL_PRS) -> DataFrame:
    """The event log of the selected projects. c: collections by name; projects: (project_id, project_name).

    Closed bugs give issue, comment, change, commit, pull-request and review events; pull requests of a project that no
    closed bug leads to give project-level events, the newest project_level_prs of each project.
    """
    system = lambda name: c[name].select(F.col("_id").alias(f"{name}_id"), "project_id").join(F.broadcast(projects), "project_id")
    issues = c["issue"].where(closed_bug_strict(F.col("issue_type"), F.col("status"), F.col("resolution"))).join(system("issue_system"), "issue_system_id")
    link = {"event_scope": "issue_linked", "linkage_type": "direct_issue"}
    who = lambda *names: {"actor_id_raw": _first(*names)}
    place = {"project_id": F.col("project_id"), "project_name": F.col("project_name"), "issue_id": F.col("issue_id"), "issue_external_id": F.col("issue_external_id")}
    key = issues.select(F.col("_id").alias("issue_id"), F.col("external_id").alias("issue_external_id"), "project_id", "project_name")
    i = issues.withColumn("issue_id", F.col("_id")).withColumn("issue_external_id", F.col("external_id"))
    out = [_events(i, **place, **link, **who("creator_id", "reporter_id"), event_id=F.concat_ws(":", F.lit("issue"), F.lit("issue_created"), "_id"), actor_role_raw="issue_creator", timestamp=F.col("created_at"), source="issue", event_type=F.lit("issue_created"), target_id=F.col("_id"), text_available=text_length(F.col("title"), F.col("desc")) > 0, text_length=text_length(F.col("title"), F.col("desc")), metadata_json=_json("status", "resolution", "issue_type"))]
    comments = c["issue_comment"].join(key, "issue_id")
    out.append(_events(comments, **place, **link, **who("author_id"), event_id=F.concat_ws(":", F.lit("issue_comment"), F.lit("issue_comment_added"), "_id"), actor_role_raw="comment_author", timestamp=F.col("created_at"), source="issue_comment", event_type=F.lit("issue_comment_added"), target_id=F.col("_id"), text_available=text_length(F.col("comment")) > 0, text_length=text_length(F.col("comment"))))
    changes = c["event"].join(key, "issue_id").withColumn("status_field", F.col("status"))
    kind = issue_event_type(F.col("status"), F.col("new_value"))
    out.append(_events(changes, **place, **link, **who("author_id"), event_id=F.concat_ws(":", F.lit("event"), kind, "_id"), actor_role_raw="issue_event_author", timestamp=F.col("created_at"), source="event", event_type=kind, target_id=F.col("_id"), text_available=False, metadata_json=_json("status_field", "old_value", "new_value")))
    pairs = linked_commits(c["commit"], issues)
    commits = pairs.join(c["commit"].withColumnRenamed("_id", "commit_id"), "commit_id").join(key, "issue_id").join(commit_churn(c["file_action"]), "commit_id", "left").fillna(0, ["files_changed", "lines_added", "lines_deleted"])
    bridge = {"event_scope": "issue_linked", "linkage_type": "commit_bridge"}
    out.append(_events(commits, **place, **bridge, **who("author_id", "committer_id"), event_id=F.concat_ws(":", F.lit("commit"), F.lit("commit_authored"), F.lit("issue"), "issue_id", F.lit("commit"), "commit_id"), actor_role_raw="commit_author", timestamp=F.coalesce("author_date", "committer_date"), source="commit", event_type=F.lit("commit_authored"), target_id=F.col("commit_id"), commit_id=F.col("commit_id"), text_available=text_length(F.col("message")) > 0, text_length=text_length(F.col("message")), files_changed=F.col("files_changed"), lines_added=F.col("lines_added"), lines_deleted=F.col("lines_deleted")))
    # pull requests of a commit: by the bridge collection (id, or sha where the id is unknown), or by their own references
    linked = pairs.select("issue_id", "commit_id").distinct()
    ids = linked.select(F.col("commit_id").alias("key"), F.col("commit_id").alias("target")).distinct()
    shas = c["commit"].join(ids.select(F.col("key").alias("_id")), "_id", "left_semi").select(F.col("revision_hash").alias("key"), F.col("_id").alias("target"))
    known = c["commit"].select(F.col("_id").alias("key"), F.col("_id").alias("target"))
    via = bridge_with_fallback(c["pull_request_commit"].select("pull_request_id", "commit_id", "commit_sha"), known, shas, "commit_id", "commit_sha").select("pull_request_id", F.col("target").alias("commit_id"))
    prs = c["pull_request"].withColumnRenamed("_id", "pull_request_id")
    direct = any_key_matches(prs, "pull_request_id", ["merge_commit_id", "source_commit_id", "target_commit_id", "source_commit_sha", "target_commit_sha"], ids.unionByName(shas)).withColumnRenamed("target", "commit_id")
    pr_issue = via.unionByName(direct.select("pull_request_id", "commit_id")).join(linked, "commit_id").select("pull_request_id", "issue_id").distinct()
    of_issue = prs.join(pr_issue, "pull_request_id").join(key, "issue_id")
    home = prs.join(system("pull_request_system"), "pull_request_system_id")
    others = newest_others(home, pr_issue, "pull_request_id", "project_id", "created_at", project_level_prs).withColumn("issue_id", F.lit(None).cast("string")).withColumn("issue_external_id", F.lit(None).cast("string"))
    for rows, scope in ((of_issue, bridge), (others, {"event_scope": "project_level", "linkage_type": "project_level"})):
        tag = F.concat_ws(":", F.coalesce("issue_id", F.lit("project")), "pull_request_id")
        opened = rows.withColumn("e", F.explode(pull_request_events(F.col("state"), F.col("created_at"), F.col("updated_at"), F.col("merged_at"))))
        pr = {"pr_id": F.col("pull_request_id")}
        out.append(_events(opened, **place, **scope, **pr, **who("creator_id"), event_id=F.concat_ws(":", F.lit("pull_request"), F.col("e.event_type"), tag), actor_role_raw="pr_creator", timestamp=F.col("e.at"), source="pull_request", event_type=F.col("e.event_type"), target_id=F.col("pull_request_id"), text_available=text_length(F.col("title"), F.col("description")) > 0, text_length=text_length(F.col("title"), F.col("description"))))
        at = rows.select("pull_request_id", "project_id", "project_name", "issue_id", "issue_external_id")
        reviews = c["pull_request_review"].withColumnRenamed("_id", "review_id").join(at, "pull_request_id")
        out.append(_events(reviews, **place, **scope, **pr, **who("creator_id"), event_id=F.concat_ws(":", F.lit("pull_request_review"), tag, "review_id"), actor_role_raw="reviewer", timestamp=F.col("submitted_at"), source="pull_request_review", event_type=F.lit("review_submitted"), target_id=F.col("review_id"), review_id=F.col("review_id"), text_available=text_length(F.col("description")) > 0, text_length=text_length(F.col("description"))))
        talk = c["pull_request_comment"].join(at, "pull_request_id")
        out.append(_events(talk, **place, **scope, **pr, **who("author_id"), event_id=F.concat_ws(":", F.lit("pull_request_comment"), tag, "_id"), actor_role_raw="pr_comment_author", timestamp=F.col("created_at"), source="pull_request_comment", event_type=F.lit("review_comment_added"), target_id=F.col("_id"), text_available=text_length(F.col("comment")) > 0, text_length=text_length(F.col("comment"))))
        of_review = c["pull_request_review_comment"].join(reviews.select(F.col("review_id").alias("pull_request_review_id"), "pull_request_id", "project_id", "project_name", "issue_id", "issue_external_id"), "pull_request_review_id")
        out.append(_events(of_review, **place, **scope, **pr, **who("creator_id"), event_id=F.concat_ws(":", F.lit("pull_request_review_comment"), tag, "_id"), actor_role_raw="review_comment_author", timestamp=F.col("created_at"), source="pull_request_review_comment", event_type=F.lit("review_comment_added"), target_id=F.col("_id"), review_id=F.col("pull_request_review_id"), text_available=text_length(F.col("comment")) > 0, text_length=text_length(F.col("comment"))))
    return reduce(DataFrame.unionByName, out)


def event_warnings(events: DataFrame) -> DataFrame:
    """A warning row for each event without a time and each without an actor."""
    both = F.filter(F.array(F.when(F.col("timestamp").isNull(), "missing_timestamp"), F.when(F.col("actor_id_raw").isNull(), "missing_actor")), lambda x: x.isNotNull())
    return events.select("project_name", "project_id", "event_id", F.explode(both).alias("warning_type"), "source", "event_type", F.concat_ws(" ", F.lit("event"), "event_id").alias("message"))


def sample_issues(counts: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The n issues of each group with the most kinds of linked records, newest first among equals.

    counts: group, issue_id, created_at and a count column per kind.
    """
    kinds = [x for x in counts.columns if x.startswith("n_")]
    score = reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("int") for k in kinds])
    w = Window.partitionBy(group).orderBy(F.desc("linkage_score"), F.desc_nulls_last("created_at"), F.desc("issue_id"))
    return counts.withColumn("linkage_score", score).withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)
