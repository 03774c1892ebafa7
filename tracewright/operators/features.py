"""Per-actor features: one window for the times between events, and one fused aggregation over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import LIFECYCLE_STAGES, SOURCES

# Event type behind each plain count.
EVENT_COUNTS = {
    "n_issues_reported": "issue_created",
    "n_issue_comments": "issue_comment_added",
    "n_status_changes": "status_changed",
    "n_priority_changes": "priority_changed",
    "n_resolution_changes": "resolution_changed",
    "n_assignee_changes": "assignee_changed",
    "n_issue_field_changes": "issue_field_changed",
    "n_bugfix_commits_authored": "commit_authored",
    "n_prs_opened": "pr_opened",
    "n_prs_closed": "pr_closed",
    "n_prs_merged": "pr_merged",
    "n_reviews_submitted": "review_submitted",
    "n_review_comments": "review_comment_added",
    "n_issues_closed": "issue_closed",
    "n_issues_resolved": "issue_resolved",
}


def known_actors(events: DataFrame) -> DataFrame:
    """Events with a known actor (an unset flag means unknown), empty issue ids made null."""
    flag = F.coalesce(F.col("actor_unknown"), F.lit(True)) if "actor_unknown" in events.columns else F.col("actor_id").isNull()
    return events.where(~flag & F.col("actor_id").isNotNull()).withColumn("issue_id", F.nullif("issue_id", F.lit("")))


def _count(c: Column) -> Column:
    return F.count_if(c)


def fused(events: DataFrame) -> DataFrame:
    """Everything about an actor that needs no order, in one pass over the log.

    Distinct values are held as sets of one actor at a time: an Expand would multiply the log and sort it with all its sums.
    """
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    kind, source, stage = F.coalesce("event_type", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("lifecycle_stage", F.lit(""))
    commit = (source == "commit") | (kind == "commit_authored")
    bot = F.bool_or("is_bot") if "is_bot" in events.columns else F.lit(False)
    aggs = [
        F.count("*").alias("total_events"),
        distinct("project_name").alias("n_projects"),
        distinct("issue_id").alias("n_unique_issues"),
        distinct(F.to_date("ts")).alias("active_days"),
        F.coalesce(bot, F.lit(False)).alias("is_bot"),
        _count(F.col("event_scope") == "issue_linked").alias("n_issue_linked_events"),
        _count(F.col("event_scope") == "project_level").alias("n_project_level_events"),
        *[_count(kind == v).alias(k) for k, v in EVENT_COUNTS.items()],
        distinct(F.when(kind == "issue_comment_added", F.col("issue_id"))).alias("n_unique_issues_commented"),
        F.median(F.when(kind == "issue_comment_added", F.col("text_length"))).alias("median_comment_length"),
        _count((kind == "issue_field_changed") & (stage == "unknown")).alias("n_unknown_issue_field_changes"),
        distinct(F.when(commit, F.col("commit_id"))).alias("n_commits_linked_to_bug"),
        *[F.coalesce(F.sum(F.when(commit, F.col(c))), F.lit(0)).alias(f"n_{c}") for c in ("files_changed", "lines_added", "lines_deleted")],
        _count(source == "pull_request").alias("n_pr_events_total"),
        _count(source == "pull_request_review_comment").alias("n_pr_review_comments"),
        _count(stage == "closure").alias("n_final_status_changes"),
        *[_count(stage == x).alias(f"__stage_{x}") for x in LIFECYCLE_STAGES],
        *[_count(source == x).alias(f"__source_{x}") for x in SOURCES],
        F.median("__hours").alias("median_inter_event_hours"),
        F.min("ts").alias("first_event_at"),
        F.max("ts").alias("last_event_at"),
        F.min(F.when(F.col("ts").isNotNull(), F.struct("ts", "lifecycle_stage"))).alias("__a"),
        F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", "lifecycle_stage"))).alias("__z"),
    ]
    total = F.col("total_events")
    out = events.groupBy("actor_id").agg(*aggs)
    ratios = {f"{x}_ratio": F.col(f"__stage_{x}") / total for x in LIFECYCLE_STAGES} | {f"{x}_ratio": F.col(f"__source_{x}") / total for x in SOURCES}
    ratios |= {"issue_linked_ratio": F.col("n_issue_linked_events") / total, "project_level_ratio": F.col("n_project_level_events") / total}
    more = {"n_lines_added_deleted_log": F.log1p(F.greatest(F.col("n_lines_added") + F.col("n_lines_deleted"), F.lit(0)).cast("double")), "is_low_activity": (total < 3) | (F.col("n_unique_issues") < 2), "first_lifecycle_stage": F.col("__a.lifecycle_stage"), "last_lifecycle_stage": F.col("__z.lifecycle_stage")}
    return out.withColumns(ratios | more)


def with_hours(events: DataFrame) -> DataFrame:
    """events with the hours since the actor's event before it, by time and stage; events without a time have none and come last."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("actor_id").orderBy(F.asc_nulls_last("ts"), "lifecycle_stage")
    return events.withColumn("__hours", (at - F.lag(at).over(order)) / 3.6e9)


# Fixed value: the published order of the feature table.
ORDER = [
    "actor_id", "total_events", "n_projects", "n_unique_issues", "active_days", "is_bot", "is_low_activity", "n_issue_linked_events", "n_project_level_events",
    "issue_linked_ratio", "project_level_ratio", "n_issues_reported", "n_issue_comments", "n_unique_issues_commented", "median_comment_length", "n_status_changes",
    "n_priority_changes", "n_resolution_changes", "n_assignee_changes", "n_issue_field_changes", "n_unknown_issue_field_changes", "n_bugfix_commits_authored",
    "n_commits_linked_to_bug", "n_files_changed", "n_lines_added", "n_lines_deleted", "n_lines_added_deleted_log", "n_prs_opened", "n_prs_closed", "n_prs_merged",
    "n_pr_events_total", "n_reviews_submitted", "n_review_comments", "n_pr_review_comments", "n_issues_closed", "n_issues_resolved", "n_final_status_changes",
    *[f"{x}_ratio" for x in LIFECYCLE_STAGES], *[f"{x}_ratio" for x in SOURCES],
    "first_event_at", "last_event_at", "median_inter_event_hours", "first_lifecycle_stage", "last_lifecycle_stage",
]


def actor_features(events: DataFrame) -> DataFrame:
    """One row per known actor: the key and 57 features. The log is read once: the window and the aggregation share its partitioning."""
    return fused(with_hours(known_actors(events))).select(*ORDER)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, missing, mean, sample deviation, extremes and exact quantiles of each column, as rows."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = df.select(parts).select("x.feature", "x.v")
    q = F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95)])).alias("q")
    out = long.groupBy("feature").agg(F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q, F.max("v").alias("max"))
    return out.select("feature", "count", "missing", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p90", "p95"))], "max")


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, missing_count, missing_rate) of each column, in one pass."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_count")) for c in columns])).alias("x"))
    return long.select("x.feature", "x.missing_count", F.coalesce(F.col("x.missing_count") / F.nullif("__n", F.lit(0)), F.lit(0.0)).alias("missing_rate"))
