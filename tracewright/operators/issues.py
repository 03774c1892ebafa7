"""Per-issue analytics: role sets, lifecycle metrics, sequences, role vectors and patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import NO_CLUSTERED_ROLE, NO_NON_NOISE_ROLE, NOISE_ROLE, ROLE_COLUMNS, ROLE_ORDER
from tracewright.sources.tables import spread


def role_lookup(labels: DataFrame) -> DataFrame:
    """Actor roles with the noise cluster's analysis label; ValueError if a cluster has no role name."""
    if labels.where("cluster_label is not null and candidate_role_label is null").limit(1).count():
        raise ValueError("a cluster has no role label")
    return with_analysis_labels(labels)


def with_analysis_labels(labels: DataFrame) -> DataFrame:
    noise = F.col("cluster_label") == -1
    return labels.withColumn("is_noise_cluster", noise).withColumn("analysis_role_label", F.when(noise, NOISE_ROLE).otherwise(F.col("candidate_role_label")))


def enrich(events: DataFrame, lookup: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Issue-linked events with roles and eligibility flags. flags: (actor_id, is_bot, is_low_activity)."""
    rows = linked(events).join(lookup, "actor_id", "left")
    if flags is not None:
        rows = rows.join(flags.select("actor_id", "is_bot", "is_low_activity"), "actor_id", "left")
    else:
        rows = rows.withColumn("is_bot", F.lit(False)).withColumn("is_low_activity", F.lit(False))
    return flagged(rows)


def linked(events: DataFrame) -> DataFrame:
    return events.where("event_scope = 'issue_linked' and issue_id is not null")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with roles (cluster_label, candidate_role_label, is_noise_cluster, analysis_role_label, is_bot, is_low_activity), and their eligibility flags."""
    unknown = F.coalesce(F.col("actor_unknown"), F.lit(True)) if "actor_unknown" in rows.columns else F.col("actor_id").isNull()
    rows = rows.withColumn("actor_known", ~unknown).withColumn("actor_clustered", F.col("cluster_label").isNotNull()).withColumn("is_noise_cluster", F.coalesce("is_noise_cluster", F.lit(False)))
    rows = rows.withColumn("is_bot", F.coalesce("is_bot", F.lit(False))).withColumn("is_low_activity", F.coalesce("is_low_activity", F.lit(False)))
    rows = rows.withColumn("actor_unclustered", F.col("actor_known") & ~F.col("actor_clustered")).withColumn("role_set_eligible", F.col("actor_known") & F.col("actor_clustered"))
    return rows.withColumn("non_noise_role_eligible", F.col("role_set_eligible") & ~F.col("is_noise_cluster"))


def diagnostics(events: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row of eleven counts about the enriched events."""
    d = lambda c: F.count_distinct(F.when(c, F.col("actor_id")))
    un = F.col("actor_unclustered")
    a = events.agg(F.count("*").alias("input_events"), F.count_if(F.col("event_scope") == "project_level").alias("project_level_events_excluded"))
    b = enriched.agg(
        F.count("*").alias("issue_linked_events"), F.count_if(F.col("ts").isNull()).alias("issue_events_missing_timestamp"), F.count_if(~F.col("actor_known")).alias("actor_unknown_events_excluded_from_roles"),
        F.count_if(un).alias("known_unclustered_actor_events_excluded_from_roles"), d(F.col("actor_known")).alias("unique_known_issue_actors"), d(F.col("actor_clustered")).alias("unique_clustered_issue_actors"),
        d(un).alias("unique_unclustered_issue_actors"), d(un & F.col("is_low_activity")).alias("unique_low_activity_issue_actors"), d(un & F.col("is_bot")).alias("unique_bot_issue_actors"),
    )
    return a.crossJoin(b)  # one row each


def _ordered_set(cond: Column, label: str, none: str) -> Column:
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(ROLE_ORDER) for x in (r, i)])
    pair = F.when(cond & F.col(label).isNotNull(), F.struct(F.coalesce(rank[F.col(label)], F.lit(999)).alias("r"), F.col(label).alias("l")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(pair)), lambda x: x["l"]), " + ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(none))


def issue_role_sets(enriched: DataFrame) -> DataFrame:
    """Role sets in fixed rank order and actor counts of each issue, in one pass over distinct (issue, actor) pairs and counts of events.

    Nearly every event is a pair of its own, so events are dealt out by pair before they are sorted, and sorted once.
    """
    known, noise = F.col("actor_known"), F.col("is_noise_cluster")
    narrow = enriched.select("issue_id", "actor_id", "project_name", "actor_known", "actor_clustered", "actor_unclustered", "is_noise_cluster", "analysis_role_label", "candidate_role_label")
    pairs = spread(narrow, "issue_id", "actor_id").groupBy("issue_id", "actor_id").agg(
        F.max("project_name").alias("project_name"), F.max("actor_known").alias("actor_known"), F.max("actor_clustered").alias("actor_clustered"), F.max("actor_unclustered").alias("actor_unclustered"), F.max("is_noise_cluster").alias("is_noise_cluster"),
        F.max("analysis_role_label").alias("analysis_role_label"), F.max("candidate_role_label").alias("candidate_role_label"), F.count_if(~known).alias("u"), F.count_if("actor_unclustered").alias("v"),
    )
    clustered = known & F.col("actor_clustered")
    out = pairs.groupBy("issue_id").agg(
        F.max("project_name").alias("project_name"), F.sum("u").alias("n_actor_unknown_events"), F.sum("v").alias("n_unclustered_actor_events"),
        _ordered_set(clustered, "analysis_role_label", NO_CLUSTERED_ROLE).alias("role_set_with_noise"), _ordered_set(clustered & ~noise, "candidate_role_label", NO_NON_NOISE_ROLE).alias("role_set_without_noise"),
        F.count_if(known).alias("n_actors"), F.count_if(clustered).alias("n_clustered_actors"), F.count_if(known & F.col("actor_unclustered")).alias("n_unclustered_actors"), F.count_if(known & noise).alias("n_noise_actors"), F.count_if(clustered & ~noise).alias("n_non_noise_actors"),
    )
    size = lambda c, none: F.when(F.col(c) == none, 0).otherwise(F.size(F.split(c, " \\+ ")))
    return out.withColumns({
        "has_role_set_with_noise": F.col("role_set_with_noise") != NO_CLUSTERED_ROLE, "has_role_set_without_noise": F.col("role_set_without_noise") != NO_NON_NOISE_ROLE,
        "n_roles_with_noise": size("role_set_with_noise", NO_CLUSTERED_ROLE), "n_roles_without_noise": size("role_set_without_noise", NO_NON_NOISE_ROLE),
    })


def lifecycle_metrics(enriched: DataFrame, role_sets: DataFrame) -> DataFrame:
    """Times, counts and patch size of each issue, fused, with its role sets. The project is the one of role_sets: a greatest text would have all events sorted."""
    src, kind = F.col("source"), F.col("event_type")
    has = lambda c: F.col(c) if c in enriched.columns else F.lit(None).cast("string")
    units = lambda cond, c: F.count_distinct(F.when(cond, F.coalesce(F.nullif(has(c), F.lit("")), F.col("event_id"))))
    both = ["pull_request_comment", "pull_request_review_comment"]
    base = enriched.groupBy("issue_id").agg(
        F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"),
        F.min(F.when(kind == "issue_created", F.col("ts"))).alias("issue_created_at"),
        F.max(F.when(kind.isin("issue_closed", "issue_resolved") | (F.col("lifecycle_stage") == "closure"), F.col("ts"))).alias("issue_closed_or_resolved_at"),
        F.count("event_id").alias("n_events"), F.count_if(src.isin("issue_comment", *both)).alias("n_comments"), F.count_if((src == "issue_comment") | (kind == "issue_comment_added")).alias("n_issue_comments"),
        F.count_if(src.isin(*both) | (kind == "review_comment_added")).alias("n_review_comments"),
        units((src == "commit") | (kind == "commit_authored"), "commit_id").alias("n_commits"), units((src == "pull_request") | kind.isin("pr_opened", "pr_closed", "pr_merged"), "pr_id").alias("n_prs"),
        units((src == "pull_request_review") | (kind == "review_submitted"), "review_id").alias("n_reviews"),
        F.sum("files_changed").alias("files_changed"), F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"), F.count_if(F.col("ts").isNull()).alias("n_timestamp_missing_events"),
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = micros("issue_closed_or_resolved_at") - micros("issue_created_at")
    sets = role_sets.drop("n_roles_with_noise", "n_roles_without_noise")
    out = base.join(sets, "issue_id")
    out = out.select("issue_id", "project_name", *[c for c in out.columns if c not in ("issue_id", "project_name")]).withColumn("patch_size", F.col("lines_added") + F.col("lines_deleted"))
    out = out.withColumn("time_to_close_hours", F.when(took >= 0, took / 3.6e9)).withColumn("time_to_close_days", F.when(took >= 0, took / 8.64e10))
    flags = {"has_fixer": "Fixer / Code Contributor", "has_reviewer": "Review-focused Participant", "has_integrator": "PR Integrator", "has_issue_side_participant": "Issue-side Participant", "has_review_integration_hybrid": "Review-Integration Hybrid"}
    return out.withColumns({k: F.contains("role_set_without_noise", F.lit(v)) for k, v in flags.items()})


def role_set_frequency(role_sets: DataFrame) -> DataFrame:
    """Issues per role set, over all projects (ALL) and by project, with and without noise: one grouping-sets pass a scope, over kept counts of one pass over the issues."""
    role_sets = role_sets.groupBy("project_name", "role_set_with_noise", "role_set_without_noise").agg(F.count("*").alias("__n")).persist()
    parts = []
    for scope, c in (("including_noise", "role_set_with_noise"), ("excluding_noise", "role_set_without_noise")):
        g = role_sets.groupingSets([[F.col(c)], [F.col("project_name"), F.col(c)]], F.col("project_name"), F.col(c)).agg(F.sum("__n").alias("n_issues"), F.grouping("project_name").alias("g"))
        name = F.when(F.col("g") == 1, "ALL").otherwise(F.col("project_name"))
        g = g.select(F.lit(scope).alias("role_set_scope"), name.alias("project_name"), F.col(c).alias("role_set"), "n_issues")
        parts.append(g.withColumn("issue_ratio", F.col("n_issues") / F.sum("n_issues").over(Window.partitionBy("project_name"))))
    return parts[0].unionByName(parts[1])


def outcomes(metrics: DataFrame) -> DataFrame:
    """Closing time, comments, commits, patch and actors per role set."""
    main = metrics.where(F.col("role_set_without_noise") != NO_NON_NOISE_ROLE)
    q = F.percentile("time_to_close_days", F.array(F.lit(0.25), F.lit(0.75)))
    out = main.groupBy(F.col("role_set_without_noise").alias("role_set")).agg(F.count("*").alias("issue_count"), F.median("time_to_close_days").alias("median_time_to_close_days"), F.avg("time_to_close_days").alias("mean_time_to_close_days"), q.alias("q"), *[F.median(c).alias(f"median_{c}") for c in ("n_comments", "n_commits", "patch_size", "n_actors")])
    return out.withColumn("p25_time_to_close_days", F.col("q")[0]).withColumn("p75_time_to_close_days", F.col("q")[1]).drop("q")


def patch_sizes(metrics: DataFrame) -> DataFrame:
    main = metrics.where(F.col("role_set_without_noise") != NO_NON_NOISE_ROLE)
    out = main.groupBy(F.col("role_set_without_noise").alias("role_set")).agg(F.count("*").alias("issue_count"), F.median("patch_size").alias("median_patch_size"), F.avg("patch_size").alias("mean_patch_size"), F.percentile("patch_size", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return out.withColumn("p25_patch_size", F.col("q")[0]).withColumn("p75_patch_size", F.col("q")[1]).drop("q")


def compressed(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Rows whose label differs from the one before them in their group; null and empty labels are left out first."""
    w = Window.partitionBy(group).orderBy(*order)
    some = rows.where(F.col(label).isNotNull() & (F.col(label) != ""))
    return some.withColumn("__before", F.lag(label).over(w)).where("__before is null or __before <> " + f"`{label}`").drop("__before")


def sequences(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """(group, role_sequence, sequence_length): run-compressed labels in order."""
    c = compressed(rows, group, order, label)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*keys, F.col(label).alias("__l"))))
    return c.groupBy(group).agg(items.alias("s")).select(group, F.array_join(F.transform("s", lambda x: x["__l"]), " -> ").alias("role_sequence"), F.size("s").alias("sequence_length"))


def sequence_summary(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    return sequences(rows, group, order, label).groupBy("role_sequence").agg(F.count("*").alias("n_issues"), F.median("sequence_length").alias("median_sequence_length"))


def transitions(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """(from_role, to_role, n_transitions, n_issues) between neighbours of the compressed sequences."""
    w = Window.partitionBy(group).orderBy(*order)
    pairs = compressed(rows, group, order, label).withColumn("to_role", F.lead(label).over(w)).where("to_role is not null")
    return pairs.groupBy(F.col(label).alias("from_role"), "to_role").agg(F.count("*").alias("n_transitions"), F.count_distinct(group).alias("n_issues"))


def eligible(enriched: DataFrame, include_noise: bool) -> tuple[DataFrame, str]:
    """Events that a role sequence is made of, and their label column."""
    rows = enriched.where("ts is not null").where("role_set_eligible" if include_noise else "non_noise_role_eligible")
    return rows, "analysis_role_label" if include_noise else "candidate_role_label"


def role_vectors(events: DataFrame, lookup: DataFrame, metrics: DataFrame) -> DataFrame:
    """Distinct actors per issue and role, as columns beside the issue's metrics. Here an unset unknown flag means a known actor.

    events that have their roles already (cluster_label, candidate_role_label) are not joined with lookup.
    """
    unknown = F.coalesce(F.col("actor_unknown"), F.lit(False)) if "actor_unknown" in events.columns else F.lit(False)
    of_issues = events.where("event_scope = 'issue_linked'").withColumn("__u", unknown if "actor_unknown" in events.columns else F.col("actor_id").isNull())
    roles = of_issues if "cluster_label" in events.columns else of_issues.join(lookup.select("actor_id", "cluster_label", "candidate_role_label"), "actor_id", "left")
    named = F.when(F.col("cluster_label").isNull(), "Unclustered known actor").when(F.col("cluster_label") == -1, "No primary role label").otherwise(F.col("candidate_role_label"))
    wide = {**ROLE_COLUMNS, "No primary role label": "n_noise_or_boundary_actor", "Unclustered known actor": "n_unclustered_known_actor"}
    # one pass: pairs of known actors, and the events of unknown ones under no role
    known = ~F.col("__u") & F.col("actor_id").isNotNull()
    pairs = roles.groupBy("issue_id", F.when(known, F.col("actor_id")).alias("actor_id"), F.when(known, named).alias("role")).agg(F.count_if("__u").alias("__lost"))
    counted = pairs.groupBy("issue_id").agg(*[F.count_if(F.col("actor_id").isNotNull() & (F.col("role") == r)).alias(c) for r, c in wide.items()], F.sum("__lost").alias("n_actor_unknown_events_recomputed"))
    keep = ["project_name", "issue_id", "time_to_close_days", "n_events", "n_comments", "n_issue_comments", "n_commits", "n_prs", "n_reviews", "n_review_comments", "n_actors", "n_non_noise_actors", "n_noise_actors", "patch_size", "role_set_without_noise"]
    out = metrics.select(*[c for c in keep if c in metrics.columns]).join(counted, "issue_id", "left").fillna(0, [*wide.values(), "n_actor_unknown_events_recomputed"])
    out = out.withColumn("n_stable_role_actors", reduce(lambda a, b: a + b, [F.col(c) for c in ROLE_COLUMNS.values()]))
    return out.withColumn("n_all_counted_known_actors", F.col("n_stable_role_actors") + F.col("n_noise_or_boundary_actor") + F.col("n_unclustered_known_actor")).withColumn("issue_key", F.concat_ws(":", "project_name", "issue_id"))


PATTERN_METRICS = ["time_to_close_days", "n_comments", "n_issue_comments", "n_commits", "n_prs", "n_reviews", "patch_size", "n_stable_role_actors", "n_noise_or_boundary_actor"]


def pattern_summary(vectors: DataFrame, cluster: str = "role_composition_cluster") -> DataFrame:
    """Size, means and medians of each pattern, with its rule-made label."""
    zero = F.count_if(F.col("n_stable_role_actors") == 0)
    aggs = [F.count("*").alias("n_issues"), *[f(c).alias(f"{c}_{n}") for c in PATTERN_METRICS for n, f in (("mean", F.avg), ("median", F.median))], *[f(c).alias(f"{n}_{c}") for c in ROLE_COLUMNS.values() for n, f in (("mean", F.avg), ("median", F.median))]]
    out = vectors.groupBy(cluster).agg(*aggs, zero.alias("has_zero_stable_role_actors_sum"))
    out = out.withColumn("issue_ratio", F.col("n_issues") / F.sum("n_issues").over(Window.partitionBy(F.lit(1)))).withColumn("zero_stable_role_ratio", F.col("has_zero_stable_role_actors_sum") / F.col("n_issues"))
    return out.withColumn("candidate_pattern_label", pattern_label())


def pattern_label() -> Column:
    """The label of a pattern by its role means: the first rule that holds."""
    m = {k: F.col(f"mean_{v}") for k, v in (("fix", "n_fixer"), ("iss", "n_issue_side_participant"), ("pr", "n_pr_integrator"), ("hyb", "n_review_integration_hybrid"), ("rev", "n_review_focused_participant"), ("edge", "n_issue_side_boundary_participant"))}
    some = {k: v >= 0.2 for k, v in m.items()}
    fixer, issue, pr, review = some["fix"], some["iss"] | some["edge"], some["pr"] | some["hyb"], some["rev"] | some["hyb"]
    rules = [
        (F.col("zero_stable_role_ratio") >= 0.5, "No stable role / sparse PR-driven"),
        (reduce(lambda a, b: a + b, m.values()) < 0.25, "No stable role observed"),
        (m["edge"] >= 0.5, "Issue-side boundary / long-running"),
        (m["rev"] >= 0.5, "Review-heavy coordination"),
        ((m["hyb"] >= 0.75) & (m["pr"] >= 1.0), "Review-integration intensive"),
        ((m["pr"] >= 0.5) & (m["fix"] < 0.2), "PR-driven integration"),
        ((m["fix"] >= 0.75) & (m["pr"] >= 0.5), "Code and PR integration"),
        ((m["iss"] >= 0.5) & (m["fix"] >= 0.2), "Issue discussion and fixing"),
        (fixer & ~issue & ~pr & ~review, "Fixer-centered"),
        (issue & ~fixer & ~pr & ~review, "Issue-side dominated"),
        (pr & fixer & ~issue, "Code and PR integration"),
        (pr & ~fixer, "PR/review integration"),
        (review & fixer, "Fixing and review"),
        (issue & fixer, "Issue discussion and fixing"),
    ]
    alone = {"fix": "Fixer-centered", "iss": "Issue-side dominated", "pr": "PR-driven", "hyb": "Review-integration heavy", "rev": "Review-focused", "edge": "Issue-side boundary"}
    top = F.array_max(F.array(*[F.struct(m[k].alias("m"), F.lit(-i).alias("i"), F.lit(v).alias("label")) for i, (k, v) in enumerate(alone.items())]))["label"]
    return reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(rules), top)


def pattern_project_share(vectors: DataFrame, cluster: str = "role_composition_cluster") -> DataFrame:
    return share_within(vectors, cluster, "project_name", "n_issues", "project_ratio_within_pattern")


def share_within(df: DataFrame, group: str, value: str, count: str = "n", ratio: str = "ratio") -> DataFrame:
    """Counts of a column's values within each group, and their share."""
    out = df.groupBy(group, value).agg(F.count("*").alias(count))
    return out.withColumn(ratio, F.col(count) / F.sum(count).over(Window.partitionBy(group)))
