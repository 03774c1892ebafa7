"""Queries of reviews and reports: the frames that a report lists, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import issues, prep, profiles, quality, review, selection, stats
from tracewright.operators.features import ORDER
from tracewright.plans.log_queries import _LAB, _VEC, _enriched, _features, _flat, _metrics, _patterned, _sequence, _vectors
from tracewright.plans.model_queries import _GRID, _LBL, _PROJECTS, _REPR, _SWEEP, _TWO, _Z, K_SWEEP, MODEL, SIGNALS, SWEEP_COLUMNS, _cells, _labelled, _projects, _top, _two
from tracewright.plans.sql import AF, ISSUES, ROLE, over
from tracewright.schemas import CLUSTER_ROLES
from tracewright.sources.tables import event_log, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "absent_one"]
DECLARED = [("events", "k", True), ("events", "v", True), ("events", "w", False)]
FLAGS = ["has_fixer", "has_reviewer", "has_integrator", "has_issue_side_participant", "has_review_integration_hybrid"]
_COVER = "SELECT count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) / count(*) FROM events"


def _catalog(s, d):
    return review.catalog({t: table(s, d, t) if t != "absent_one" else None for t in TABLES}, TABLES)


def _schema_map(s, d):
    cover = quality.field_coverage(table(s, d, "events"), "props")
    total = F.col("present") + F.col("nulls") + F.col("missing")
    seen = cover.select(F.lit("events").alias("collection"), F.col("path").alias("field"), (F.col("present") / total).alias("present_rate"))
    return _flat(review.schema_map(s.createDataFrame(DECLARED, "collection string, field string, is_required boolean"), seen))


def _statuses(s, d):
    o = table(s, d, "orders")
    by = o.groupBy(F.col("o_orderpriority").alias("collection")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count("*").alias("n"))
    return by.select("collection", F.when(F.col("p") % 2 == 0, "ok").otherwise("failed").alias("count_status"), F.when(F.col("n") % 3 > 0, "ok").alias("field_audit_status"))


def _trends(s, d):
    out = issues.outcomes(_metrics(s, d)).persist()  # a row a role set, read twice
    return _flat(review.trend(out, "median_time_to_close_days", 3).unionByName(review.trend(out, "median_patch_size", 3)))


def _trend_sql(c):
    return f"SELECT '{c}' AS measure, count(*) AS n_eligible, first(role_set ORDER BY {c}, role_set) AS lowest, round(CAST(min({c}) AS DOUBLE), 6) AS lowest_value, first(role_set ORDER BY {c} DESC, role_set) AS highest, round(CAST(max({c}) AS DOUBLE), 6) AS highest_value FROM oc WHERE issue_count >= 3 AND {c} IS NOT NULL"


_OUTCOME = "oc AS (SELECT role_set_without_noise AS role_set, count(*) AS issue_count, median(time_to_close_days) AS median_time_to_close_days, median(patch_size) AS median_patch_size FROM met WHERE has_role_set_without_noise GROUP BY 1)"
# the sequence in the noise-including scope: noise counts by its analysis label
_NSEQ = "nseq AS (SELECT issue_id, ts, event_id, label FROM (SELECT issue_id, ts, event_id, label, lag(label) OVER (PARTITION BY issue_id ORDER BY ts, event_id, label) AS b FROM (SELECT issue_id, ts, event_id, analysis_role_label AS label FROM enr WHERE clustered AND ts IS NOT NULL)) WHERE b IS NULL OR b <> label)"


def _profiles_two(s, d):
    labelled, events = _labelled(s, d)
    return profiles.profiles(labelled, events).persist(), labelled  # a row a cluster, checked before it is used


def _taxonomy(s, d):
    prof, labelled = _profiles_two(s, d)
    stable = labelled.groupBy("cluster_label").agg(F.avg("cluster_probability").alias("stability_mean"))
    out = review.taxonomy(prof, profiles.top_features(labelled, SIGNALS, 10), stable, CLUSTER_ROLES)
    return _flat(out.select("cluster_label", "candidate_role_label", "n_actors", "stability_mean", "top_feature_text"))


_TOP6 = "t6 AS (SELECT cluster_label, string_agg(feature, '; ' ORDER BY k) AS top_feature_text FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY standardized_mean DESC, feature) AS k FROM zl) WHERE k <= 6 GROUP BY 1)"
_NAMES_SQL = "nn(cluster_label, candidate_role_label) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CLUSTER_ROLES.items()) + ")"


def _metrics_of(section, source, metrics):
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM {source}" for n, c in metrics.items())


def _report(section, frame, spark_metrics, source, sql_metrics, *parts):
    """A report's metric list: Spark expressions over a frame, and the same in SQL over a view."""
    run = lambda s, d: _flat(review.metric_frame(frame(s, d), section, {n: F.expr(c) for n, c in spark_metrics.items()}))
    return run, over(*parts, select=_metrics_of(section, source, sql_metrics))


def _same(**metrics):
    return metrics, {n: c.replace("count_if(", "count(*) FILTER (WHERE ") for n, c in metrics.items()}


def _reports():
    log, log_sql = _same(n_events="count(*)", n_missing_timestamp="count_if(ts IS NULL)", n_missing_actor="count_if(actor_id IS NULL)", n_issue_linked="count_if(event_scope = 'issue_linked')", n_sources="count(DISTINCT source)")
    who, who_sql = _same(n_actors="count(DISTINCT actor_id)", n_unknown="count_if(actor_id IS NULL)", n_projects="count(DISTINCT project_name)")
    feat, feat_sql = _same(n_actors="count(*)", n_low_activity="count_if(is_low_activity)", n_bots="count_if(is_bot)", mean_events="avg(total_events)", max_events="max(total_events)", median_events="median(total_events)")
    proj, proj_sql = _same(n_projects="count(*)", n_closed_bug_issues="sum(n_closed_bug_issues)", n_commits="sum(n_commits)", n_with_reviews="count_if(n_reviews > 0)")
    life, life_sql = _same(n_issues="count(*)", n_closed="count_if(time_to_close_days IS NOT NULL)", median_days="median(time_to_close_days)", mean_commits="avg(n_commits)", n_without_role="count_if(NOT has_role_set_without_noise)")
    vec, vec_sql = _same(n_vectors="count(*)", n_zero_stable="count_if(n_stable_role_actors = 0)", mean_stable_actors="avg(n_stable_role_actors)", n_patterns="count(DISTINCT role_composition_cluster)")
    prof, prof_sql = _same(n_clusters="count(DISTINCT cluster_label)", n_noise="count_if(cluster_label = -1)", n_actors="count(*)", mean_probability="avg(cluster_probability)")
    agree, agree_sql = _same(n="count(*)", n_noise="count_if(original = -1)", n_noise_again="count_if(original = -1 AND other = -1)", n_clusters="count(DISTINCT original)")
    return {
        "report_extraction": _report("extraction", event_log, log, "le", log_sql),
        "report_normalization": _report("normalization", event_log, who, "le", who_sql),
        "report_availability": _report("availability", _projects, proj, "prj", proj_sql, _PROJECTS),
        "report_features": _report("features", _features, feat, "af", feat_sql, AF),
        "report_profiles": _report("profiles", lambda s, d: _labelled(s, d)[0], prof, "lf", prof_sql, ROLE, AF, _LBL),
        "report_stability": _report("stability", _two, agree, "two", agree_sql, _TWO),
        "report_lifecycle": _report("lifecycle", _metrics, life, "met", life_sql, ROLE, ISSUES),
        "report_patterns": _report("patterns", _patterned, vec, "pat", vec_sql, ROLE, ISSUES, _VEC),
    }


def _subgroups(s, d):
    lab, _ = _labelled(s, d)
    return review.top_of_subgroup(lab.where("cluster_label = 2").select(F.col("first_lifecycle_stage").alias("subgroup"), "actor_id", "total_events"), "subgroup", "total_events", "actor_id")


def _sample(s, d):
    lab, events = _labelled(s, d)
    reps = profiles.representatives(lab, 3)
    return review.sample_coverage(profiles.timeline(events, reps, 5).join(F.broadcast(reps.select("actor_id", "cluster_label")), "actor_id"), ["cluster_label"], "actor_id")  # three actors a cluster


_MISS = " UNION ALL ".join(f"SELECT 'actor_features' AS collection, '{c}' AS field, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_rate FROM af" for c in ORDER)
_ANY_ID = "CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN upper(substr(md5(url), 1, 24)) WHEN page_id % 4 = 2 THEN md5(url) ELSE 'x' END"

QUERIES: dict = {
    "collection_catalog": (_catalog, " UNION ALL ".join(f"SELECT '{t}' AS collection, {'true' if t != 'absent_one' else 'false'} AS is_present, {f'(SELECT count(*) FROM {t})' if t != 'absent_one' else 'CAST(0 AS BIGINT)'} AS n_documents" for t in TABLES)),
    "collection_storage": (lambda s, d: review.storage(s, {t: f"{d}/{t}.parquet" for t in TABLES[:3]}), None),
    "document_counts": (lambda s, d: review.count_where(table(s, d, "orders"), {"closed": "o_orderstatus = 'F'", "urgent": "o_orderpriority = '1-URGENT'", "none": "o_orderkey IS NULL"}), "SELECT 'closed' AS name, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_documents FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders UNION ALL SELECT 'none', CAST(0 AS BIGINT)"),
    "limited_scan": (lambda s, d: review.sampled(table(s, d, "events"), 100).agg(F.count("*").alias("n")), "SELECT least(count(*), 100) AS n FROM events"),
    "schema_map": (_schema_map, f"SELECT 'events' AS collection, field, is_required, field = 'k' AS is_observed, CASE WHEN field = 'k' THEN round(({_COVER}), 6) ELSE 0 END AS present_rate, CASE WHEN field = 'v' THEN 'required field events.v was not observed' END AS warning FROM (VALUES ('k', true), ('v', true), ('w', false)) AS t(field, is_required)"),
    "audit_errors": (lambda s, d: review.audit_errors(_statuses(s, d), ["count_status", "field_audit_status"]), "WITH b AS (SELECT o_orderpriority AS collection, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY 1) SELECT collection, 'count_status' AS \"check\", 'failed' AS status FROM b WHERE p % 2 <> 0 UNION ALL SELECT collection, 'field_audit_status', 'missing' FROM b WHERE n % 3 = 0"),
    "missingness_hotspots": (lambda s, d: _flat(review.missingness_hotspots(quality.column_missingness(_features(s, d)).select(F.lit("actor_features").alias("collection"), F.col("feature").alias("field"), "missing_rate"))), over(AF, select=f"SELECT * FROM ({_MISS}) ORDER BY missing_rate DESC, collection, field LIMIT 30")),
    "id_parse_warnings": (lambda s, d: table(s, d, "pages").select("page_id", *(c.alias(n) for c, n in zip(review.parse_id(F.expr(_ANY_ID), "page"), ("id", "warning"), strict=True))), f"SELECT page_id, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]{{24}}') THEN lower(v) END AS id, CASE WHEN NOT regexp_full_match(v, '[0-9a-fA-F]{{24}}') THEN 'page is not an id: ' || v END AS warning FROM (SELECT page_id, {_ANY_ID} AS v FROM pages)"),
    "non_empty_lists": (lambda s, d: table(s, d, "part").select("p_partkey", review.non_empty(F.when(F.col("p_partkey") % 3 > 0, F.filter(F.split("p_name", " "), lambda x: F.length(x) > 5))).alias("has_long_word")), "SELECT p_partkey, p_partkey % 3 > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 5)) > 0 AS has_long_word FROM part"),
    "project_zero_fill": (lambda s, d: review.zero_filled(table(s, d, "nation").select("n_nationkey"), table(s, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers")), "n_nationkey"), "SELECT n_nationkey, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1"),
    "outcome_trends": (_trends, over(ROLE, ISSUES, _OUTCOME, select=" UNION ALL ".join(_trend_sql(c) for c in ("median_time_to_close_days", "median_patch_size")))),
    "role_sequences_with_noise": (lambda s, d: (lambda r: _flat(issues.sequence_summary(r[0], "issue_id", ["ts", "event_id", r[1]], r[1])))(_sequence(s, d, True)), over(ROLE, ISSUES, _NSEQ, select="SELECT role_sequence, count(*) AS n_issues, round(median(n), 6) AS median_sequence_length FROM (SELECT issue_id, string_agg(label, ' -> ' ORDER BY ts, event_id, label) AS role_sequence, count(*) AS n FROM nseq GROUP BY 1) GROUP BY 1")),
    "role_transitions_with_noise": (lambda s, d: (lambda r: issues.transitions(r[0], "issue_id", ["ts", "event_id", r[1]], r[1]))(_sequence(s, d, True)), over(ROLE, ISSUES, _NSEQ, select="SELECT label AS from_role, nxt AS to_role, count(*) AS n_transitions, count(DISTINCT issue_id) AS n_issues FROM (SELECT issue_id, label, lead(label) OVER (PARTITION BY issue_id ORDER BY ts, event_id, label) AS nxt FROM nseq) WHERE nxt IS NOT NULL GROUP BY 1, 2")),
    "role_indicator_coverage": (lambda s, d: _flat(review.indicator_coverage(_metrics(s, d), FLAGS)), over(ROLE, ISSUES, select=" UNION ALL ".join(f"SELECT '{c}' AS indicator, count(*) FILTER (WHERE {c}) AS n_true, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS share FROM met" for c in FLAGS))),
    "k_rank_by_quality": (lambda s, d: stats.rank_k_by_quality(s.createDataFrame(K_SWEEP, SWEEP_COLUMNS)).select("k", "rank_sum", "selected"), f"WITH {_SWEEP}, r AS (SELECT *, rank() OVER (ORDER BY silhouette DESC) + rank() OVER (ORDER BY davies_bouldin) + rank() OVER (ORDER BY calinski_harabasz DESC) AS rank_sum FROM sw) SELECT k, rank_sum, row_number() OVER (ORDER BY rank_sum, silhouette DESC, k) = 1 AS selected FROM r"),
    "selected_k_or_first": (lambda s, d: review.selected_k(s.createDataFrame([(3, False), (4, False)], "k int, selected boolean"), table(s, d, "embeddings").select((F.col("label") + 2).alias("k"))).select(F.col("k").cast("long").alias("k")), "SELECT CAST(min(label + 2) AS BIGINT) AS k FROM embeddings"),
    "distinct_feature_rows": (lambda s, d: review.distinct_rows(_vectors(s, d), ["n_fixer", "n_pr_integrator", "n_issue_side_participant"]), over(ROLE, ISSUES, _VEC, select="SELECT count(*) AS n_distinct FROM (SELECT DISTINCT n_fixer, n_pr_integrator, n_issue_side_participant FROM vec)")),
    "transform_log": (lambda s, d: prep.transform_log(_features(s, d)), over(AF, select=" UNION ALL ".join(f"SELECT '{c}' AS feature, '{prep.feature_kind(c)}' AS feature_kind, {'true' if prep.feature_kind(c) == 'count' else 'false'} AS is_logged, true AS is_capped, true AS is_scaled, {chr(39) + 'missing_flag_plus_zero_imputation' + chr(39) if c == 'median_comment_length' else chr(39) + 'none' + chr(39)} AS action, {'count(*) FILTER (WHERE median_comment_length IS NULL)' if c == 'median_comment_length' else 'CAST(0 * count(*) AS BIGINT)'} AS missing_count_before FROM af" for c in [*MODEL, prep.FLAG]))),
    "top_feature_text": (lambda s, d: review.feature_text(_top(s, d)), over(ROLE, AF, _LBL, _Z, _TOP6, select="SELECT * FROM t6")),
    "role_taxonomy": (_taxonomy, over(ROLE, AF, _LBL, _Z, _TOP6, _NAMES_SQL, select="SELECT f.*, candidate_role_label, top_feature_text FROM (SELECT cluster_label, count(*) AS n_actors, round(avg(cluster_probability), 6) AS stability_mean FROM lf GROUP BY 1) f JOIN nn USING (cluster_label) JOIN t6 USING (cluster_label)")),
    "role_evidence": (lambda s, d: (lambda p, lab: review.taxonomy(p, profiles.top_features(lab, SIGNALS, 10), lab.groupBy("cluster_label").agg(F.count("*").alias("n")), CLUSTER_ROLES).select("cluster_label", "evidence_summary"))(*_profiles_two(s, d)), over(ROLE, AF, _LBL, _Z, _TOP6, "st AS (SELECT cluster_label, lifecycle_stage, count(*) / sum(count(*)) OVER (PARTITION BY cluster_label) AS ratio, row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, lifecycle_stage) AS k FROM le JOIN role USING (actor_id) GROUP BY 1, 2)", select="SELECT cluster_label, 'dominant stage ' || lifecycle_stage || ' (' || printf('%.3f', ratio) || '); top features ' || top_feature_text AS evidence_summary FROM st JOIN t6 USING (cluster_label) WHERE k = 1")),
    "forbidden_labels": (lambda s, d: table(s, d, "part").select("p_partkey", review.has_forbidden(F.concat("p_type", F.when(F.col("p_partkey") % 5 == 0, " Team LEADER"))).alias("is_forbidden")), "SELECT p_partkey, coalesce(contains(lower(CASE WHEN p_partkey % 5 = 0 THEN p_type || ' Team LEADER' END), 'leader'), false) AS is_forbidden FROM part"),
    "subgroup_top_actors": (_subgroups, over(ROLE, AF, _LBL, select="SELECT * FROM (SELECT first_lifecycle_stage AS subgroup, actor_id, total_events, row_number() OVER (PARTITION BY first_lifecycle_stage ORDER BY total_events DESC, actor_id) AS rank FROM lf WHERE cluster_label = 2) WHERE rank <= 3")),
    "validation_coverage": (_sample, over(ROLE, AF, _LBL, _REPR, select="SELECT cluster_label, count(DISTINCT actor_id) AS n_actors FROM rp WHERE rank <= 3 GROUP BY 1")),
    "chi_square_p": (lambda s, d: _flat(stats.chi_square(stats.dense_grid(_cells(s, d), "lang", "source"), "lang", "source").select("dof", stats.chi_square_p(F.col("chi2"), F.col("dof")).alias("p_value"))), f"WITH {_GRID} SELECT dof, round(greatest(0, 1 - exp(a * ln(x) - x - lgamma(a + 1)) * (1 + (SELECT sum(exp(n * ln(x) - (lgamma(a + n + 1) - lgamma(a + 1)))) FROM range(1, 401) AS t(n)))), 6) AS p_value FROM (SELECT (r - 1) * (c - 1) AS dof, (r - 1) * (c - 1) / 2 AS a, chi2 / 2 AS x FROM q)"),
    "pattern_labels_count": (lambda s, d: issues.pattern_summary(_patterned(s, d)).groupBy("candidate_pattern_label").agg(F.count("*").alias("n_patterns")), over(ROLE, ISSUES, _VEC, _LAB, select="SELECT candidate_pattern_label, count(*) AS n_patterns FROM lbl GROUP BY 1")),
    "candidate_projects_report": (lambda s, d: selection.candidates(selection.usable_score(_projects(s, d))).select("candidate_rank", "project_name", "usable_score"), over(_PROJECTS, select="SELECT row_number() OVER (ORDER BY usable_score DESC, n_closed_bug_issues DESC, n_linked_commits DESC, project_name) AS candidate_rank, project_name, usable_score FROM sc")),
    "enriched_by_scope": (lambda s, d: _enriched(s, d).groupBy("source").agg(F.count("*").alias("n_events"), F.count_if("is_noise_cluster").alias("n_noise")), over(ROLE, ISSUES, select="SELECT source, count(*) AS n_events, count(*) FILTER (WHERE noise) AS n_noise FROM enr GROUP BY 1")),
    "event_length_summary": (lambda s, d: _flat(stats.summary(event_log(s, d), ["text_length", "files_changed", "lines_added"])), over(select=" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS runs, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM le" for c in ("text_length", "files_changed", "lines_added")))),
    **_reports(),
}
