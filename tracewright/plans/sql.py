"""SQL of the lifecycle view and of derived tables, shared by the catalogue's DuckDB counterparts."""

from __future__ import annotations

from tracewright.operators.features import EVENT_COUNTS, ORDER
from tracewright.schemas import CLUSTER_ROLES, LIFECYCLE_STAGES, ROLE_ORDER, SOURCES, STAGE_OF


def case(column: str, values: dict, other: str = "NULL") -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {other} END"


_TAIL = "CAST(0 AS BIGINT) AS files_changed, CAST(0 AS BIGINT) AS lines_added, CAST(0 AS BIGINT) AS lines_deleted, CAST(NULL AS VARCHAR) AS commit_id"
LE = f"""
place AS (SELECT c_custkey, r_name AS project_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
iss AS (SELECT o.*, project_name FROM orders o JOIN place ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P')),
lns AS (SELECT l.*, project_name FROM lineitem l JOIN iss ON l_orderkey = o_orderkey),
raw AS (
SELECT 'issue:issue_created:' || o_orderkey AS event_id, project_name, CAST(o_orderkey AS VARCHAR) AS issue_id, 'c' || o_custkey AS actor_id, o_orderdate AS ts,
 'issue' AS source, 'issue_created' AS event_type, 'issue_linked' AS event_scope, CAST(length(o_orderpriority) AS BIGINT) AS text_length, {_TAIL} FROM iss
UNION ALL SELECT 'commit:commit_authored:issue:' || l_orderkey || ':commit:' || l_orderkey || '-' || l_linenumber, project_name, CAST(l_orderkey AS VARCHAR), 's' || l_suppkey, l_shipdate,
 'commit', 'commit_authored', 'issue_linked', 0, l_linenumber, CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), l_orderkey || '-' || l_linenumber FROM lns
UNION ALL SELECT 'activity:' || event_type || ':' || event_id, project_name, CASE WHEN value > 100 THEN NULL ELSE json_extract_string(props, '$.k') END,
 CASE WHEN user_id % 50 <> 0 THEN 'c' || user_id END, CASE WHEN event_id % 97 <> 0 THEN ts END,
 {case("event_type", {"view": "issue_comment", "click": "event", "purchase": "pull_request", "error": "pull_request_review", "signup": "event"})},
 {case("event_type", {"view": "issue_comment_added", "click": "status_changed", "purchase": "pr_opened", "error": "review_submitted", "signup": "issue_closed"})},
 CASE WHEN value > 100 THEN 'project_level' ELSE 'issue_linked' END, CAST(floor(value) AS BIGINT), {_TAIL} FROM events JOIN place ON user_id = c_custkey
UNION ALL SELECT 'event:issue_resolved:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, project_name, CAST(l_orderkey AS VARCHAR), 's' || l_suppkey, l_shipdate,
 'event', 'issue_resolved', 'issue_linked', 0, {_TAIL} FROM lns WHERE l_returnflag = 'R'),
le AS (SELECT event_id, project_name, issue_id, actor_id, ts, source, event_type, {case("event_type", STAGE_OF, "'unknown'")} AS lifecycle_stage, event_scope, text_length, files_changed, lines_added, lines_deleted, commit_id FROM raw)"""

RANK = case("label", {r: i for i, r in enumerate(ROLE_ORDER)}, "999")
ROLE = f"""
role AS (SELECT actor_id, cluster_label, {case("cluster_label", CLUSTER_ROLES)} AS candidate_role_label FROM (
 SELECT DISTINCT actor_id, CAST(n % 7 - 1 AS INT) AS cluster_label FROM (SELECT actor_id, CAST(substr(actor_id, 2) AS BIGINT) AS n FROM le WHERE actor_id IS NOT NULL) WHERE n % 11 <> 0))"""

_c = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"
_commit = "(source = 'commit' OR event_type = 'commit_authored')"
AF = f"""
known AS (SELECT * REPLACE (nullif(issue_id, '') AS issue_id) FROM le WHERE actor_id IS NOT NULL),
gaps AS (SELECT actor_id, median(h) AS median_inter_event_hours FROM (SELECT actor_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY actor_id ORDER BY ts, lifecycle_stage)) / 3.6e9 AS h FROM known WHERE ts IS NOT NULL) GROUP BY 1),
agg AS (SELECT actor_id, count(*) AS total_events, count(DISTINCT project_name) AS n_projects, count(DISTINCT issue_id) AS n_unique_issues, count(DISTINCT CAST(ts AS DATE)) AS active_days, false AS is_bot,
 {_c("event_scope = 'issue_linked'", "n_issue_linked_events")}, {_c("event_scope = 'project_level'", "n_project_level_events")},
 {", ".join(_c(f"event_type = '{v}'", k) for k, v in EVENT_COUNTS.items())},
 count(DISTINCT issue_id) FILTER (WHERE event_type = 'issue_comment_added') AS n_unique_issues_commented, median(text_length) FILTER (WHERE event_type = 'issue_comment_added') AS median_comment_length,
 {_c("event_type = 'issue_field_changed' AND lifecycle_stage = 'unknown'", "n_unknown_issue_field_changes")}, count(DISTINCT commit_id) FILTER (WHERE {_commit}) AS n_commits_linked_to_bug,
 {", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE {_commit}), 0) AS BIGINT) AS n_{c}" for c in ("files_changed", "lines_added", "lines_deleted"))},
 {_c("source = 'pull_request'", "n_pr_events_total")}, {_c("source = 'pull_request_review_comment'", "n_pr_review_comments")}, {_c("lifecycle_stage = 'closure'", "n_final_status_changes")},
 {", ".join(f"count(*) FILTER (WHERE lifecycle_stage = '{x}') / count(*) AS {x}_ratio" for x in LIFECYCLE_STAGES)},
 {", ".join(f"count(*) FILTER (WHERE source = '{x}') / count(*) AS {x}_ratio" for x in SOURCES)},
 min(ts) AS first_event_at, max(ts) AS last_event_at,
 first(lifecycle_stage ORDER BY ts, lifecycle_stage) FILTER (WHERE ts IS NOT NULL) AS first_lifecycle_stage, first(lifecycle_stage ORDER BY ts DESC, lifecycle_stage DESC) FILTER (WHERE ts IS NOT NULL) AS last_lifecycle_stage
 FROM known GROUP BY actor_id),
af AS (SELECT {", ".join(ORDER)} FROM (SELECT *, n_issue_linked_events / total_events AS issue_linked_ratio, n_project_level_events / total_events AS project_level_ratio,
 ln(1 + greatest(n_lines_added + n_lines_deleted, 0)) AS n_lines_added_deleted_log, (total_events < 3 OR n_unique_issues < 2) AS is_low_activity FROM agg LEFT JOIN gaps USING (actor_id)))"""

ISSUES = f"""
enr AS (SELECT e.*, actor_id IS NOT NULL AS known_a, cluster_label, candidate_role_label, cluster_label IS NOT NULL AS clustered, actor_id IS NOT NULL AND cluster_label IS NULL AS unclustered, coalesce(cluster_label = -1, false) AS noise,
 CASE WHEN cluster_label = -1 THEN 'noise_or_boundary' ELSE candidate_role_label END AS analysis_role_label
 FROM le e LEFT JOIN role USING (actor_id) WHERE event_scope = 'issue_linked' AND issue_id IS NOT NULL),
lab AS (SELECT DISTINCT issue_id, analysis_role_label AS label, noise FROM enr WHERE clustered),
rset AS (SELECT issue_id, string_agg(label, ' + ' ORDER BY r, label) AS role_set_with_noise, string_agg(label, ' + ' ORDER BY r, label) FILTER (WHERE NOT noise) AS role_set_without_noise FROM (SELECT issue_id, label, noise, {RANK} AS r FROM lab) GROUP BY 1),
iset AS (SELECT issue_id, max(project_name) AS project_name, count(*) FILTER (WHERE NOT known_a) AS n_actor_unknown_events, count(*) FILTER (WHERE unclustered) AS n_unclustered_actor_events,
 count(DISTINCT actor_id) AS n_actors, count(DISTINCT actor_id) FILTER (WHERE clustered) AS n_clustered_actors, count(DISTINCT actor_id) FILTER (WHERE unclustered) AS n_unclustered_actors,
 count(DISTINCT actor_id) FILTER (WHERE noise) AS n_noise_actors, count(DISTINCT actor_id) FILTER (WHERE clustered AND NOT noise) AS n_non_noise_actors FROM enr GROUP BY 1),
isets AS (SELECT i.*, coalesce(role_set_with_noise, 'NO_CLUSTERED_ROLE') AS role_set_with_noise, coalesce(role_set_without_noise, 'NO_NON_NOISE_ROLE') AS role_set_without_noise,
 role_set_with_noise IS NOT NULL AS has_role_set_with_noise, role_set_without_noise IS NOT NULL AS has_role_set_without_noise,
 CAST(coalesce(len(string_split(role_set_with_noise, ' + ')), 0) AS INT) AS n_roles_with_noise, CAST(coalesce(len(string_split(role_set_without_noise, ' + ')), 0) AS INT) AS n_roles_without_noise FROM iset i LEFT JOIN rset USING (issue_id)),
life AS (SELECT issue_id, max(project_name) AS project_name, min(ts) AS first_event_at, max(ts) AS last_event_at, min(ts) FILTER (WHERE event_type = 'issue_created') AS issue_created_at,
 max(ts) FILTER (WHERE event_type IN ('issue_closed', 'issue_resolved') OR lifecycle_stage = 'closure') AS issue_closed_or_resolved_at, count(*) AS n_events,
 count(*) FILTER (WHERE source IN ('issue_comment', 'pull_request_comment', 'pull_request_review_comment')) AS n_comments,
 count(*) FILTER (WHERE source = 'issue_comment' OR event_type = 'issue_comment_added') AS n_issue_comments,
 count(*) FILTER (WHERE source IN ('pull_request_comment', 'pull_request_review_comment') OR event_type = 'review_comment_added') AS n_review_comments,
 count(DISTINCT coalesce(nullif(commit_id, ''), event_id)) FILTER (WHERE source = 'commit' OR event_type = 'commit_authored') AS n_commits,
 count(DISTINCT event_id) FILTER (WHERE source = 'pull_request' OR event_type IN ('pr_opened', 'pr_closed', 'pr_merged')) AS n_prs,
 count(DISTINCT event_id) FILTER (WHERE source = 'pull_request_review' OR event_type = 'review_submitted') AS n_reviews,
 CAST(sum(files_changed) AS BIGINT) AS files_changed, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_deleted) AS BIGINT) AS lines_deleted, CAST(sum(lines_added) + sum(lines_deleted) AS BIGINT) AS patch_size,
 count(*) FILTER (WHERE ts IS NULL) AS n_timestamp_missing_events FROM enr GROUP BY 1),
met AS (SELECT l.*, role_set_with_noise, role_set_without_noise, n_actors, n_clustered_actors, n_non_noise_actors, n_noise_actors, n_unclustered_actors, n_actor_unknown_events, n_unclustered_actor_events, has_role_set_with_noise, has_role_set_without_noise,
 CASE WHEN issue_closed_or_resolved_at >= issue_created_at THEN (epoch_us(issue_closed_or_resolved_at) - epoch_us(issue_created_at)) / 3.6e9 END AS time_to_close_hours,
 CASE WHEN issue_closed_or_resolved_at >= issue_created_at THEN (epoch_us(issue_closed_or_resolved_at) - epoch_us(issue_created_at)) / 8.64e10 END AS time_to_close_days,
 contains(role_set_without_noise, 'Fixer / Code Contributor') AS has_fixer, contains(role_set_without_noise, 'Review-focused Participant') AS has_reviewer, contains(role_set_without_noise, 'PR Integrator') AS has_integrator,
 contains(role_set_without_noise, 'Issue-side Participant') AS has_issue_side_participant, contains(role_set_without_noise, 'Review-Integration Hybrid') AS has_review_integration_hybrid
 FROM life l JOIN (SELECT * EXCLUDE (project_name) FROM isets) USING (issue_id))"""


def over(*parts: str, select: str) -> str:
    """A query over the named views; le is always there."""
    return "WITH " + ",".join([LE, *parts]) + "\n" + select
