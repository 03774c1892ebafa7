"""Schemas and fixed vocabularies of the lifecycle event log."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"string": StringType(), "long": LongType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def struct(ddl: str) -> StructType:
    """A flat schema of the four types above; unlike fromDDL it needs no session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(","))])


EVENTS = struct(
    "event_id string, project_id string, project_name string, issue_id string, issue_external_id string, actor_id_raw string, "
    "actor_role_raw string, timestamp timestamp, source string, event_type string, lifecycle_stage string, target_id string, "
    "event_scope string, linkage_type string, text_available boolean, text_length long, files_changed long, lines_added long, "
    "lines_deleted long, pr_id string, review_id string, commit_id string, metadata_json string"
)
WARNINGS = struct("project_name string, project_id string, event_id string, warning_type string, source string, event_type string, message string")
COUNT_DIMS = ["project_name", "project_id", "source", "event_type", "lifecycle_stage", "event_scope", "linkage_type"]

# Names that stored event logs and published tables use.
LIFECYCLE_STAGES = ["reporting", "discussion", "triage", "fixing", "integration", "review", "closure", "unknown"]
SOURCES = ["issue", "issue_comment", "event", "commit", "pull_request", "pull_request_comment", "pull_request_review", "pull_request_review_comment"]
STAGE_OF = {
    "issue_created": "reporting",
    "issue_comment_added": "discussion",
    "status_changed": "triage",
    "priority_changed": "triage",
    "assignee_changed": "triage",
    "resolution_changed": "triage",
    "commit_authored": "fixing",
    "pr_opened": "integration",
    "pr_closed": "integration",
    "pr_merged": "integration",
    "review_submitted": "review",
    "review_comment_added": "review",
    "issue_closed": "closure",
    "issue_resolved": "closure",
}
BOT_RULES = {
    "contains_bot": "bot",
    "jenkins": "jenkins",
    "travis": "travis",
    "github_actions": "github[-_ ]actions",
    "dependabot": "dependabot",
    "asfbot": "asfbot",
    "automation": "automation",
    "ci": "(^|[^a-z0-9])ci([^a-z0-9]|$)",
    "build": "build",
    "sonar": "sonar",
    "codecov": "codecov",
    "coveralls": "coveralls",
}
NOISE_ROLE = "noise_or_boundary"
ROLE_ORDER = ["Issue-side Boundary Participant", "Issue-side Participant", "Fixer / Code Contributor", "Review-focused Participant", "Review-Integration Hybrid", "PR Integrator", NOISE_ROLE]
CLUSTER_ROLES = {-1: "No candidate role label", 0: "Issue-side Boundary Participant", 1: "Fixer / Code Contributor", 2: "Issue-side Participant", 3: "Review-focused Participant", 4: "Review-Integration Hybrid", 5: "PR Integrator"}
NO_CLUSTERED_ROLE, NO_NON_NOISE_ROLE = "NO_CLUSTERED_ROLE", "NO_NON_NOISE_ROLE"
ROLE_COLUMNS = {
    "Fixer / Code Contributor": "n_fixer",
    "Issue-side Participant": "n_issue_side_participant",
    "PR Integrator": "n_pr_integrator",
    "Review-Integration Hybrid": "n_review_integration_hybrid",
    "Review-focused Participant": "n_review_focused_participant",
    "Issue-side Boundary Participant": "n_issue_side_boundary_participant",
}
ROLE_SIGNALS = {
    "Reporter": ["reporting_ratio", "issue_ratio", "n_issues_reported"],
    "Discussion Participant": ["discussion_ratio", "issue_comment_ratio", "n_issue_comments"],
    "Triager / Workflow Manager": ["triage_ratio", "event_ratio", "n_status_changes", "n_resolution_changes", "n_assignee_changes"],
    "Fixer": ["fixing_ratio", "commit_ratio", "n_bugfix_commits_authored", "n_commits_linked_to_bug"],
    "Integrator": ["integration_ratio", "pull_request_ratio", "n_prs_opened", "n_prs_closed", "n_prs_merged"],
    "Reviewer": ["review_ratio", "pull_request_comment_ratio", "pull_request_review_ratio", "pull_request_review_comment_ratio", "n_reviews_submitted", "n_review_comments"],
}
SCORE_WEIGHTS = {
    "n_closed_bug_issues": 0.20,
    "n_issue_events": 0.15,
    "n_linked_commits": 0.15,
    "n_commits": 0.10,
    "n_issue_comments": 0.10,
    "n_pull_requests": 0.10,
    "n_reviews": 0.10,
    "n_actors_estimated": 0.10,
}
