"""Project availability: usability score, thresholds and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import SCORE_WEIGHTS

#: Least counts of a usable project.
MINIMUMS = {"n_closed_bug_issues": 100, "n_issue_comments": 1000, "n_issue_events": 1000, "n_linked_commits": 100, "n_commits": 500, "n_pull_requests": 100, "n_reviews": 100, "n_actors_estimated": 100}


def usable_score(projects: DataFrame) -> DataFrame:
    """projects with usable_score: weighted log shares of each metric's maximum, 0 to 100; a metric without any counts as 0."""
    top = projects.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f"__{c}") for c in SCORE_WEIGHTS])
    part = lambda c, w: F.lit(w) * F.log1p(F.col(c).cast("double")) / F.when(F.col(f"__{c}") > 0, F.log1p(F.col(f"__{c}").cast("double"))).otherwise(1.0)
    score = reduce(lambda a, b: a + b, [part(c, w) for c, w in SCORE_WEIGHTS.items()])
    return projects.crossJoin(F.broadcast(top)).withColumn("usable_score", F.round(score * 100, 3)).select(*projects.columns, "usable_score")  # top is one row


def availability_flags(projects: DataFrame) -> DataFrame:
    issue, vcs, pr = F.col("n_issue_events") + F.col("n_issue_comments") > 0, F.col("n_commits") > 0, F.col("n_pull_requests") > 0
    return projects.withColumns({"has_issue_data": issue, "has_vcs_data": vcs, "has_pr_data": pr, "has_bug_lifecycle_sources": issue & vcs & pr & (F.col("n_closed_bug_issues") > 0)})


def threshold_problems(projects: DataFrame, minimums: dict[str, int] = MINIMUMS) -> DataFrame:
    """projects with problems: a sentence for each metric under its minimum, joined by semicolons."""
    said = [F.when(F.col(c) < n, F.format_string(f"{c}=%d below minimum {n}", F.col(c))) for c, n in minimums.items()]
    return projects.withColumn("problems", F.array_join(F.array(*said), "; "))


def selection_reason(projects: DataFrame) -> DataFrame:
    text = "Pilot target: strong bug-fixing lifecycle coverage with %d closed bug issues, %d issue comments, %d issue events, %d linked commits, %d pull requests, %d reviews, and %d observed actors."
    cols = ["n_closed_bug_issues", "n_issue_comments", "n_issue_events", "n_linked_commits", "n_pull_requests", "n_reviews", "n_actors_estimated"]
    return projects.withColumn("selection_reason", F.format_string(text, *[F.col(c).cast("long") for c in cols]))


def candidates(projects: DataFrame, n: int = 10) -> DataFrame:
    w = Window.orderBy(F.desc("usable_score"), F.desc("n_closed_bug_issues"), F.desc("n_linked_commits"), "project_name")
    return projects.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= n)
