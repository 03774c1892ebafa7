"""Cluster profiles: distributions, standout features, representatives and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.issues import share_within
from tracewright.schemas import ROLE_SIGNALS


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group and its share; ties go to the first value."""
    return first_of(share_within(df, group, value), group, value)


def first_of(shares: DataFrame, group: str, value: str) -> DataFrame:
    return shares.groupBy(group).agg(F.min_by(F.struct(value, "n", "ratio"), F.struct(-F.col("n"), F.col(value))).alias("t")).select(group, f"t.{value}", "t.n", "t.ratio")


def cluster_means(labelled: DataFrame, columns: list[str]) -> DataFrame:
    return labelled.groupBy("cluster_label").agg(F.count("*").alias("n_actors"), *[F.avg(c).alias(c) for c in columns])


def top_features(labelled: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The n highest and lowest mean z-scores (sample deviation; none: 0) of each cluster."""
    stats = labelled.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.nullif(f"__s_{c}", F.lit(0.0)), F.lit(0.0))
    means = labelled.crossJoin(F.broadcast(stats)).groupBy("cluster_label").agg(*[F.avg(z(c)).alias(c) for c in columns])  # stats is one row
    long = means.select("cluster_label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 9).alias("standardized_mean")) for c in columns])).alias("x")).select("cluster_label", "x.*")
    rank = lambda o: F.row_number().over(Window.partitionBy("cluster_label").orderBy(o, "feature"))
    top = long.withColumn("direction", F.lit("top")).withColumn("rank", rank(F.desc("standardized_mean"))).where(F.col("rank") <= n)
    return top.unionByName(long.withColumn("direction", F.lit("bottom")).withColumn("rank", rank(F.asc("standardized_mean"))).where(F.col("rank") <= n))


def role_name(means: DataFrame) -> DataFrame:
    """A draft role name per cluster: the role with the highest mean signal; two within 75 % are a hybrid; none above 0 is unclear."""
    pairs = []
    for i, (role, signals) in enumerate(ROLE_SIGNALS.items()):
        total = sum((F.col(s) for s in signals[1:]), F.col(signals[0]))
        pairs.append(F.struct((-(total / len(signals))).alias("s"), F.lit(i).alias("i"), F.lit(role).alias("r")))
    ranked = F.array_sort(F.array(*pairs))
    a, b = F.col("__r")[0], F.col("__r")[1]
    name = F.when(-a["s"] <= 0, "Unclear").when((-b["s"] > 0) & (-b["s"] >= -a["s"] * 0.75), F.concat(F.lit("Hybrid: "), a["r"], F.lit(" + "), b["r"])).otherwise(a["r"])
    return means.withColumn("__r", ranked).select("cluster_label", name.alias("candidate_role_name"))


def representatives(labelled: DataFrame, n: int = 5) -> DataFrame:
    """The n actors of each cluster with the highest cluster_probability, if labelled has one, then the most events; of noise, those nearest to its median activity rank."""
    w = Window.partitionBy("cluster_label")
    first = F.row_number().over(w.orderBy("total_events", "actor_id")) / F.count("*").over(w)
    sure = F.coalesce("cluster_probability", F.lit(0.0)) if "cluster_probability" in labelled.columns else F.lit(0.0)
    scored = labelled.select("cluster_label", "actor_id", "total_events", F.when(F.col("cluster_label") == -1, F.round(F.abs(first - 0.5), 9)).otherwise(-sure).alias("score"))
    order = w.orderBy("score", F.desc("total_events"), "actor_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("cluster_label", "rank", "actor_id", "total_events")


def timeline(events: DataFrame, chosen: DataFrame, n: int = 8) -> DataFrame:
    """The first n events of each chosen actor. chosen has a bounded number of actors a cluster."""
    order = Window.partitionBy("actor_id").orderBy(F.asc_nulls_last("ts"), "source", "event_type", "event_id", F.asc_nulls_first("issue_id"), "text_length", "lines_added", "lines_deleted", "commit_id")
    rows = events.join(chosen.select("actor_id").distinct(), "actor_id", "left_semi")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("actor_id", "rank", "project_name", "ts", "source", "event_type", "lifecycle_stage", "event_scope")


def profiles(labelled: DataFrame, events: DataFrame) -> DataFrame:
    """Size, activity and the dominant stage of each cluster."""
    base = labelled.groupBy("cluster_label").agg(F.count("*").alias("n_actors"), F.sum("total_events").alias("total_events"), F.avg("total_events").alias("mean_events"), F.median("total_events").alias("median_events"), F.avg("n_unique_issues").alias("mean_unique_issues"), F.median("n_unique_issues").alias("median_unique_issues"))
    counts = events.groupBy("actor_id", "lifecycle_stage").agg(F.count("*").alias("n"))  # a few rows an actor instead of its events
    by = counts.join(labelled.select("actor_id", "cluster_label"), "actor_id").groupBy("cluster_label", "lifecycle_stage").agg(F.sum("n").alias("n"))
    shares = by.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy("cluster_label")))
    stage = first_of(shares, "cluster_label", "lifecycle_stage").select("cluster_label", F.col("lifecycle_stage").alias("dominant_stage"), F.col("ratio").alias("dominant_stage_ratio"))
    return base.join(stage, "cluster_label", "left")


def profile_json(top: DataFrame) -> DataFrame:
    """One JSON text a cluster with its top and bottom features in rank order."""
    ranked = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("rank", "feature", "standardized_mean")))), lambda x: x)
    return top.groupBy("cluster_label").agg(F.to_json(F.struct(ranked("top").alias("top_features"), ranked("bottom").alias("bottom_features"))).alias("profile"))
