"""The stages in their order, from collections or a finished log to roles and patterns; every stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.report import write_table
from tracewright.operators import actors, cluster, extract, features, issues, prep, profiles, quality, review, stats
from tracewright.schemas import ROLE_SIGNALS


def _stage(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    write_table(df, folder, name)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def build_log(spark: SparkSession, collections: dict[str, DataFrame], projects: DataFrame, folder: str) -> DataFrame:
    """The normalized event log, its warnings and its counts. The column ts is the event's time."""
    events = _stage(spark, extract.extract_events(collections, projects), folder, "events")
    _stage(spark, extract.event_warnings(events), folder, "event_warnings")
    mapping = _stage(spark, actors.actor_mapping(events), folder, "actor_mapping")
    normalized = _stage(spark, actors.normalize_actors(events, mapping).withColumnRenamed("timestamp", "ts"), folder, "events_normalized")
    if problems := quality.normalization_problems(events, normalized):
        write_table(spark.createDataFrame([(p,) for p in problems], "problem string"), folder, "normalization_problems")
    return normalized


def build_roles(spark: SparkSession, events: DataFrame, folder: str, pca: int = 12, min_cluster_size: int = 20, min_samples: int = 10, labels: dict[int, str] | None = None) -> DataFrame:
    """(actor_id, cluster_label, cluster_probability, viz_x, viz_y, candidate_role_label) of the cohort, by density clusters of the model matrix.

    labels: names that a review of the profiles has given this run's clusters. Without them, each cluster gets the draft
    name of its own signals, as cluster numbers of another run mean nothing here. viz_x and viz_y are the first two
    principal components.
    """
    f = _stage(spark, features.actor_features(events), folder, "actor_features")
    matrix = _stage(spark, prep.standardized(prep.transformed(prep.impute(prep.cohort(f)))), folder, "model_input")
    columns = [c for c in matrix.columns if c != "actor_id"]
    quality.require_complete(matrix, columns)
    vec = cluster.as_array(cluster.project(cluster.vectors(matrix, "actor_id", columns), min(pca, len(columns))))
    found = _stage(spark, cluster.grid_labels(vec, "actor_id", [(pca, min_cluster_size, min_samples)]), folder, "labels")
    prep.require_model_input(matrix, found, f)
    plane = vec.select("actor_id", F.get("features", F.lit(0)).alias("viz_x"), F.get("features", F.lit(1)).alias("viz_y"))
    placed = found.select("actor_id", F.col("label").alias("cluster_label"), F.col("strength").alias("cluster_probability")).join(plane, "actor_id")
    if labels is None:
        signals = sorted({x for v in ROLE_SIGNALS.values() for x in v})
        names = profiles.role_name(profiles.cluster_means(f.join(placed, "actor_id"), signals)).withColumnRenamed("candidate_role_name", "candidate_role_label")
    else:
        names = spark.createDataFrame(list(labels.items()), "cluster_label int, candidate_role_label string")
    roles = _stage(spark, placed.join(F.broadcast(names), "cluster_label", "left"), folder, "actor_roles")  # a row a cluster
    review.require_allowed(roles, "candidate_role_label")
    return roles


def build_patterns(spark: SparkSession, events: DataFrame, roles: DataFrame, folder: str, ks: range = range(2, 7)) -> DataFrame:
    """Issue role vectors with the pattern of the recommended k."""
    lookup = issues.role_lookup(roles)
    enriched = issues.enrich(events, lookup)
    sets = _stage(spark, issues.issue_role_sets(enriched), folder, "issue_role_sets")
    metrics = _stage(spark, issues.lifecycle_metrics(enriched, sets), folder, "issue_lifecycle_metrics")
    vectors = _stage(spark, issues.role_vectors(events, lookup, metrics), folder, "issue_role_vectors")
    columns = list(issues.ROLE_COLUMNS.values())
    logged = vectors.select("issue_id", *[F.log1p(F.col(c).cast("double")).alias(c) for c in columns]).withColumnRenamed("issue_id", "actor_id")
    vec = cluster.vectors(prep.standardized(logged).withColumnRenamed("actor_id", "issue_id"), "issue_id", columns)
    rows, runs = [], {}
    for k in ks:
        runs[k], _ = cluster.kmeans(vec, k)
        arr = cluster.as_array(runs[k]).select("label", "features")
        sizes = arr.groupBy("label").count().agg(F.min("count").cast("int").alias("smallest_cluster_size"), (F.max("count") / F.sum("count")).alias("largest_cluster_ratio"))
        rows.append(cluster.scores(arr).crossJoin(cluster.silhouette(arr)).crossJoin(sizes).select(F.lit(k).alias("k"), "silhouette", "calinski_harabasz", "davies_bouldin", "smallest_cluster_size", "largest_cluster_ratio").first())  # one row a k
    ranked = _stage(spark, stats.recommend_k(stats.rank_k(spark.createDataFrame(rows))), folder, "k_selection")
    k = ranked.where("recommended").first()["k"]
    patterned = vectors.join(runs[k].select("issue_id", F.col("label").alias("role_composition_cluster")), "issue_id")
    return _stage(spark, issues.pattern_summary(_stage(spark, patterned, folder, "issue_patterns")), folder, "pattern_summary")
