"""The model matrix: cohort, imputation, log, upper winsorizing and standardizing, always with the actor's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.features import missingness

METADATA = ["actor_id", "is_bot", "is_low_activity", "first_event_at", "last_event_at", "first_lifecycle_stage", "last_lifecycle_stage"]
EXCLUDED = {"median_inter_event_hours": "excluded_temporal_imputation_risk"}
FLAG = "median_comment_length_missing"


def feature_kind(name: str) -> str:
    if name.endswith("_ratio"):
        return "ratio"
    if name.startswith("n_") or name in ("total_events", "active_days"):
        return "count"
    return "median" if name.startswith("median_") else "numeric"


def model_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns that aren't metadata or excluded."""
    kinds = ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c not in METADATA and c not in EXCLUDED]


def cohort(features: DataFrame) -> DataFrame:
    return features.where(~F.col("is_bot") & ~F.col("is_low_activity"))


def impute(features: DataFrame) -> DataFrame:
    """Nulls of model columns to 0, and a flag for actors without comments."""
    cols = model_columns(features)
    flag = F.col("median_comment_length").isNull().cast("int").alias(FLAG)
    return features.select("actor_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols], flag)


def transformed(imputed: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Counts logged (also the one that is a log already, as published numbers have it), then every column capped at its own quantile.

    The logged matrix, one narrow row an actor, is kept for the quantiles and the caps, so its source is read once.
    """
    cols = [c for c in imputed.columns if c != "actor_id"]
    logged = imputed.select("actor_id", *[(F.log1p(F.greatest(F.col(c), F.lit(0.0))) if feature_kind(c) == "count" else F.col(c).cast("double")).alias(c) for c in cols]).persist()
    caps = logged.agg(*[F.percentile(c, quantile).alias(f"__{c}") for c in cols])
    return logged.crossJoin(F.broadcast(caps)).select("actor_id", *[F.least(F.col(c), F.col(f"__{c}")).alias(c) for c in cols])  # caps is one row


def standardized(matrix: DataFrame) -> DataFrame:
    """Mean 0 and population deviation 1; constant columns are 0. The matrix is kept for both passes."""
    matrix = matrix.persist()
    cols = [c for c in matrix.columns if c != "actor_id"]
    stats = matrix.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 1e-12, F.col(f"__s_{c}")).otherwise(1.0)
    return matrix.crossJoin(F.broadcast(stats)).select("actor_id", *[z(c).alias(c) for c in cols])  # stats is one row


def exclusion_log(features: DataFrame) -> DataFrame:
    """(feature, reason, feature_kind, missing_rate) of every column that isn't in the model."""
    used = set(model_columns(features))
    rows = []
    for c in features.columns:
        if c in METADATA:
            rows.append((c, "metadata_separated", "metadata"))
        elif c in EXCLUDED:
            rows.append((c, EXCLUDED[c], feature_kind(c)))
        elif c not in used:
            rows.append((c, "non_numeric_or_not_model_feature", "non_numeric"))
    said = features.sparkSession.createDataFrame(rows, "feature string, reason string, feature_kind string")
    return said.join(missingness(features).select("feature", "missing_rate"), "feature")


def imputation_log(features: DataFrame) -> DataFrame:
    """(feature, feature_kind, missing_count_before, action) of the model columns that imputation touches."""
    kinds = features.sparkSession.createDataFrame([(c, feature_kind(c)) for c in model_columns(features)], "feature string, feature_kind string")
    m = missingness(features, model_columns(features)).join(F.broadcast(kinds), "feature")
    special = F.col("feature") == "median_comment_length"
    rows = m.where(special | (F.col("missing_count") > 0))
    return rows.select("feature", "feature_kind", F.col("missing_count").alias("missing_count_before"), F.when(special, "missing_flag_plus_zero_imputation").otherwise("zero_imputation").alias("action"))


def transform_log(features: DataFrame) -> DataFrame:
    """(feature, feature_kind, is_logged, is_capped, is_scaled, action, missing_count_before) of every model column; the action is the imputation's, or none."""
    names = [*model_columns(features), FLAG]
    rows = [(c, feature_kind(c), feature_kind(c) == "count", True, True) for c in names]
    said = features.sparkSession.createDataFrame(rows, "feature string, feature_kind string, is_logged boolean, is_capped boolean, is_scaled boolean")
    log = imputation_log(features).select("feature", "feature_kind", "missing_count_before", "action")
    out = said.join(F.broadcast(log), ["feature", "feature_kind"], "left")  # a row a column
    return out.withColumn("action", F.coalesce("action", F.lit("none"))).fillna(0, ["missing_count_before"])


def require_model_input(matrix: DataFrame, labels: DataFrame, features: DataFrame) -> None:
    """ValueError unless matrix and labels have the same actors once, no value is missing, and no actor is a bot or of low activity."""
    from tracewright.operators.quality import require_complete, require_unique

    require_unique(labels, "actor_id")
    require_complete(matrix, [c for c in matrix.columns if c != "actor_id"])
    both = matrix.select("actor_id").join(labels.select("actor_id", F.lit(1).alias("__l")), "actor_id", "full").agg(F.count("*").alias("n"), F.count("__l").alias("l")).first()
    if both["n"] != both["l"] or both["n"] != matrix.count():
        raise ValueError("matrix and labels hold different actors")
    if features.where("is_bot or is_low_activity").join(matrix.select("actor_id"), "actor_id", "left_semi").limit(1).count():
        raise ValueError("the model matrix holds a bot or an actor of low activity")


def feature_list(features: DataFrame) -> DataFrame:
    rows = [(c, feature_kind(c)) for c in [*model_columns(features), FLAG]]
    return features.sparkSession.createDataFrame(rows, "feature string, feature_kind string")


def cohort_metadata(features: DataFrame) -> DataFrame:
    """Metadata of the cohort, numbered from 0 by actor id. One narrow row an actor goes through the ordering task."""
    return cohort(features).select(*METADATA).withColumn("row_index", F.row_number().over(Window.orderBy("actor_id")) - 1)
