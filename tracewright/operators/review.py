"""Evidence for review: collections and schemas, trends, the role protocol, and guards that raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: words that no role label may contain.
FORBIDDEN = ["maintainer", "leader", "expert", "manager", "decision maker"]
ID_PATTERN = "^[0-9a-fA-F]{24}$"


def catalog(collections: dict[str, DataFrame | None], expected: list[str]) -> DataFrame:
    """(collection, is_present, n_documents) of the expected collections and any other; an absent one has 0."""
    names = [*expected, *sorted(set(collections) - set(expected))]
    there = {n: collections.get(n) for n in names}
    spark = next(df.sparkSession for df in there.values() if df is not None)
    counts = [df.agg(F.lit(n).alias("collection"), F.count("*").alias("n_documents")) for n, df in there.items() if df is not None]
    base = spark.createDataFrame([(n, there[n] is not None) for n in names], "collection string, is_present boolean")
    return base.join(F.broadcast(reduce(DataFrame.unionByName, counts)), "collection", "left").fillna(0, ["n_documents"])


def storage(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(collection, n_files, bytes) from file listings, without reading a file's content."""
    rows = []
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        rows.append(files.agg(F.lit(name).alias("collection"), F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
    return reduce(DataFrame.unionByName, rows)


def count_where(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(name, n_documents) of each SQL condition, in one pass."""
    one = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n_documents")) for n in conditions])).alias("x")).select("x.*")


def sampled(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, for a look at a collection; which ones isn't defined."""
    return df.limit(n)


def schema_map(declared: DataFrame, coverage: DataFrame) -> DataFrame:
    """Declared fields (collection, field, is_required) with what an audit observed (collection, field, present_rate): 0 and a warning for a required field that it lacks."""
    seen = coverage.select("collection", "field", "present_rate")
    out = declared.join(seen, ["collection", "field"], "left").withColumn("is_observed", F.col("present_rate").isNotNull())
    warning = F.when(F.col("is_required") & ~F.col("is_observed"), F.format_string("required field %s.%s was not observed", F.col("collection"), F.col("field")))
    return out.withColumn("warning", warning).fillna(0.0, ["present_rate"])


def audit_errors(collections: DataFrame, statuses: list[str]) -> DataFrame:
    """(collection, check, status) of every status column whose value isn't ok; a null status is missing."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit("missing")).alias("status")) for c in statuses])).alias("x")
    return collections.select("collection", long).select("collection", "x.*").where("status <> 'ok'")


def missingness_hotspots(coverage: DataFrame, n: int = 30) -> DataFrame:
    """The n fields (collection, field, missing_rate) that are missing most; ties in order of their names. A top-k report."""
    return coverage.orderBy(F.desc("missing_rate"), "collection", "field").limit(n)


def parse_id(value: Column, label: str) -> tuple[Column, Column]:
    """(the id, or null if it is none; the warning that a text which is no id gives)."""
    fine = value.rlike(ID_PATTERN)
    return F.when(fine, F.lower(value)), F.when(~fine, F.format_string(f"{label} is not an id: %s", value))


def non_empty(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def split_list(text: Column, separator: str = ";") -> Column:
    """Trimmed parts of a text that aren't empty; null gives none."""
    return F.coalesce(F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def truth(text: Column) -> Column:
    """Whether a text says true, 1 or yes in any case; null doesn't."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def id_text(value: Column) -> Column:
    """An id of any type as text; null stays null."""
    return value.cast("string")


def is_id(text: Column) -> Column:
    return text.rlike(ID_PATTERN)


def zero_filled(projects: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Every project with its metrics, numbers of a project without any as 0."""
    numbers = [c for c, t in metrics.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    return projects.join(metrics, key, "left").fillna(0, numbers)


def trend(outcomes: DataFrame, column: str, least: int = 10) -> DataFrame:
    """(measure, n_eligible, lowest, lowest_value, highest, highest_value) over the role sets with at least that many issues and a value; ties go to the first name."""
    fit = outcomes.where((F.col("issue_count") >= least) & F.col(column).isNotNull())
    low = F.min(F.struct(F.col(column).cast("double").alias("v"), F.col("role_set").alias("r")))
    high = F.min(F.struct((-F.col(column)).cast("double").alias("v"), F.col("role_set").alias("r")))
    one = fit.agg(F.lit(column).alias("measure"), F.count("*").alias("n_eligible"), low.alias("l"), high.alias("h"))
    return one.select("measure", "n_eligible", F.col("l.r").alias("lowest"), F.col("l.v").alias("lowest_value"), F.col("h.r").alias("highest"), (-F.col("h.v")).alias("highest_value"))


def indicator_coverage(df: DataFrame, flags: list[str]) -> DataFrame:
    """(indicator, n_true, share) of boolean columns; a null counts as false."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c)).alias(c) for c in flags])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("n_true"), (F.col(c) / F.col("__n")).alias("share")) for c in flags])).alias("x")
    return one.select(long).select("x.*")


def feature_text(top: DataFrame, n: int = 6) -> DataFrame:
    """(cluster_label, top_feature_text): the first n top features of each cluster in rank order."""
    kept = top.where((F.col("direction") == "top") & (F.col("rank") <= n))
    items = F.array_sort(F.collect_list(F.struct("rank", "feature")))
    return kept.groupBy("cluster_label").agg(F.array_join(F.transform(items, lambda x: x["feature"]), "; ").alias("top_feature_text"))


def taxonomy(profiles: DataFrame, top: DataFrame, stability: DataFrame, labels: dict[int, str]) -> DataFrame:
    """A row a cluster: its label, evidence and stability. ValueError for a cluster without a label, KeyError for lacking columns."""
    from tracewright.operators.quality import require_columns, require_unique

    require_columns(profiles, ["cluster_label", "dominant_stage", "dominant_stage_ratio"])
    require_unique(profiles, "cluster_label")
    require_unique(stability, "cluster_label")
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    named = profiles.withColumn("candidate_role_label", names[F.col("cluster_label")])
    if unnamed := [r[0] for r in named.where("candidate_role_label is null").select("cluster_label").limit(5).collect()]:
        raise ValueError(f"clusters without a label: {unnamed}")
    said = F.format_string("dominant stage %s (%.3f); top features %s", "dominant_stage", "dominant_stage_ratio", F.coalesce("top_feature_text", F.lit("")))
    # one row a cluster on every side
    out = named.join(F.broadcast(feature_text(top)), "cluster_label", "left").join(F.broadcast(stability), "cluster_label", "left")
    return out.withColumn("evidence_summary", said)


def require_allowed(df: DataFrame, column: str, words: list[str] = FORBIDDEN) -> None:
    """ValueError if a label contains a forbidden word in any case."""
    if found := [r[0] for r in df.where(has_forbidden(F.col(column), words)).select(column).distinct().limit(5).collect()]:
        raise ValueError(f"forbidden words in labels: {found}")


def has_forbidden(label: Column, words: list[str] = FORBIDDEN) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(label).contains(w) for w in words]), F.lit(False))


def top_of_subgroup(df: DataFrame, group: str, score: str, key: str, n: int = 3) -> DataFrame:
    """The n rows of each subgroup with the highest score; ties go to the first key."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sample_coverage(sample: DataFrame, group: list[str], key: str) -> DataFrame:
    """Distinct keys of each group of a validation sample."""
    return sample.groupBy(*group).agg(F.count_distinct(key).alias("n_actors"))


def selected_k(sweep: DataFrame, vectors: DataFrame) -> DataFrame:
    """(k): the flagged row's, else the first k that the vectors hold."""
    flagged = sweep.where("selected").agg(F.min("k").alias("a"))
    held = vectors.agg(F.min("k").alias("b"))
    return flagged.crossJoin(held).select(F.coalesce("a", "b").alias("k"))  # one row each


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_distinct): how many different rows of the columns there are."""
    return df.select(*columns).distinct().agg(F.count("*").alias("n_distinct"))


def metric_frame(df: DataFrame, section: str, metrics: dict[str, Column]) -> DataFrame:
    """(section, metric, value) of some aggregates, in one pass: what a report lists."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("x")
    return one.select(F.lit(section).alias("section"), rows).select("section", "x.*")
