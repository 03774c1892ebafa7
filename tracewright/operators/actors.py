"""Actor identity: surrogate ids, bot rules, and identity metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schemas import BOT_RULES


def clean_id(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def actor_mapping(events: DataFrame, raw_col: str = "actor_id_raw") -> DataFrame:
    """(actor_raw, actor_id): distinct cleaned ids in order, numbered from actor_000001. Only distinct ids go through the ordering task."""
    ids = events.select(clean_id(F.col(raw_col)).alias("actor_raw")).where("actor_raw is not null").distinct()
    return ids.select("actor_raw", F.format_string("actor_%06d", F.row_number().over(Window.orderBy("actor_raw"))).alias("actor_id"))


def value_union(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the distinct values of each key in order, joined by semicolons; nulls are left out."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(name))


def bot_reason(c: Column) -> Column:
    """Names of the rules that a text meets, joined by semicolons; null meets none."""
    return F.array_join(F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(f"(?i){p}"), n) for n, p in BOT_RULES.items()]), ";")


def bot_reason_any(values: Column) -> Column:
    """The same over an array of texts."""
    return F.array_join(F.array(*[F.when(F.exists(values, lambda v: F.coalesce(v, F.lit("")).rlike(f"(?i){p}")), n) for n, p in BOT_RULES.items()]), ";")  # noqa: B023


def normalize_actors(events: DataFrame, mapping: DataFrame, raw_col: str = "actor_id_raw") -> DataFrame:
    """events with actor_id, actor_unknown, bot_reason and is_bot."""
    keyed = events.withColumn("__raw", clean_id(F.col(raw_col)))
    out = keyed.join(mapping.withColumnRenamed("actor_raw", "__raw"), "__raw", "left")
    reason = bot_reason(F.col("__raw"))
    return out.withColumn("actor_unknown", F.col("__raw").isNull()).withColumn("bot_reason", reason).withColumn("is_bot", reason != "").drop("__raw")


def actor_quality(events: DataFrame, dims: list[str]) -> DataFrame:
    """Events, unknown-actor events, bot events and both rates per group, null groups kept."""
    n = F.count("*")
    unknown, bots = F.count_if(F.col("actor_unknown")), F.count_if(F.col("is_bot"))
    return events.groupBy(*dims).agg(n.alias("n_events"), unknown.alias("n_unknown_actor"), bots.alias("n_bot_events"), (unknown / n).alias("unknown_rate"), (bots / n).alias("bot_rate"))


def bot_reason_counts(events: DataFrame) -> DataFrame:
    return events.where("bot_reason <> ''").groupBy("bot_reason").agg(F.count("*").alias("n_events"), F.count_distinct("actor_id").alias("n_actors"))


def metadata_values(sources: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(actor_raw, value) of every non-empty text: each source is (documents, its actor column, its text columns or paths)."""
    parts = []
    for docs, key, fields in sources:
        values = F.explode(F.array(*[clean_id(F.col(f)) for f in fields])).alias("value")
        parts.append(docs.select(clean_id(F.col(key)).alias("actor_raw"), values).where("actor_raw is not null and value is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enrich_bots(events: DataFrame, metadata: DataFrame, raw_col: str = "actor_id_raw") -> DataFrame:
    """bot_reason and is_bot recomputed over the raw id and all metadata of the actor."""
    known = metadata.groupBy("actor_raw").agg(F.collect_set("value").alias("__values"))
    keyed = events.drop("bot_reason", "is_bot").withColumn("actor_raw", clean_id(F.col(raw_col)))
    out = keyed.join(known, "actor_raw", "left")
    reason = bot_reason_any(F.concat(F.array("actor_raw"), F.coalesce("__values", F.array().cast("array<string>"))))
    return out.withColumn("bot_reason", reason).withColumn("is_bot", reason != "").drop("__values", "actor_raw")


def reference_counts(docs: DataFrame, field: str, actors: DataFrame, is_array: bool = False) -> DataFrame:
    """How many documents refer to one of the actors in a field."""
    numbered = docs.withColumn("d", F.monotonically_increasing_id())
    rows = numbered.select("d", (F.explode(field) if is_array else F.col(field)).alias("actor_raw")).withColumn("actor_raw", F.col("actor_raw").cast("string"))
    return rows.join(actors.select("actor_raw").distinct(), "actor_raw", "left_semi").agg(F.count_distinct("d").alias("n_documents"))


def metadata_coverage(mapping: DataFrame, metadata: DataFrame) -> DataFrame:
    """(actors, resolved, rate): mapped actors with any metadata."""
    met = metadata.select("actor_raw").distinct().withColumn("m", F.lit(True))
    return mapping.join(met, "actor_raw", "left").agg(F.count("*").alias("actors"), F.count_if("m").alias("resolved"), (F.count_if("m") / F.count("*")).alias("rate"))
