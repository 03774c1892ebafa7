"""Event-log quality: counts with null groups, duplicates, warnings, coverage, privacy scans and guards."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Patterns of a privacy scan.
SENSITIVE = {"raw_actor_field": r"actor_id_raw", "user_name_word": r"(?i)\busername\b", "email_like": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "hex_24": r"\b[0-9a-fA-F]{24}\b"}


def grouped_counts(events: DataFrame, dims: list[str]) -> DataFrame:
    """Events per combination, null groups kept."""
    return events.groupBy(*dims).agg(F.count("*").alias("n_events"))


def duplicates(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, n_copies) of every key that occurs more than once."""
    return events.groupBy(key).agg(F.count("*").alias("n_copies")).where("n_copies > 1")


def duplicate_warnings(events: DataFrame) -> DataFrame:
    """A warning for each copy of a repeated event id."""
    copies = F.count("*").over(Window.partitionBy("event_id"))
    rows = events.withColumn("__n", copies).where("__n > 1")
    return rows.select("project_name", "event_id", F.lit("duplicate_event_id").alias("warning_type"), "source", "event_type")


def missing_warnings(events: DataFrame) -> DataFrame:
    """A warning for each missing time and each missing actor, in one pass."""
    kinds = F.filter(F.array(F.when(F.col("ts").isNull(), "missing_timestamp"), F.when(F.col("actor_id").isNull(), "missing_actor")), lambda x: x.isNotNull())
    return events.select("project_name", "event_id", F.explode(kinds).alias("warning_type"), "source", "event_type")


def scalar_metrics(events: DataFrame) -> DataFrame:
    """(metric, value, rate): totals of the log and their share of all events."""
    one = events.agg(
        F.count("*").alias("total_events"),
        (F.count("event_id") - F.count_distinct("event_id")).alias("duplicate_event_ids"),
        F.count_if(F.col("ts").isNull()).alias("missing_timestamp"),
        F.count_if(F.col("actor_id").isNull()).alias("missing_actor"),
        F.count_if(F.col("event_scope") == "issue_linked").alias("issue_linked_events"),
        F.count_if(F.col("event_scope") == "project_level").alias("project_level_events"),
    )
    names = one.columns
    return one.select(F.col("total_events").alias("__t"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.metric", "x.value", (F.col("x.value") / F.nullif("__t", F.lit(0))).alias("rate"))


def sections(events: DataFrame, dims: list[str], pair: tuple[str, str]) -> DataFrame:
    """(section, key, key2, n_events): counts by each dimension and by one pair, in a single grouping-sets pass."""
    cols = list(dict.fromkeys([*dims, *pair]))
    sets = [F.col(d) for d in dims]
    grouped = events.groupingSets([[c] for c in sets] + [[F.col(pair[0]), F.col(pair[1])]], *[F.col(c) for c in cols]).agg(F.count("*").alias("n_events"), *[F.grouping(c).alias(f"__g_{c}") for c in cols])
    on = lambda c: F.col(f"__g_{c}") == 0
    both = on(pair[0]) & on(pair[1])
    section = reduce(lambda acc, d: F.when(~both & on(d), f"by_{d}").otherwise(acc), dims, F.lit(f"by_{pair[0]}_and_{pair[1]}"))
    key = reduce(lambda acc, d: F.when(~both & on(d), F.col(d)).otherwise(acc), dims, F.col(pair[0]))
    return grouped.select(section.alias("section"), key.alias("key"), F.when(both, F.col(pair[1])).alias("key2"), "n_events")


def json_field_counts(df: DataFrame, json_col: str, path: str) -> DataFrame:
    """Rows per value of a JSON path; text that isn't JSON counts under null."""
    return df.groupBy(F.get_json_object(json_col, path).alias("field_value")).agg(F.count("*").alias("n"))


def column_missingness(df: DataFrame) -> DataFrame:
    from tracewright.operators.features import missingness

    return missingness(df)


def privacy_scan(df: DataFrame, text_col: str) -> DataFrame:
    """(pattern, matches, rows_matched) of each sensitive pattern over all texts."""
    one = df.agg(*[F.coalesce(F.sum(F.regexp_count(text_col, F.lit(p))), F.lit(0)).alias(n) for n, p in SENSITIVE.items()], *[F.count_if(F.col(text_col).rlike(p)).alias(f"{n}__rows") for n, p in SENSITIVE.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).cast("long").alias("matches"), F.col(f"{n}__rows").alias("rows_matched")) for n in SENSITIVE])).alias("x")).select("x.*")


@udtf(returnType="path string, kind string")
class FlattenJson:
    """Every dotted path of a JSON document with its type; [] marks arrays of documents."""

    def eval(self, text: str):
        try:
            yield from self._walk(json.loads(text), "")
        except (TypeError, ValueError):
            return

    def _walk(self, value, prefix: str):
        if isinstance(value, dict):
            for k, v in value.items():
                path = f"{prefix}.{k}" if prefix else k
                yield path, self._kind(v)
                if isinstance(v, dict):
                    yield from self._walk(v, path)
                elif isinstance(v, list):
                    for item in v:
                        if isinstance(item, dict):
                            yield from self._walk(item, f"{path}[]")

    @staticmethod
    def _kind(v) -> str:
        return "null" if v is None else type(v).__name__


def field_coverage(df: DataFrame, json_col: str) -> DataFrame:
    """(path, present, nulls, missing, types) over JSON documents: missing key, null and present are told apart.

    A path counts once a document; types lists type:count, sorted.
    """
    docs = df.select(F.monotonically_increasing_id().alias("d"), F.col(json_col).alias("j"))
    flat = docs.lateralJoin(FlattenJson(F.col("j").outer())).select("d", "path", "kind").distinct()
    total = df.agg(F.count("*").alias("n"))
    kinds = flat.groupBy("path", "kind").agg(F.count("*").alias("c"))
    nulls = F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("c"))), F.lit(0))
    per = kinds.groupBy("path").agg(nulls.alias("nulls"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "c"))), ";").alias("types"))
    seen = flat.groupBy("path").agg(F.count_distinct("d").alias("docs"))
    return per.join(seen, "path").crossJoin(F.broadcast(total)).select("path", (F.col("docs") - F.col("nulls")).alias("present"), "nulls", (F.col("n") - F.col("docs")).alias("missing"), "types")


def require_columns(df: DataFrame, names: list[str]) -> None:
    """KeyError naming the columns that df lacks."""
    if lacking := sorted(set(names) - set(df.columns)):
        raise KeyError(f"missing columns: {lacking}")


def require_unique(df: DataFrame, key: str) -> None:
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")


def require_complete(df: DataFrame, columns: list[str]) -> None:
    """ValueError if a column holds a null or NaN."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"missing values: { {k: v for k, v in bad.items() if v} }")


def normalization_problems(before: DataFrame, after: DataFrame) -> list[str]:
    """What an actor normalization must keep: the number of rows, and unique event ids."""
    a, b = before.count(), after.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"), F.count("event_id").alias("k")).first()
    out = [f"row count changed from {a} to {b['n']}"] if a != b["n"] else []
    return out + ([f"{b['k'] - b['d']} repeated event ids"] if b["k"] != b["d"] else [])
