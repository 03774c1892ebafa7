"""Readers: stored tables and files, and the lifecycle view of the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.schemas import CLUSTER_ROLES, STAGE_OF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_file(spark: SparkSession, path: str, schema: StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet, CSV (with a header) or JSON-lines file by its extension; ValueError for any other. No type is inferred from CSV."""
    kind = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        df = reader.parquet(path)
    elif kind == "csv":
        df = reader.csv(path, header=True)
    elif kind in ("json", "jsonl"):
        df = reader.json(path)
    else:
        raise ValueError(f"unsupported file type: .{kind}")
    return df.select(*columns) if columns else df


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The file, or an empty frame of the schema where there is none."""
    from pyspark.errors import AnalysisException

    try:
        df = read_file(spark, path, schema)
        df.schema  # resolves the path
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_collection(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A document collection exported as JSON lines or Parquet below a folder; a missing one is empty under its schema."""
    from pyspark.errors import AnalysisException

    for kind in ("parquet", "jsonl", "json"):
        try:
            return read_file(spark, f"{folder}/{name}.{kind}", schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if schema is None:
        raise FileNotFoundError(f"{folder}/{name}")
    return spark.createDataFrame([], schema)


def stage_of(event_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])[event_type], F.lit("unknown"))


def region_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, project_name): region and nation have a fixed number of rows and are broadcast."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("project_name"))
    return table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), "project_name")


#: Bytes of Parquet behind a partition of spread().
SHARE_BYTES = 2 << 20
LOG_COLUMNS = ["event_id", "project_name", "issue_id", "actor_id", "ts", "source", "event_type", "lifecycle_stage", "event_scope", "text_length", "files_changed", "lines_added", "lines_deleted", "commit_id"]


def _emit(df: DataFrame, **cols: Column) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    given = {"event_scope": F.lit("issue_linked"), "text_length": zero, "files_changed": zero, "lines_added": zero, "lines_deleted": zero, "commit_id": none} | cols
    given["lifecycle_stage"] = stage_of(given["event_type"])
    return df.select(*[given[c].alias(c) for c in LOG_COLUMNS])


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star-schema tables as a lifecycle event log: orders are issues, lines are commits, events are activity."""
    place = region_of_customer(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).join(place, F.col("o_custkey") == F.col("custkey"))
    lines = table(spark, sf_dir, "lineitem")
    if n := _pieces(lines):  # else adaptive execution makes tasks of the join larger with the tables
        lines = lines.repartition(n, "l_orderkey")
    lines = lines.join(orders.select("o_orderkey", "project_name"), F.col("l_orderkey") == F.col("o_orderkey"))
    acts = table(spark, sf_dir, "events").join(place, F.col("user_id") == F.col("custkey"))
    s = lambda c: F.col(c).cast("string")
    created = _emit(orders, event_id=F.concat(F.lit("issue:issue_created:"), s("o_orderkey")), project_name=F.col("project_name"), issue_id=s("o_orderkey"), actor_id=F.concat(F.lit("c"), s("o_custkey")), ts=F.col("o_orderdate"), source=F.lit("issue"), event_type=F.lit("issue_created"), text_length=F.length("o_orderpriority").cast("long"))
    # a line is a commit, and a returned one a resolution too: one pass over the lines
    line = lines.withColumn("kind", F.explode(F.filter(F.array(F.lit("commit"), F.when(F.col("l_returnflag") == "R", "resolved")), lambda x: x.isNotNull())))
    is_commit = F.col("kind") == "commit"
    either = lambda a, b: F.when(is_commit, a).otherwise(b)
    commit, resolved = F.concat_ws("-", "l_orderkey", "l_linenumber"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    zero = F.lit(0).cast("long")
    of_lines = _emit(
        line,
        event_id=either(F.concat(F.lit("commit:commit_authored:issue:"), s("l_orderkey"), F.lit(":commit:"), commit), F.concat(F.lit("event:issue_resolved:"), resolved)),
        project_name=F.col("project_name"),
        issue_id=s("l_orderkey"),
        actor_id=F.concat(F.lit("s"), s("l_suppkey")),
        ts=F.col("l_shipdate"),
        source=either(F.lit("commit"), F.lit("event")),
        event_type=either(F.lit("commit_authored"), F.lit("issue_resolved")),
        files_changed=either(F.col("l_linenumber").cast("long"), zero),
        lines_added=either(F.col("l_quantity").cast("long"), zero),
        lines_deleted=either(F.round(F.col("l_discount") * 100).cast("long"), zero),
        commit_id=F.when(is_commit, commit),
    )
    kinds = {"view": ("issue_comment", "issue_comment_added"), "click": ("event", "status_changed"), "purchase": ("pull_request", "pr_opened"), "error": ("pull_request_review", "review_submitted"), "signup": ("event", "issue_closed")}
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[i])])[F.col("event_type")]
    loose = F.col("value") > 100
    activity = _emit(acts, event_id=F.concat_ws(":", F.lit("activity"), "event_type", "event_id"), project_name=F.col("project_name"), issue_id=F.when(~loose, F.get_json_object("props", "$.k")), actor_id=F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("c"), s("user_id"))), ts=F.when(F.col("event_id") % 97 != 0, F.col("ts")), source=pick(0), event_type=pick(1), event_scope=F.when(loose, "project_level").otherwise("issue_linked"), text_length=F.floor("value").cast("long"))
    return reduce(DataFrame.unionByName, [created, of_lines, activity])


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle log as a kept stage, for queries that read it more than once: evaluated once a session and folder, on memory and disk."""
    logs = spark.__dict__.setdefault("_tracewright_logs", {})
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in logs:
        logs[key] = lifecycle_events(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return logs[key]


def _pieces(df: DataFrame) -> int | None:
    """How many partitions df is dealt out into, if its tables hold more than the session's number of partitions is for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    n = sum(x for x in sizes if x < 1 << 60) // SHARE_BYTES  # larger: not known
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys, in the more partitions the more its tables hold, so that a task's share doesn't grow with them."""
    n = _pieces(df)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def role_columns(actor: Column) -> dict[str, Column]:
    """cluster_label and candidate_role_label of an actor id, by its number; null without an actor and for every eleventh."""
    n = F.regexp_extract(actor, r"(\d+)", 1).cast("long")
    label = F.when(n % 11 != 0, (n % 7 - 1).cast("int"))
    return {"cluster_label": label, "candidate_role_label": F.create_map(*[F.lit(x) for kv in CLUSTER_ROLES.items() for x in kv])[label]}


def role_dimension(actors: DataFrame) -> DataFrame:
    """(actor_id, cluster_label, candidate_role_label) of distinct actor ids, by the number in the id; every eleventh has none."""
    return actors.select("actor_id").where("actor_id is not null").distinct().withColumns(role_columns(F.col("actor_id"))).where("cluster_label is not null")
