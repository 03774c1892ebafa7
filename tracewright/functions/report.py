"""Small sinks: Markdown tables, JSON, YAML, text, redaction, file manifests. What a file holds whole is of bounded size, and that is checked."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a rendered table; a longer frame is an error, never a cut.
MAX_ROWS = 10_000


def cell(value: Column) -> Column:
    """A table cell: null and NaN are empty, pipes are escaped, line ends are blanks."""
    text = value.cast("string")
    return F.coalesce(F.when(text != "NaN", F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\r\n]+", " ")), F.lit(""))


def markdown(df: DataFrame, max_rows: int = MAX_ROWS) -> str:
    """df as a Markdown table, its rows made by Spark; an empty frame gives an empty text, one of over max_rows rows a ValueError."""
    if not df.columns:
        return ""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(df[c]) for c in df.columns]), F.lit(" |"))
    rows = [r[0] for r in df.select(line).limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows for one table; choose the first ones by an order, or write a file")
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns), *rows]) if rows else ""


def document(title: str, parts: dict[str, DataFrame | str]) -> str:
    """A Markdown text: a title, then a section for each frame or text; empty ones say so."""
    said = [f"# {title}"]
    for name, part in parts.items():
        said += [f"## {name}", (part if isinstance(part, str) else markdown(part)) or "(none)"]
    return "\n\n".join(said) + "\n"


def shorten(text: Column, width: int) -> Column:
    """Blanks collapsed, and what exceeds the width cut at a word's end and marked by [...]."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    kept = F.regexp_replace(F.substring(flat, 1, width - 5), r"\s\S*$", "")
    cut = F.when(F.substring(flat, width - 5, 1).isin(" ", ""), F.rtrim(F.substring(flat, 1, width - 6)))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.coalesce(cut, kept), F.lit(" [...]")))


def json_text(value) -> str:
    """Sorted keys; dates as ISO text, everything else that JSON lacks as text."""
    return json.dumps(value, indent=2, sort_keys=True, default=lambda v: v.isoformat() if isinstance(v, datetime.date) else str(v))


def yaml_text(value, depth: int = 0) -> str:
    """Block YAML of mappings, lists and plain values in their order; texts are quoted as in JSON."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        items = [(f"{pad}{k}:", v) for k, v in value.items()]
    elif isinstance(value, list) and value:
        items = [(f"{pad}-", v) for v in value]
    else:
        return json.dumps(value, default=str)
    nested = lambda v: isinstance(v, (dict, list)) and v
    return "\n".join(f"{k}\n{yaml_text(v, depth + 1)}" if nested(v) else f"{k} {yaml_text(v)}" for k, v in items)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file, through Spark's file systems, replaced if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(text.encode())
    out.close()


def selection_payload(ranked: DataFrame, key: str, columns: list[str]) -> dict:
    """The selected projects as a mapping for a YAML file: one record a row, in the order of ranked."""
    return {"selected_projects": [{c: r[c] for c in [key, *columns]} for r in ranked.select(key, *columns).limit(MAX_ROWS).collect()]}


def write_table(df: DataFrame, folder: str, name: str, csv: bool = False) -> int:
    """Parquet below the folder, and one CSV file with a header if wanted (for reports of bounded size); returns the rows written."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    written = df.sparkSession.read.parquet(f"{folder}/{name}.parquet")
    if csv:
        written.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return written.count()


def write_public(df: DataFrame, internal: list[str], folder: str, name: str) -> int:
    """The same in both formats, without internal columns."""
    return write_table(df.drop(*internal), folder, name, csv=True)


def redact(c: Column) -> Column:
    """E-mail-like texts and 24-digit hexadecimal ids replaced by marks."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"), r"\b[0-9a-fA-F]{24}\b", "<id>")


def manifest_of(rows: DataFrame, name: str, content: Column) -> DataFrame:
    """(name, bytes, sha256) of each row's content."""
    data = content.cast("binary")
    return rows.select(name, F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha256"))


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return manifest_of(files, "path", F.col("content"))
