"""Settings and the list of selected projects, from YAML or JSON files on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_settings(path: str) -> dict:
    """A mapping from a YAML or JSON file; FileNotFoundError or ValueError if there is none."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("YAML needs a parser that isn't installed; use JSON") from e
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def setting(settings: dict, key: str, default=None):
    """The value at a dotted key, or the default where a part of it is missing."""
    for part in key.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return default
        settings = settings[part]
    return settings


def resolve(settings: dict, key: str, root: str) -> str:
    """A path setting below the root unless it is absolute; KeyError if it isn't set."""
    value = setting(settings, key)
    if value is None:
        raise KeyError(key)
    return str(Path(root) / value)


def selected_projects(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, project_name) of a selection file; ValueError if it selects none."""
    rows = [(str(p["project_id"]), p.get("project_name")) for p in setting(load_settings(path), "selected_projects", [])]
    if not rows:
        raise ValueError(f"{path} selects no project")
    return spark.createDataFrame(rows, "project_id string, project_name string")


def load_schema_map(path: str) -> dict:
    """A JSON schema map that must exist and hold collections."""
    value = load_settings(path)
    if "collections" not in value:
        raise ValueError(f"{path} names no collections")
    return value
