"""Queries beside their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tracewright import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["lifecycle_events", "actor_features", "event_counts_7dim", "quality_sections", "normalized_events", "issue_role_sets", "issue_lifecycle_metrics", "role_set_frequency", "role_sequences", "role_transitions", "pattern_summary", "array_fk_bridge", "bridge_fallback_key", "multi_key_or_join", "project_level_topn_anti", "usable_score", "preflight_sample", "standardized_features", "cluster_top_features", "role_name_heuristic", "representative_actors", "ari_nmi_v", "ch_db_scores", "silhouette_exact", "std_residuals", "k_rank_selection"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    run, sql = catalog.ALL[name]
    df = run(spark, DATA)
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cur.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and set(catalog.ALL) <= names
