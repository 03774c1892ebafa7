"""Clustering and statistics against brute force on few points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import cluster, stats
from tracewright.plans.model_queries import QUERIES


def blobs(n=40, k=3, seed=1, noise=6):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(n, 2)) * 0.3 + c for c in ([0, 0], [8, 0], [0, 8])[:k]] + [r.uniform(-20, 30, (noise, 2))])
    return x, np.repeat(np.arange(k), n)


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_density_clusters_find_planted_groups():
    x, truth = blobs()
    labels, strength = cluster.hdbscan(x, 15, 5)
    core = labels[: len(truth)]
    assert same_groups(core[core >= 0], truth[core >= 0]) and (core >= 0).mean() > 0.9 and (labels[len(truth) :] == -1).mean() >= 0.5
    assert ((strength >= 0) & (strength <= 1)).all() and (strength[labels == -1] == 0).all()
    assert (cluster.hdbscan(x[:5], 15, 5)[0] == -1).all()


def test_ward_matches_exhaustive_merging():
    x = np.random.default_rng(2).normal(size=(24, 3))
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > 5:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    want = np.empty(len(x), dtype=int)
    for k, g in enumerate(groups):
        want[g] = k
    assert same_groups(cluster.ward(x, 5), want)


def test_quality_measures_match_numpy(spark):
    x, y = blobs(noise=0, seed=5)
    x, y = np.concatenate([x, x[:3]]), np.concatenate([y, y[:3]])
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "features array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), min(d[i, y == k].mean() for k in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    assert cluster.silhouette(df).first()[0] == pytest.approx(np.mean(s)) == pytest.approx(cluster.silhouette_by_pairs(df).first()[0])
    k, n = 3, len(x)
    c = np.array([x[y == j].mean(0) for j in range(k)])
    w = ((x - c[y]) ** 2).sum()
    b = (np.bincount(y)[:, None] * (c - x.mean(0)) ** 2).sum()
    spread = np.array([np.sqrt(((x[y == j] - c[j]) ** 2).sum(1)).mean() for j in range(k)])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in range(k) if j != i) for i in range(k)])
    got = cluster.scores(df).first()
    assert got["calinski_harabasz"] == pytest.approx((b / (k - 1)) / (w / (n - k))) and got["davies_bouldin"] == pytest.approx(db)


def test_agreement_of_equal_and_crossed_labelings(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 10) for i in range(30)], "a int, b int")
    assert tuple(stats.agreement(same, "a", "b").first())[1:] == pytest.approx((1.0, 1.0, 1.0))
    crossed = stats.agreement(spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "a int, b int"), "a", "b").first()
    assert crossed["nmi"] == pytest.approx(0, abs=1e-9) and crossed["ari"] < 0.01


def test_subsamples_have_the_exact_size(spark):
    got = stats.subsample(spark.range(50).select(F.col("id").alias("k")), "k", 0.8, 4).groupBy("rep").agg(F.count_distinct("k").alias("n")).collect()
    assert [r["n"] for r in got] == [40] * 4


def test_permutation_p_value(spark):
    linked = spark.createDataFrame([(str(i % 3), str(i % 3)) for i in range(60)], "a string, b string")
    assert stats.permutation_p(linked, "a", "b", 200).first()["p_value"] == pytest.approx(1 / 201)
    free = spark.createDataFrame([(str(i % 2), str(i // 2 % 2)) for i in range(60)], "a string, b string")
    assert stats.permutation_p(free, "a", "b", 200).first()["p_value"] > 0.5


def test_registered_permutation_test_draws_as_many_tables_as_the_reference(spark):
    got = QUERIES["monte_carlo_chi2"][0](spark, "/root/testdata/sf0.001").first()
    assert got["repeats"] == 10_000 and got["p_value"] >= 1 / 10_001


def test_sparse_contingency_tables_are_dense(spark):
    cells = stats.contingency(spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 2, "p string, q string"), "p", "q")
    grid = stats.dense_grid(cells, "p", "q")
    assert grid.count() == 4 and stats.chi_square(grid, "p", "q").first()["chi2"] == pytest.approx(5.0)


def test_lloyd_finds_planted_groups_and_the_best_run(spark):
    x, truth = blobs(noise=0)
    assert same_groups(cluster.lloyd(x, 3, 5), truth) and same_groups(cluster.standard_lloyd(x, 3, 5), truth)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, features array<double>")
    got = {k: cluster.lloyd_grid(df, "i", [2, 3], 5).where(f"k = {k}").first()["inertia"] for k in (2, 3)}
    assert got[3] == pytest.approx(sum(((x[truth == j] - x[truth == j].mean(0)) ** 2).sum() for j in range(3))) and got[2] > got[3]


def test_agreement_within_groups_matches_the_plain_one(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), int(a), int(b)) for g, a, b in zip(r.integers(0, 3, 300), r.integers(0, 3, 300), r.integers(0, 4, 300))]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    for row in stats.agreement_by(df, "g", "a", "b").collect():
        assert tuple(row)[1:] == pytest.approx(tuple(stats.agreement(df.where(f"g = {row['g']}"), "a", "b").first()))


def test_chi_square_tail_probabilities(spark):
    # published quantiles at 5 % and 1 %
    rows = [(3.841, 1, 0.05), (5.991, 2, 0.05), (16.812, 6, 0.01), (76.154, 50, 0.01), (67.505, 50, 0.05), (0.0, 4, 1.0), (2478.64, 32, 0.0)]
    got = spark.createDataFrame(rows, "x double, d int, p double").select("p", stats.chi_square_p(F.col("x"), F.col("d")).alias("q")).collect()
    assert all(r["q"] == pytest.approx(r["p"], abs=2e-5) for r in got)
