import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import common, mix


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[k] for k in stopped)
        w = sum(weight[k] for k in names if k not in stopped)
        target = {k: 3 * sizes[k] if k in stopped else left * weight[k] / w for k in names}
        over = {k for k in names if k not in stopped and target[k] > 3 * sizes[k]}
        if not over:
            return target
        stopped |= over


def nearest(lengths, target, passes=3):
    """How near to the target a choice of documents comes after whole passes, by a bit set of all sums."""
    total = sum(map(int, lengths))
    rest = target - min(passes, int(target // total)) * total if total else target
    sums = 1
    for n in lengths:
        sums |= sums << int(n)
    reach = np.flatnonzero(np.frombuffer(bin(sums)[:1:-1].encode(), dtype=np.uint8) == 49)
    return np.abs(reach - rest).min()


def rows(seed=3):
    r = random.Random(seed)
    out = [(i, " ".join("w" for _ in range(r.choice([0, 1, 2, 3, 5, 8, 40, r.randint(1, 300)]))), r.choice(["b", "b", "b", "b", "a", "é", None, "tiny"] + ["x"] * (i % 9 == 0))) for i in range(700)]
    return out + [(1000, None, "a"), (1001, "", "onlyempty"), (None, "w w w", "a"), (1002, "w " * 60_000, "b"), (1003, "one", "z"), (5, "w w", "b"), (5, "w w", "b")]


def run(spark, data):
    df = spark.createDataFrame([(d, t, s, 1, 1.0) for d, t, s in data], "doc_id long, text string, source string, size int, target double")
    return df, mix.mixed_sizes(df).collect()


def test_targets_and_budgets(spark):
    data = rows()
    _, got = run(spark, data)
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    source = {d: s for d, _, s in data}
    taken = Counter()
    lengths = defaultdict(list)
    for _, t, s in data:
        lengths[s].append(len((t or "").split()))
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(abs(taken[s] - t) - nearest(lengths[s], t)) < 1e-6, (s, taken[s], t)


def test_reruns_agree_and_the_mix_repeats_rows(spark):
    df, got = run(spark, rows())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix.mixed_sizes(df.repartition(7)).collect()), key=str)
    words = defaultdict(int)
    for r in mix.mix(df).select("doc_id", mix.word_count("text").alias("n")).collect():
        words[r["doc_id"]] += r["n"]
    want = defaultdict(int)
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_hash_ranges_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(mix, "RANKED", 10)
    monkeypatch.setattr(mix, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "SMALL", 0)
    data = [(i, "w w w", "a") for i in range(900)] + [(2000 + i, "w", "b") for i in range(300)] + [(3000, "w " * 900, "c")]
    _, got = run(spark, data)
    taken = Counter()
    for r in got:
        taken["abc"[(r["doc_id"] >= 2000) + (r["doc_id"] >= 3000)]] += r["taken"]
    want = brute_targets({"a": 2700, "b": 300, "c": 900})
    assert all(abs(taken[k] - want[k]) <= (0 if k == "b" else 3) for k in "ab"), (taken, want)


def test_empty_table(spark):
    assert run(spark, [])[1] == []


def test_subset_sum_matches_exhaustive_search():
    r = np.random.default_rng(2)
    for t in range(400):
        if t % 4 == 0:
            lengths, counts = np.unique(r.integers(1, 12, 4)), None
        elif t % 4 == 1:  # skewed lengths, each once
            lengths = np.unique((r.pareto(1, 40) * 30 + 1).astype(int))
            counts = np.ones(len(lengths), dtype=int)
        elif t % 4 == 2:  # a common divisor
            lengths, counts = np.unique(r.integers(50, 400, 6)) * 7, None
        else:
            lengths, counts = np.unique(np.r_[r.integers(1, 300, 30), [9000, 20000]]), None
        counts = r.integers(1, 5, len(lengths)) if counts is None else counts
        budget = float(r.uniform(0, lengths @ counts))
        take = mix.fit_budget(lengths, counts, budget)
        assert (0 <= take).all() and (take <= counts).all()
        assert abs(abs(lengths @ take - budget) - nearest(np.repeat(lengths, counts), budget)) < 1e-6


def test_sums_beyond_the_window_are_met(monkeypatch):
    monkeypatch.setattr(mix, "WINDOW", 1000)
    r = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.unique((r.pareto(1, 300) * 40 + 1).astype(int))
        counts = r.integers(1, 50, len(lengths))
        budget = float(r.uniform(0.2, 0.8) * (lengths @ counts))
        assert abs(lengths @ mix.fit_budget(lengths, counts, budget) - budget) <= 0.5
