import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import quality


def texts(n=300, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        good = r.random() < 0.8
        out.append((i, " ".join(word() + ("" if good else r.choice(["!!", "$$$", "%%%"])) for _ in range(r.randint(5, 60))), int(good)))
    return out


def test_held_out_accuracy(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, quality_pred string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(9999, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["quality_pred"] == y for i, y in held) / len(held) > 0.95
    assert all(0 <= r["quality_score"] <= 1 and r["quality_pred"] == int(r["quality_score"] >= 0.3) for r in got.values())


def test_null_empty_long_and_repeated_rows(spark):
    model = quality.train([t.encode() for _, t, _ in texts(80)], [y for *_, y in texts(80)])
    df = spark.createDataFrame([(1, None), (2, ""), (None, "tast noir"), (3, "tast " * 200_000), (3, "tast " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality_score"] for r in quality.classify(df, model).collect()}
    assert len(got) == 4 and got[1] == got[2] and got[3] > 0.3
    assert quality.classify(df.limit(0), model).collect() == []


def test_no_rows_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert abs(none.score(b"a") - 0.5) < 1e-9
    assert quality.train([b"a", b"b"], [1, 1]).score(b"zz") == 0.75


def test_dual_solution_satisfies_the_margin_conditions():
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 3))
    y = np.where(x @ np.array([1.0, -2, 0.5]) + 0.2 > 0, 1, -1)
    w, b = quality.dual_coordinate_descent([(np.arange(3), v) for v in x], y, np.full(60, 10.0), 3, epochs=3000, tolerance=1e-6)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    assert all(primal(w + d[:3], b + d[3]) >= best - 1e-3 for d in r.normal(size=(300, 4)) * 0.05)


def test_recurrences_and_their_ngrams():
    assert quality.recurrences(b"a b a a c b".split()).tolist() == [0, 0, 2, 1, 0, 3]
    assert quality.recurrences([]).tolist() == [] and quality.recurrences([b"x"] * 3).tolist() == [0, 1, 1]
    base, pairs = quality.GRAMS, quality.GRAMS + quality.OCTAVES
    got = {int(i) for i in quality.indicators(b"a b a") if i >= base}
    assert got == {base, base + 2, pairs, pairs + 2, pairs + 64 + 2}


def plain_score(data, texts, labels, model):
    """A score from the definitions alone: log-count ratios over sets of n-grams, then the model's dual weights and curve."""

    def grams(t):
        words, seen, symbols = t.split(), {}, []
        for i, w in enumerate(words):
            symbols.append(min((i - seen[w]).bit_length(), 7) if w in seen else 0)
            seen[w] = i
        out = {("b", 1, t[i : i + 1]) for i in range(len(t))} | {("b", 2, t[i : i + 2]) for i in range(len(t) - 1)}
        for i in range(len(t) - 2):
            x = 0
            for c in t[i : i + 3]:
                x = (x * 257 + c) % 2**32
            out.add(("b", 3, ((x ^ 3 * 0x51ED27 % 2**32) * 0x9E3779B1 % 2**32) >> 16))
        return out | {("r", n, tuple(symbols[i : i + n])) for n in range(1, 5) for i in range(len(symbols) - n + 1)}

    every = [grams(t) for t in texts]
    y = [1 if k else -1 for k in labels]
    count = {k: {} for k in (-1, 1)}
    for g, k in zip(every, y, strict=True):
        for x in g:
            count[k][x] = count[k].get(x, 0) + 1
    total = {k: sum(count[k].values()) + quality.WIDTH for k in (-1, 1)}
    ratio = lambda x: np.log((count[1].get(x, 0) + 1) / total[1]) - np.log((count[-1].get(x, 0) + 1) / total[-1])
    names = sorted({x for g in every for x in g}, key=str)
    at = {x: i for i, x in enumerate(names)}
    rows = [(np.array([at[x] for x in sorted(g, key=str)]), np.array([ratio(x) for x in sorted(g, key=str)]) / np.sqrt(len(g))) for g in every]
    n = {k: y.count(k) for k in (-1, 1)}
    w, bias = quality.dual_coordinate_descent(rows, np.array(y), np.array([len(y) / (2 * n[k]) for k in y]), len(names))
    g = grams(data)
    margin = sum(w[at[x]] * ratio(x) for x in g if x in at) / np.sqrt(len(g)) + bias
    return 1 / (1 + np.exp(-(model.slope * margin + model.offset)))


def test_scores_match_a_plain_computation():
    some = [(t.encode(), y) for _, t, y in texts(40, 9)]
    model = quality.train([t for t, _ in some], [y for _, y in some])
    for data in [some[0][0], b"tast tast tast", "neu é x".encode()]:
        assert abs(model.score(data) - plain_score(data, *zip(*some, strict=True), model)) < 1e-6


def test_repeated_ids_and_text_ids_give_repeatable_fits(spark):
    data = texts(120, 6)
    docs = [(f"d{i}", t) for i, t, _ in data] + [("d3", "another text"), ("d3", None), (None, "x")]
    labels = [(f"d{i}", y) for i, _, y in data] + [("d4", 0), ("d4", 1), ("d5", 7)]
    scores = set()
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        random.Random(seed).shuffle(labels)
        a, b = spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(labels, "doc_id string, quality int")
        scores.add(quality.fit(a, b, F.lit(True)).score(b"tast noir"))
    assert len(scores) == 1
