import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import srs


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, dtype=float)
    ids, x = np.array(list(ok)), np.array(list(ok.values()))
    out = {}
    for i in ids[ids % 50 == 0]:
        s = srs.cosine(ok[i], x)
        order = sorted((-a, b) for a, b in zip(s, ids, strict=True) if b != i)[:k]
        out[int(i)] = [(int(b), -a) for a, b in order]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in srs.nearest(df, F.col("vec_id") % 50 == 0, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def data(n=1500, d=16, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(20, d))
    return [(i, (centre[i % 20] + 0.4 * r.normal(size=d)).tolist()) for i in range(n)]


def test_recall_over_many_cells(spark):
    rows = data()
    want, got = brute(rows), run(spark, rows, cell_rows=150)
    hits = sum(len({x for x, _ in want[q]} & {x for x, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits / sum(map(len, want.values())) >= 0.95
    for q, found in got.items():
        exact = dict(zip((i for i, _ in rows), srs.cosine(np.array(rows[q][1]), np.array([v for _, v in rows])), strict=True))
        assert len(found) == 5 and all(abs(exact[x] - s) < 1e-12 for x, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_copies_ties_and_rows_that_take_no_part(spark):
    hot = [1.0, 2.0, 2.0, 0.5]
    rows = [(i, hot) for i in range(0, 300)] + [(400, None), (450, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (550, [1.0, float("nan"), 0.0, 0.0]), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, hot), (650, [1.0, 2.0]), (700, []), (50, hot), (750, [-1.0, 0.0, 1.0, 3.0]), (751, [1e200, -1e200, 0.0, 1.0])]
    got, want = run(spark, rows, cell_rows=50), brute([r for r in rows if r[0] not in (650, 700)])
    assert {q: [x for x, _ in v] for q, v in got.items()} == {q: [x for x, _ in v] for q, v in want.items()}
    assert [x for x, _ in got[0]] == [1, 2, 3, 4, 5] and [x for x, _ in got[100]] == [0, 1, 2, 3, 4]


def test_fewer_candidates_than_asked_for(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]) == {0: [(1, srs.cosine(np.array([1.0, 0.0]), np.array([[1.0, 1.0]]))[0])]}
    assert run(spark, [(0, [1.0, 0.0])]) == {} and run(spark, []) == {}


def test_quantiles():
    assert abs(srs.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(srs.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    scaled = [(i, [x * 2.0 ** (i % 40 - 20) for x in (1.0, 2.0, 3.0, 4.0)]) for i in range(100)]
    assert [x for x, _ in run(spark, scaled)[0]] == [1, 2, 3, 4, 5]
    crossed = [(i, [1.0 if j == i % 30 else 0.0 for j in range(31)]) for i in range(30)] + [(50, [0.0] * 30 + [1.0])]
    got = run(spark, crossed)
    assert [x for x, _ in got[50]] == [0, 1, 2, 3, 4] and [x for x, _ in got[0]] == [1, 2, 3, 4, 5]


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 60)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(4)]
    got = run(spark, rows)
    assert [x for x, _ in got[50]] == [51, 49, 52, 48, 53] and sorted(x for x, _ in got[100]) == [101, 102, 103]


def test_recall_in_64_dimensions(spark, monkeypatch):
    monkeypatch.setattr(srs, "SAMPLE_MOST", 64)
    monkeypatch.setattr(srs, "QUERY_ROWS", 4)
    rows = data(2500, 64, 5)
    want, got = brute(rows), run(spark, rows, cell_rows=32, sample_rows=64)  # 8 cells of some 300 rows, each dealt to ten trees
    hits = sum(len({x for x, _ in want[q]} & {x for x, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    many = run(spark, rows, cell_rows=32)  # 128 cells
    hits = sum(len({x for x, _ in want[q]} & {x for x, _ in many[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95


def test_cells_are_dealt_within_the_bound(spark):
    keys = spark.range(6000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("cell"), F.md5(F.col("id").cast("string")).alias("key"))
    parts = srs._dealt(keys, 100)
    assert parts.agg(F.max("parts")).first()[0] >= 30  # one cell has over half of all rows
    tree = F.pmod(F.xxhash64("key"), F.col("parts"))
    assert keys.join(parts, "cell").groupBy("cell", tree).count().agg(F.max("count")).first()[0] <= 150
