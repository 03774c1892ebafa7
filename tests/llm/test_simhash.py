import random

import numpy as np
import xxhash

from tracewright.llm import common, simhash
from tracewright.llm.components import connected_components


def brute(rows):
    """Fingerprints by the definition, one bit at a time, and components by comparing all pairs."""
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        fps.append(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)))
    comp = list(range(len(rows)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, format(f, "016x"), least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    out = simhash.near_duplicates(df, **kw).select("doc_id", simhash.hex_fingerprint(), "component_id")
    return sorted(map(tuple, out.collect()), key=str)


def test_documents_match_brute_force(spark):
    r = random.Random(5)
    base = " ".join(r.choice("abcdefgh") * r.randint(1, 5) + str(r.randint(0, 99)) for _ in range(900))
    rows = [(i, base.replace(str(10 + i), "zz", 1 + i % 2)) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice("klm") + str(r.randint(0, 50)) for _ in range(r.randint(0, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One"), (203, "one"), (204, "ONE\x0bTWO"), (None, "x y z"), (None, None), (5, base), (205, "a " * 70000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_anchor_cover_finds_every_link_and_midpoints_agree(spark):
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**62, 12, dtype=np.uint64)
    fps = list(centre)
    for c in centre:
        for _ in range(40):
            x = c
            for b in r.choice(64, int(r.integers(0, 4)), replace=False):
                x ^= np.uint64(1 << int(b))
            fps.append(x)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    near = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2}

    def groups(edges):
        comp = {int(x): int(x) for x in fps}
        find = lambda i: i if comp[i] == i else find(comp[i])
        for a, b in edges:
            a, b = find(a), find(b)
            comp[max(a, b)] = min(a, b)
        return {x: find(x) for x in comp}

    for bound in (4096, 3):
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.anchor_links(df, cell_rows=bound).collect()]
        assert groups(edges) == groups(near)


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.05)
    monkeypatch.setattr(common, "SMALL", 0)
    edges = [(0, i) for i in range(1, 200)] + [(500, 500 + i) for i in range(1, 100)] + [(199, 500), (1000, 1001)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(200), *range(500, 600)]} | {1000: 1000, 1001: 1000}
    text = [(i, "the same words again") for i in range(50)] + [(100 + i, f"other words {i}") for i in range(50)] + [(None, None)]
    assert run(spark, text) == brute(text)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5, 6)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(71)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
