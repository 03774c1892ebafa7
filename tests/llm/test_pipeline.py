import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyspark.sql.classic.dataframe
from pyspark.sql import functions as F
from tracewright.llm import common, langid, neardup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_groups(rows, n=5, least=0.8):
    """Groups by comparing all pairs of texts, and the smallest id of each."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(rows)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (union and len(sets[i] & sets[j]) / union >= least) or not sets[i] and not sets[j]:
                comp[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append(d)
    return sorted((min(x for x in ids if x is not None) if any(x is not None for x in ids) else None for ids in best.values()), key=str)


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows = []
    for g in range(25):
        base = [word() for _ in range(r.randint(30, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
        if g % 3 == 0:  # the same opening, another text
            rows.append((len(rows), " ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)])))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (None, "one two"), (None, "alone here"), (905, "long words " * 30_000), (906, "long words " * 30_000), (906, "x y z a b c")]


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == near_groups(rows)
    assert neardup.keep_one(df.limit(0)).collect() == []


def test_stages_of_a_small_corpus(spark, tmp_path):
    r = random.Random(3)
    english, german = "the of and to in is that it was for on are with as his they at be".split(), "der die und das ist nicht ein eine auch mit sich auf im dem den von zu".split()
    rows, labels = [], []
    for i in range(240):
        lang = r.choice(["en", "de"])
        good = i % 6 != 0
        text = " ".join(r.choice(english if lang == "en" else german) + ("" if good else r.choice(["!!", "$$$"])) for _ in range(r.randint(40, 90)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000, rows[1][1], "en", "s1", 1), (1001, None, "en", "s1", 0), (1002, "123 456", None, "s2", 7)]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
        docs = corpus_pipeline.materialize(docs, "test")
        counts.append({x["doc_id"] for x in docs.collect()})
    good = {i for i in range(240) if i % 6}
    assert not {1001, 1002} & counts[0] and len(good - counts[0]) <= 4
    assert len(good - counts[1]) <= 6 and len({i for i in range(240) if i % 6 == 0} & counts[1]) <= 2
    assert 1 in counts[2] and 1000 not in counts[2] and good & counts[1] <= counts[2]
    out = corpus_pipeline.run(spark, d)
    assert {x["doc_id"] for x in out.collect()} == counts[3]


def test_near_pairs_with_a_dominant_shared_passage(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage, rows = " ".join(word() for _ in range(400)), []
    for i in range(60):
        own = " ".join(word() for _ in range(50))
        rows += [(2 * i + j, " ".join([passage, own, *(word() for _ in range(50))])) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in neardup.keep_one(df).select("doc_id").collect())
    assert got == sorted(near_groups(rows)) == [2 * i for i in range(60)]


def test_groups_of_hundreds_text_ids_and_null_ids(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for size in (300, 150, 3):
        base = [word() for _ in range(120)]
        for i in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(120)] = word()
            rows.append((f"d{len(rows):04}" if rng.random() < 0.7 else None, " ".join(copy)))
    rows += [(f"x{i}", " ".join(word() for _ in range(60))) for i in range(30)] + [("d0000", "another text"), (None, "alone"), (None, "alone")]
    rng.shuffle(rows)
    want = near_groups(rows)
    monkeypatch.setattr(neardup, "MEMBERS", 20)
    for most in (10**6, 0):
        monkeypatch.setattr(neardup, "BROADCAST_KEYS", most)
        monkeypatch.setattr(common, "SMALL", most)
        got = neardup.keep_one(spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id string, text string, __words2 string"))
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == want


def test_sketches_never_say_more_than_the_sets_differ():
    r = np.random.default_rng(3)
    for _ in range(200):
        both, one, two = (r.integers(0, 2**63, int(n), dtype=np.uint64) for n in r.integers(0, 400, 3))
        a, b = np.unique(np.r_[both, one]), np.unique(np.r_[both, two])
        unlike = neardup.unlike_at_least(neardup.sketch(a), neardup.sketch(b))
        assert unlike <= len(np.setxor1d(a, b)) and (len(a) < 200 or len(both) or unlike > 0.2 * len(a))


def test_many_null_ids_are_not_joined_with_each_other(spark):
    rows = [(None, f"text number {i} of many others") for i in range(3000)] + [(1, "text number 5 of many others")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and sum(r["doc_id"] == 1 for r in got) == 1


def test_classifiers_hand_back_whole_texts_a_few_hundred_at_a_time(spark, monkeypatch):
    made, kind = [], pyspark.sql.classic.dataframe.DataFrame
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **kw: made.append(run) or real(self, run, *a, **kw))
    rows = [(i, f"some text of number {i}", "en" if i % 2 else "de") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    langid.identify(docs, model)
    quality.classify(docs, quality.train([], []))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "text", "lang"])
    for run in made[1:]:
        got = list(run(iter([batch, batch.slice(0, 0)])))
        assert [x.num_rows for x in got] == [256, 256, 256, 232]
        assert pa.Table.from_batches(got).select(["doc_id", "text", "lang"]).equals(pa.Table.from_batches([batch]))


def test_a_large_group_of_texts_apart_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**7)}"
    base, rows = [word() for _ in range(100)], []
    for i in range(200):  # two words of each are its own: any two texts are below 0.8
        copy = list(base)
        copy[rng.randrange(10, 45)], copy[rng.randrange(55, 90)] = word(), word()
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join([*base[:30], *(word() for _ in range(5)), *base[35:]])) for i in range(2)] + [(300, " ".join([*base, "end"])), (301, " ".join(base))]
    compared, real = [], neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda pairs, *a: compared.append(pairs.count()) or real(pairs, *a))
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == near_groups(rows)
    assert max(compared) < 4000, compared


def test_packed_cells_pair_what_all_pairs_do():
    r = np.random.default_rng(6)
    count = r.integers(0, 40, 300)
    count[:2] = 0, 500
    n, root = np.cumsum(r.integers(1, 4, 300)) + (5 << 33), r.integers(0, 250, 300)
    size, own = count * 3 + 70_000 * (np.arange(300) == 7), np.repeat(np.arange(300), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    place[:500] += 65_400
    token = r.integers(0, 2**63, 400, dtype=np.uint64)[(400 * r.random(len(own)) ** 2).astype(int)]
    data = neardup.pack(n, root, size, own, place, token)
    assert len(data) < 12 * len(own)
    n2, root2, size2, own2, place2, token2 = neardup.unpack(data)
    some = np.flatnonzero(count)
    assert (n2 == n[some]).all() and (root2 == root[some]).all() and (size2 == size[some]).all() and (some[own2] == own).all()
    assert (place2 == np.minimum(place, 65535)).all() and (token2 == (token & np.uint64(2**48 - 1)).astype(np.int64)).all()
    left, right, large = neardup.cell_pairs(root2, size2, own2, place2, token2, 0.8, 12)
    want, big = set(), set()
    for t in np.unique(token2):
        at = np.flatnonzero(token2 == t)
        if len(set(root2[own2[at]])) > 1 and len(at) > 12:
            big |= set(at.tolist())
        elif len(at) <= 12:
            for i in at:
                for j in at:
                    both = min(size2[own2[i]] - place2[i], size2[own2[j]] - place2[j])
                    if own2[i] > own2[j] and root2[own2[i]] != root2[own2[j]] and (both + 1e-9) * 1.8 >= 0.8 * (size2[own2[i]] + size2[own2[j]]):
                        want.add((int(own2[i]), int(own2[j])))
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want and want
    assert set(large.tolist()) == big and big
