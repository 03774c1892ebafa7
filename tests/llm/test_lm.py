import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.llm import common, lm


def corpus(seed=2, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = []
        while len(words) < r.randint(5, 80):
            words += r.choice([["of", "the", "day"], ["in", "a", "house"], ["Red", "fish"], [r.choice("abcdefgh") * r.randint(1, 3)]])
        out.append((i, " ".join(words)))
    return out + [(500, None), (501, ""), (502, " \n\x0b"), (None, "of the rareword"), (None, None), (3, "of the day"), (503, "of the day " * 9000)]


def trained(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2


def brute_base(rows):
    counts = Counter(w for d, t in rows if trained(d) for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        out.append((d, len(words), sum(w in counts for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    where = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    model, words = lm.fit(df, where, **kw)
    return model, lm.score(df, model, words, ["doc_id"], where=where).collect()


def test_base_scores_match_brute_force_with_words_in_and_out_of_the_broadcast(spark):
    rows = corpus()
    for share in (1e-6, 3e-3, 0.2):
        model, got = run(spark, rows, word_share=share)
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == brute_base(rows)


def test_tree_scores_match_a_plain_walk_and_beat_the_root(spark):
    rows = corpus()
    ended, _ = run(spark, rows, min_count=None, state_share=1e-3, entry_share=1e-3, depth=5)
    assert len(ended.levels) == 3 and not len(ended.levels[2].states)  # the divergence test ends the tree
    model, got = run(spark, rows, min_count=None, state_share=1e-3, entry_share=1e-3, depth=4, min_nats=-1e9)
    assert len(model.levels) == 4 and all(len(x.states) for x in model.levels)
    counts = Counter(w for d, t in rows if trained(d) for w in [*(t or "").encode().lower().split(), b"\n"])
    end = model.numbers[b"\n"]
    tables = []
    for level in model.levels:
        kept = [{} for _ in level.states]
        for e, p in zip(level.entries, level.share, strict=True):
            kept[e >> lm.BITS][int(e & lm.MASK)] = float(p)
        tables.append(({int(k): i for i, k in enumerate(level.states)}, level.rest, kept))

    def chance(before, w):
        p, i, suffix = (counts[w] + 1) / model.total, model.numbers.get(w, 0), None
        for (states, rest, kept), word in zip(tables, reversed(before), strict=False):
            key = word if suffix is None else word << lm.BITS | suffix
            if not word or key not in states:
                break
            suffix = states[key]
            p = kept[suffix].get(i, 0) * bool(i) + rest[suffix] * p
        return p

    want = []
    for d, t in rows:
        before, total = [end], 0.0
        for w in [*(t or "").encode().lower().split(), b"\n"]:
            total += math.log10(chance(before, w))
            before.append(model.numbers.get(w, 0))
        want.append((d, round(total, 4)))
    assert sorted(((r["doc_id"], round(r["score"], 4)) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    # every state's next-symbol distribution adds up to 1 over all words and the unknown one
    for before in ([end], [end, model.numbers[b"of"]], [model.numbers[w] for w in (b"house", b"of", b"the")]):
        assert abs(sum(chance(before, w) for w in counts) + chance(before, b"never") - 1) < 1e-9


def test_contexts_are_counted_as_they_occur(spark):
    rows = corpus()
    model, _ = run(spark, rows, min_count=None, state_share=1e-3, entry_share=1e-3, depth=3, min_nats=-1e9, discount=0.0)
    names = {i: w for w, i in model.numbers.items()}
    grams = Counter()
    for d, t in rows:
        if trained(d):
            words = [b"\n", *(t or "").encode().lower().split(), b"\n"]
            grams.update(tuple(words[i : i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1))
    total = sum(n for g, n in grams.items() if len(g) == 2)

    def spelled(depth, state):
        key = int(model.levels[depth].states[state])
        return (names[key],) if not depth else (names[key >> lm.BITS], *spelled(depth - 1, key & lm.MASK))

    for depth, level in enumerate(model.levels):
        assert len(level.entries)
        for e, p in zip(level.entries, level.share, strict=True):
            context = spelled(depth, int(e >> lm.BITS))
            size = sum(n for g, n in grams.items() if g[:-1] == context)
            assert abs(p * size - grams[(*context, names[int(e & lm.MASK)])]) < 1e-6 and size >= 1e-3 * total


def brute_tree(rows, depth, state_share, word_share, min_nats=10.0, discount=0.75):
    """Scores by the whole tree of all repeated contexts, held in dictionaries; trunk contexts keep the next words that have a number."""
    texts = [(d, [(b"\n"), *(t or "").encode().lower().split(), b"\n"], trained(d)) for d, t in rows]
    counts = Counter(w for _, t, on in texts if on for w in t[1:])
    total = sum(counts.values()) + len(counts) + 1
    follow = {}
    for _, t, on in texts:
        for i in range(1, len(t)):
            for k in range(1, min(depth, i) + 1):
                if on:
                    follow.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
    states = set()
    tokens = sum(counts.values())
    sizes = {c: sum(x.values()) for c, x in follow.items()}
    numbered = {w for w, n in counts.items() if n >= max(2, word_share * tokens)}
    for c, x in follow.items():
        if numbered.issuperset(c) and sizes[c] >= max(2, state_share * tokens):
            for w in set(x) - numbered:
                del x[w]

    def chance(context, w):
        p = (counts[w] + 1) / total
        for k in range(1, len(context) + 1):
            c = context[-k:]
            if c not in states:
                break
            n, kept = sizes[c], sum(follow[c].values()) - discount * len(follow[c])
            p = max(0, follow[c][w] - discount) / n + (1 - kept / n) * p
        return p

    for c in sorted(follow, key=len):
        n = sizes[c]
        if n >= 2 and (len(c) == 1 or c[1:] in states):
            if sum(m * math.log(m / n / chance(c[1:], w)) for w, m in follow[c].items()) >= min_nats:
                states.add(c)
    out = [(d, sum(math.log10(chance(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(1, len(t)))) for d, t, _ in texts]
    return sorted(((d, round(x, 2)) for d, x in out), key=str), len(states)


def test_scores_are_those_of_the_whole_tree_wherever_trunk_and_branches_part(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 700)
    monkeypatch.setattr(lm, "BUFFER", 300)
    twice = " ".join(f"w{i}" for i in range(40))
    rows = [x for x in corpus() if x[0] != 503] + [(700, twice), (701, twice), (702, twice), (703, twice + " x" * 9)]
    for state_share, word_share in ((5e-4, 1e-6), (0.02, 1e-6), (0.02, 5e-3), (0.9, 0.1)):
        want, states = brute_tree(rows, 4, state_share, word_share)
        model, got = run(spark, rows, state_share=state_share, word_share=word_share, entry_share=1e-9, depth=4)
        assert sum(len(x.states) for x in model.levels) <= states - (state_share > 0.01)
        have = sorted(((r["doc_id"], r["score"]) for r in got), key=lambda r: str(r[0]))
        for (d, x), (e, y) in zip(sorted(have, key=str), sorted(want, key=str), strict=True):
            assert d == e and abs(x - y) < 0.02, (state_share, word_share, d, x, y)


def test_scores_do_not_depend_on_where_trunk_and_branches_part(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 700)
    monkeypatch.setattr(lm, "BUFFER", 300)
    rows = [x for x in corpus() if x[0] != 503]
    rows += [(800 + i, f"of the day of once{i} in a twice{i // 2} of the pair{i // 3} of the day") for i in range(90)]
    want, _ = brute_tree(rows, 4, 2.0, 0.0)
    for state_share, word_share, entry_share in ((None, 1e-6, 2e-6), (0.02, 1e-6, 1e-3), (0.005, 4e-4, 3e-3), (0.01, 5e-3, 0.02), (0.02, 1e-6, 1.0)):
        monkeypatch.setattr(lm, "ENTRY_SHARE", entry_share, raising=False)
        model, got = run(spark, rows, state_share=state_share, word_share=word_share)
        assert bool(model.levels) == (state_share is not None)
        have = sorted(((r["doc_id"], r["score"]) for r in got), key=str)
        for (d, x), (e, y) in zip(have, sorted(want, key=str), strict=True):
            assert d == e and abs(x - y) < 0.02, (state_share, word_share, entry_share, d, x, y)


def test_repeated_texts_score_above_their_like(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    text = lambda: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 20)]
    _, got = run(spark, rows)
    copies = {t for d, t in rows if d >= 1000}
    gain = {r["doc_id"]: r["score"] - r["base_score"] for r in got}
    taught = Counter(t for d, t in rows if trained(d))
    again = [gain[d] for d, t in rows if t in copies and taught[t] == 2]
    others = [gain[d] for d, t in rows if t not in copies]
    assert again and min(again) > max(others)


def test_long_and_frequent_unseen_words(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    long = "x" * 500
    rows = [(i, f"a {long} b{i} " + ("unseen" if not trained(i) else long)) for i in range(60)]
    for share in (1e-6, 0.3):
        _, got = run(spark, rows, word_share=share)
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == brute_base(rows)


def test_no_training_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model, words = lm.fit(df, F.lit(False))
    r = lm.score(df, model, words, ["doc_id"]).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(df.limit(0), model, words, ["doc_id"]).collect() == []


def test_no_shuffle_files_stay_behind_written_tables(spark):
    df = spark.createDataFrame([(i, f"a b{i} c{i // 2}") for i in range(50)], "doc_id long, text string")
    common.release_shuffles(spark) if hasattr(common, "release_shuffles") else spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = shuffles.size()
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model, words = lm.fit(df, where)
    lm.score(df, model, words, ["doc_id"], where=where)
    time.sleep(2)
    assert shuffles.size() <= before + 2  # those of what ran last


def test_places_are_sent_in_turns(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 700)
    labels, real, rows, got = [], lm.materialize, corpus(), []
    monkeypatch.setattr(lm, "materialize", lambda df, label, *a: labels.append(label) or real(df, label, *a))
    for turns in (1, 3):
        monkeypatch.setattr(lm, "PASSES", turns)
        labels.clear()
        _, said = run(spark, rows, state_share=0.01, word_share=1e-6)
        got.append(sorted(((r["doc_id"], r["score"]) for r in said), key=str))
        assert labels.count("lm-gains") == turns and labels.count("lm-settled") == 1
    assert all(d == e and abs(x - y) < 1e-9 for (d, x), (e, y) in zip(*got, strict=True))


def test_tokens_are_the_words_that_bytes_are_cut_into():
    texts = [None, b"", b" \n\x0b", b" The\tthe\x0cEND ", b"\xff\xfe Bad \x85x\xc2\xa0 y", "ÄÖ İx".encode(), b"W" * 200 + b" a " + b"w" * 200, b"x " * 50_000, b"last"]
    for kind in (pa.binary(), pa.large_binary()):
        got = []
        for first, sizes, codes, words in lm.tokens_of(pa.array([b"cut off", *texts], kind).slice(1)):
            assert first == len(got)
            for part in np.split(codes, np.cumsum(sizes)[:-1]):
                got.append([words[c] for c in part])
        want = [[*(t or b"").lower().split(), b"\n"] for t in texts]
        assert [[b"long" if w[:1] == b"\n" and len(w) > 1 else w for w in t] for t in got] == [[w if len(w) <= lm.LONG else b"long" for w in t] for t in want]
        assert got[6][0] == got[6][2] != got[6][1] and len(got[6][0]) <= lm.LONG


def test_texts_are_numbered_once_for_the_trunk_and_the_scores(spark, monkeypatch):
    rows, calls, numbered = corpus(), [], lm._numbered
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    where = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    monkeypatch.setattr(lm, "_numbered", lambda *a: calls.append(a) or numbered(*a))
    model, words = lm.fit(df, where, state_share=1e-2, depth=2)
    assert len(model.levels)
    apart = lm.score(df, model, words, ["doc_id"], where=where).collect()
    calls.clear()
    together = lm.fit_and_score(df, where, ["doc_id"], state_share=1e-2, depth=2).collect()
    assert len(calls) == 1
    rounded = [sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in x), key=str) for x in (apart, together)]
    assert rounded[0] == rounded[1]


def test_next_words_of_the_trunk_are_counted_in_buckets_not_in_a_row_each(spark, monkeypatch):
    rows = [(i, f"of the once{i} of b{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables, real = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label, *a: tables.append((label, real(df, label, *a))) or tables[-1][1])
    monkeypatch.setattr(lm, "discard", lambda df: None)
    model, _ = lm.fit(df, F.lit(True), state_share=0.1, depth=3)
    assert len(model.levels[0].tried) == 3  # the end, of, the
    numbers, level = model.numbers, model.levels[0]
    kinds = {b"of": 1 + 5, b"the": 3000, b"\n": 1}
    for word, n in kinds.items():
        state = level.state(np.array([numbers[word]]))[0]
        if state >= 0:
            assert abs(level.rest[state] * level.sizes[state] - 0.75 * n) < 1e-6
    assert level.state(np.array([numbers[b"the"]]))[0] >= 0
    trunk = [(label, df.count()) for label, df in tables if label not in ("lm-words", "lm-local", "lm-full")]
    assert trunk and max(n for _, n in trunk) < 100, trunk


def test_gains_of_a_text_come_back_in_blobs_not_in_a_row_from_each_bucket(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 700)
    kind = type(spark.range(1))
    sent, real = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema, *a, **kw: sent.append((schema, real(df, f, schema, *a, **kw))) or sent[-1][1])
    monkeypatch.setattr(lm, "discard", lambda df: None)
    rows = corpus()
    _, got = run(spark, rows, state_share=0.01)
    gains = [df for schema, df in sent if schema == "row long, gain double"]
    assert len(gains) == lm.PASSES and all(df.count() <= len(rows) for df in gains)
    assert len(got) == len(rows)
