import copy
import math

import numpy as np
import pytest

from tracewright.llm import spm

TEXTS = ["", " ", "a", "the day", "Hello  world", "▁x▁ ▁", "é🙂\n\tfoo", "   three", "x" * 40, "日本語のテキスト", "\x00\x01", "end \n", "\n\n a"]


@pytest.fixture(scope="module")
def v():
    return spm.vocabulary(spm.DEFAULT_MODEL)


def enumerate_all(v, text):
    """Every segmentation of a short text and its normalized log-probability, from the pieces' strings alone."""
    norm = "" if not text else spm.SPACE + text.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)
    by = {p: i for i, p in enumerate(v.pieces) if i not in v.special}

    def rest(at):
        if at == len(norm):
            yield [], 0.0
            return
        options = [((by[norm[at:to]],), v.weight[by[norm[at:to]]], to) for to in range(at + 1, len(norm) + 1) if norm[at:to] in by]
        if norm[at] not in by:
            raw = (spm.SPACE if norm[at] == spm.LITERAL else norm[at]).encode()
            options.append((tuple(int(v.byte_ids[b]) for b in raw), v.byte_weight * len(raw), at + 1))
        for ids, w, to in options:
            for more, x in rest(to):
                yield [*ids, *more], w + x

    found = list(rest(0))
    top = max(w for _, w in found)
    z = top + math.log(sum(math.exp(w - top) for _, w in found))
    return {tuple(ids): w - z for ids, w in found}


def test_samples_are_distinct_scored_segmentations(v):
    for text in ["", "a", "the", "the day", "Ab  c", "▁", "é\nx", "ing"]:
        every = enumerate_all(v, text)
        for key in range(5):
            got = next(spm.sample(v, [text], np.array([key], dtype=np.uint64), k=4))
            ids = [tuple(s[0].tolist()) for s in got]
            assert len(set(ids)) == len(ids) == min(4, len(every))
            assert all(abs(every[i] - s[1]) < 1e-8 for i, s in zip(ids, got, strict=True))
            assert [s[2] for s in got] == sorted((s[2] for s in got), reverse=True)
            assert all(s[3] <= 0 for s in got) and (len(every) > 4 or all(s[3] == 0 for s in got))


def test_frequencies_follow_the_distribution_without_replacement(v):
    every = enumerate_all(v, "to a")
    runs = 6000
    got = list(spm.sample(v, ["to a"] * runs, np.arange(runs, dtype=np.uint64), k=2))
    p = {k: math.exp(w) for k, w in every.items()}
    first, second = {}, {}
    for a, b in got:
        first[tuple(a[0])] = first.get(tuple(a[0]), 0) + 1 / runs
        second[tuple(b[0])] = second.get(tuple(b[0]), 0) + 1 / runs
    for k in p:
        assert abs(first.get(k, 0) - p[k]) < 0.03
        assert abs(second.get(k, 0) - sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)) < 0.03
    # inclusion scores weight the samples back to their probabilities (Horvitz-Thompson)
    top = max(p, key=p.get)
    weights = [sum(math.exp(s[1] - s[3]) for s in x if tuple(s[0]) == top) for x in got]
    assert abs(np.mean(weights) - p[top]) < 0.05


def test_inclusion_scores_of_long_texts_are_finite(v):
    got = next(spm.sample(v, ["the day was long " * 2000], np.array([1], dtype=np.uint64), k=2))
    assert all(s[1] < -1000 and math.isfinite(s[3]) and s[1] - 1 < s[3] < 0 for s in got)
    assert abs(spm._log_arrived(-19.999) - spm._log_arrived(-20.001) - 0.002) < 1e-9 and spm._log_arrived(math.inf) == 0
    assert abs(spm._log_arrived(-1.0) - math.log(1 - math.exp(-math.exp(-1)))) < 1e-12


def test_digests_of_decoded_samples(spark):
    import hashlib

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate([*TEXTS, None])}
    got = spm.encode_samples(df, digest=True).collect()
    assert {r["doc_id"] for r in got} == set(want) and all(r["decoded_sha256"] == want[r["doc_id"]] for r in got)


def test_second_sample_of_several_chunks_follows_the_law(v):
    flat = copy.copy(v)
    flat.weight = np.zeros(len(v.pieces))
    m = len(enumerate_all(flat, "to"))
    runs = 4000
    got = list(spm.sample(flat, ["to to"] * runs, np.arange(runs, dtype=np.uint64), k=2))
    last = 0
    for a, b in got:
        texts = [[v.pieces[i] for i in x[0]] for x in (a, b)]
        cut = [next(i for i in range(1, len(t) + 1) if sum(map(len, t[:i])) == 3) for t in texts]
        last += texts[0][: cut[0]] == texts[1][: cut[1]]
    # all m * m segmentations are equally likely: m - 1 of the m * m - 1 others share the first chunk's
    assert abs(last / runs - (m - 1) / (m * m - 1)) < 0.03
    # in a long text the second sample is all but independent of the first
    same = []
    for a, b in spm.sample(flat, ["to" + " to" * 299] * 20, np.arange(20, dtype=np.uint64), k=2):
        ends = [{e: tuple(x[0][i : i + 1]) for i, e in enumerate(np.cumsum([len(v.pieces[j]) for j in x[0]]).tolist())} for x in (a, b)]
        same.append(len(set(ends[0].items()) & set(ends[1].items())) / len(ends[0]))
    alone = [next(spm.sample(flat, ["to" + " to" * 299], np.array([100 + i], dtype=np.uint64), k=1))[0][0] for i in range(20)]
    ends = [{e: int(x[i]) for i, e in enumerate(np.cumsum([len(v.pieces[j]) for j in x]).tolist())} for x in alone]
    chance = np.mean([len(set(p.items()) & set(q.items())) / len(p) for p, q in zip(ends[:-1], ends[1:], strict=True)])
    assert abs(np.mean(same) - chance) < 0.05


def test_round_trip_of_every_sample(spark, v):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (100, None), (101, "long word " * 20_000), (102, "y" * 30_000), (3, "the day")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, sample int")
    got = spm.decode_column(spm.encode_samples(df, k=3)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, t or "")
    assert all(r["decoded"] == want[r["doc_id"]] for r in got)
    assert {r["doc_id"] for r in got} == set(want)
    twice = [tuple(r["pieces"]) for r in got if r["doc_id"] == 3 and r["sample"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert spm.encode_samples(df.limit(0)).collect() == []


def test_results_depend_on_key_and_text_alone(v):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    together = [[(s[0].tolist(), s[2]) for s in x] for x in spm.sample(v, TEXTS, keys, k=3)]
    alone = [[(s[0].tolist(), s[2]) for s in next(spm.sample(v, [t], keys[i : i + 1], k=3))] for i, t in enumerate(TEXTS)]
    assert together == alone


def test_library_decodes_the_pieces_alike(v):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    for t in ["the day", "Hello  world", "é🙂\n\tfoo", "日本語"]:
        for s in next(spm.sample(v, [t], np.array([1], dtype=np.uint64), k=2)):
            assert sp.decode(s[0].tolist()) == t


def test_sums_of_chunks_agree_with_sums_in_logarithms(v, monkeypatch):
    words = list(dict.fromkeys(c for t in [*TEXTS, "the day was long", "🙂" * 60, "x" * 900, "▁" * 30] for c in spm.chunks(t)))
    calls, real = [], np.exp
    monkeypatch.setattr(spm.np, "exp", lambda x, *a, **kw: calls.append(np.size(x)) or real(x, *a, **kw))
    mixed = spm.Lattice(v, words)
    assert len(calls) < 2000  # only the deep chunks' places take logarithms
    monkeypatch.setattr(spm, "DEEP_LOG", 0.0)
    logs = spm.Lattice(v, words)
    assert np.allclose(mixed.share, logs.share, rtol=0, atol=1e-9) and np.allclose(np.log(mixed.wait), np.minimum(-mixed.share, 690.0), rtol=0, atol=1e-9)
    few = spm.Lattice(v, [w for w in words if len(w) < 40])
    calls.clear()
    monkeypatch.setattr(spm, "DEEP_LOG", -600.0)
    spm.Lattice(v, [w for w in words if len(w) < 10])
    assert len(calls) == 2 and len(few.share)
    spm.Lattice(v, [])


def test_white_space_and_lines_begin_chunks():
    s = spm.SPACE
    assert spm.chunks(f"a  b\n c{s}\n\n d ") == [f"{s}a", f"{s}{s}b", "\n", f"{s}c{spm.LITERAL}", "\n", "\n", f"{s}d", s]
