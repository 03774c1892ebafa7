import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import common, langid

VOCAB = {
    "en": "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei in hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden und will zwischen".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on ses tout aux cette été leurs fait être même aussi sans peut après deux leur bien entre encore alors sous donc ainsi dont elle ils ces était avait très où faire depuis contre toujours premier année moins".split(),
}


def sentence(r, lang, n):
    return " ".join(r.choice(VOCAB[lang]) for _ in range(n))


def rows(n=400, seed=3):
    r = random.Random(seed)
    return [(i, sentence(r, k := r.choice(list(VOCAB)), r.randint(8, 60)), k) for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(df, ~held)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    test = [(i, k) for i, _, k in rows() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == k for i, k in test) / len(test) > 0.97
    assert sum(got[i]["lang_accepted"] for i, _ in test) / len(test) > 0.95
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    other = spark.createDataFrame([("совсем другой язык и буквы " * 5,), ("日本語の文章です" * 9,)], "text string")
    assert [r["lang_accepted"] for r in langid.identify(other, model).collect()] == [False, False]


def test_null_empty_long_and_repeated_rows(spark):
    model = langid.train([t for _, t, _ in rows(120)], [k for *_, k in rows(120)])
    long = sentence(random.Random(1), "de", 120_000)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "the and of"), (4, long), (4, long)], "doc_id long, text string")
    got = sorted(map(tuple, langid.identify(df, model).select("doc_id", "lang_pred", "lang_accepted").collect()), key=str)
    assert got == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", True), (4, "de", True), (4, "de", True)], key=str)


def test_pieces_of_a_long_text_are_those_of_the_whole(monkeypatch):
    text = sentence(random.Random(2), "fr", 500)
    whole = np.bincount(np.concatenate(list(langid.subwords(text, 14))), minlength=1 << 14)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert (np.bincount(np.concatenate(list(langid.subwords(text, 14))), minlength=1 << 14) == whole).all()


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert langid.identify(df, model).select("lang_pred").collect()[0][0] == "und"
    assert langid.identify(df.limit(0), model).collect() == []


def plain_logits(model, text):
    """By the definitions alone: every run of 2 to 4 bytes within a word and its blanks, one embedding sum at a time."""
    data = b" " + b"".join(bytes([c]) if c >= 128 or chr(c).isalpha() else b" " for c in text.lower().encode()) + b" "
    total, n, every = 0.0, 0, 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if b" " in gram[1:-1] or gram[:1] == gram[-1:] == b" ":
                continue
            x = 0
            for c in gram:
                x = (x * 257 + c) % 2**32
            fine = ((x ^ size * 0x51ED27 % 2**32) * 0x9E3779B1 % 2**32) >> 12
            every += 1
            if model.known[fine]:
                total, n = total + model.table[fine >> 20 - model.bits], n + 1
    return total / max(1, n) + model.bias, n / max(1, every)


def test_predictions_match_a_plain_computation():
    model = langid.train([t for _, t, _ in rows(120)], [k for *_, k in rows(120)])
    for text in ["The of, and 12 Über-x", "zq", "une été " * 50]:
        z, known = plain_logits(model, text)
        p = np.exp(z / model.temperature - max(z / model.temperature))
        lang, score, accepted = model.predict(text)
        assert lang == model.langs[int(np.argmax(z))] and abs(score - max(p / p.sum())) < 1e-9
        assert accepted == (score >= model.accept and known >= model.accept_known)


def test_tail_of_an_exponential_variable():
    x = 5 - np.random.default_rng(1).exponential(1.0, 100_000)
    assert abs(langid.lower_tail(x, 1e-3) - (5 + np.log(1e-3))) < 0.2 and langid.lower_tail(np.array([1.0]), 0.5) <= 1.0


def test_packed_counts():
    fine, times = langid.unpack(langid.pack(np.array([3, 7, (1 << 20) - 1]), np.array([1, 10_000, 4095])).tobytes())
    assert np.bincount(fine, times)[[3, 7, (1 << 20) - 1]].tolist() == [1, 10_000, 4095]


def test_a_fit_leaves_the_driver_no_freed_memory(spark):
    """Sampled rows come as many small arrays; what the allocator keeps of them stays with the driver for all later stages."""

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    df = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 300), i -> substr(md5(concat(id, ':', i)), 1, 8))) as text", "if(id % 2 = 0, 'a', 'b') as lang")
    langid.fit(df, F.lit(True), epochs=1)
    after = held()
    common.give_back()
    assert after - held() < 20
