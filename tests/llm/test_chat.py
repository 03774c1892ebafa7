import hashlib
import random
import re

from pyspark.sql import functions as F

from tracewright.llm import chat

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<<||\\", "<\\\\|x", "a\n<|im_end|>\n", "<|", "|>", "\\", "%0A", "", "é<|🙂"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for c, turns in convs.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        esc = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
        size = sum(len(chat.START + chat.END) + 1 + len(esc(r.replace("%", "%25").replace("\n", "%0A"))) + len(esc(x)) for r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), size))
    return sorted(out, key=str)


def test_digests_match_brute_force(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(HARD)) for c in range(12) for t in range(r.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(70)]
    rows += [(60, 0, None, None), (60, None, "user", "x"), (61, 1, "a\nb%", "y"), (61, 1, "a\nb%", "y"), (None, 0, "user", "z"), (None, 1, "assistant", None), (62, 0, "assistant", "w" * 300_000), (63, 0, "<|im_end|>", "q")]
    df = frame(spark, rows).withColumn("n", F.lit(1)).withColumn("formatted", F.lit("clash"))
    assert sorted(map(tuple, chat.digests(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert chat.digests(frame(spark, [])).collect() == []


def test_best_branch_of_a_tree(spark):
    #     1 -> 2 -> 4 (2+5+1), 1 -> 3 -> 5 (2+4+1), 3 -> 6 (2+4+2): tie of 4 and 6, the smaller id stays first
    rows = [(1, None, 2.0), (2, 1, 5.0), (3, 1, 4.0), (4, 2, 1.0), (5, 3, 1.0), (6, 3, 2.0), (10, 99, 1.0), (20, 21, 1.0), (21, 20, 1.0), (None, 1, 9.0), (30, None, None)]
    df = spark.createDataFrame(rows, "msg_id long, parent_id long, score double")
    got = {}
    for r in chat.reply_paths(df, branches=2).orderBy("root", "rank", "depth").collect():
        got.setdefault((r["root"], r["rank"]), []).append(r["node"])
    assert got == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 6], (10, 1): [10], (30, 1): [30]}


def test_random_trees_match_a_walk(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(i) if i % 40 else None, float(r.randint(0, 5))) for i in range(200)]
    parent, score = {i: p for i, p, _ in rows}, {i: s for i, _, s in rows}

    def walk(i):
        return [i] if parent[i] is None else walk(parent[i]) + [i]

    best = {}
    for i in set(parent) - set(parent.values()):
        p = walk(i)
        best[p[0]] = min(best.get(p[0], (1, 0, 0, [])), (-sum(score[x] for x in p), -len(p), i, p))
    got = {}
    for x in chat.reply_paths(spark.createDataFrame(rows, "msg_id long, parent_id long, score double")).orderBy("root", "depth").collect():
        got.setdefault(x["root"], []).append(x["node"])
    assert got == {k: v[3] for k, v in best.items()}
