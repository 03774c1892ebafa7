"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. A source's target is whole passes over it plus a rest; the rest
is spread over the lengths in proportion to their counts, and what rounding leaves open is closed by a bounded-knapsack
dynamic program over the documents that can be added or taken away. The plan then says how many documents of each length to take,
and the ones with the smallest seeded hash are taken. Only length counts are planned with, never documents, so a plan
has at most as many rows as there are pairs of source and length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD_RE, join_hot, materialize

#: Rows of one length of one source that one task ranks; larger groups are cut into hash ranges first.
RANKED = 5_000
#: Plans of up to this many rows are broadcast to the documents; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Words around the start among which the best sum is searched where none nearer meets the budget.
WINDOW = 1 << 22
#: Join key of a length of a source.
KEY = ["__s", "__null", "__z"]


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), passes: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the total shared by weight, nobody above passes times its size.

    Sources in code point order, null last, take the weights in turn. Water filling: with sources in the order of
    the level at which they fill up, the first that the even level doesn't overfill fixes the level. One row per source
    goes through one ordering task, which bears some ten million sources; documents and lengths don't.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__k") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("__k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("__w", w)
    full = F.col("source_size") * float(passes)
    order = Window.orderBy("__full", "__k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * float(passes)).over(before), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("__full", full / F.col("__w")).withColumn("__level", level)
    fits = F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__k", "__level"))).over(every)
    return filled.withColumn("__at", F.coalesce(fits["__level"], F.lit(0.0))).select("source", "source_size", F.least(full, F.col("__at") * F.col("__w")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length (positive, distinct) to take so that their lengths come nearest to the budget.

    First the same share of every length, rounded so that the running totals stay right, which leaves at most about half
    the greatest length open. Then a bounded-knapsack dynamic program over what can be added to that and taken from it:
    its sums are searched up to twice the greatest length around the start and, where none of those meets the budget, up
    to WINDOW, so of up to WINDOW words in all the nearest of all subset sums is found. Lengths are divided by their
    greatest common divisor first, so a budget that no sum can meet for that reason costs no search.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int(lengths @ counts)
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))
    lengths, total, budget = lengths // unit, total // unit, budget / unit
    order = np.argsort(lengths, kind="stable")
    running = np.floor(np.cumsum(counts[order] * (budget / total)) + 0.5).astype(np.int64)
    start = np.empty_like(counts)
    start[order] = np.clip(np.diff(running, prepend=0), 0, counts[order])
    near, reach = None, 2 * int(lengths.max())
    for width in sorted({min(total, reach), min(total, max(reach, WINDOW))}):
        take = _nearest_sum(lengths, counts, start, order, budget, width)
        miss = abs(budget - float(lengths @ take))
        if near is None or miss < near[0]:
            near = (miss, take)
        if miss <= 0.5:
            break
    return near[1]


def _nearest_sum(lengths: np.ndarray, counts: np.ndarray, start: np.ndarray, order: np.ndarray, budget: float, width: int) -> np.ndarray:
    """The start with documents added and taken away, whose sum is nearest to the budget; sums up to width from the start are searched."""
    left = budget - float(lengths @ start)
    goal = round(left)
    lowest = -width - abs(goal)
    size = 2 * -lowest + 1
    reach = np.zeros(size, dtype=bool)
    reach[-lowest] = True
    step = np.zeros(size, dtype=np.int32)
    parts: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        if reach[goal - lowest]:
            break
        n = int(lengths[i])
        for sign, free in ((1, int(counts[i] - start[i])), (-1, int(start[i]))):
            free, copies = min(free, (size - 1) // n), 1
            while free > 0:
                copies = min(copies, free)
                new, span = np.zeros(size, dtype=bool), n * copies
                if sign > 0:
                    new[span:] = reach[: size - span]
                else:
                    new[: size - span] = reach[span:]
                new &= ~reach
                step[new] = len(parts)
                parts.append((int(i), sign * copies))
                reach |= new
                free, copies = free - copies, copies * 2
    sums = np.flatnonzero(reach) + lowest
    at = int(sums[np.argmin(np.abs(sums - left))])
    take = start.copy()
    while at:
        i, copies = parts[step[at - lowest]]
        take[i] += copies
        at -= int(lengths[i]) * copies
    return take


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (1, 2, 3), passes: int = 3, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents narrowed to id, source, size and hash; plan per source and size with source_size, target, whole passes and the hash up to which one more is taken)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(id_col, seed).alias("h"))
    narrow = materialize(narrow, "mix-sizes")
    counts = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sized = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, passes)
    kind = dict(counts.dtypes)["source"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(passes, int(target // total)) if total else 0
        pdf = pdf.sort_values("size")
        some = (pdf["size"] > 0).to_numpy()
        take = np.zeros(len(pdf), dtype=np.int64)
        if whole < passes and total:
            take[some] = fit_budget(pdf["size"].to_numpy(np.int64)[some], pdf["n"].to_numpy(np.int64)[some], target - whole * total)
        return pdf.assign(whole=whole, take=take)[["source", "size", "n", "source_size", "target", "whole", "take"]]

    joined = counts.join(sized.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    made = joined.groupBy("source").applyInPandas(fit, f"source {kind}, size long, n long, source_size long, target double, whole long, take long")
    made = materialize(_keyed(made, "source", "size"), "mix-plan")
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # the hash up to which documents of a length are taken, found within hash ranges of about RANKED rows
    share = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    u = F.shiftrightunsigned("h", 1)
    some = made.where("take > 0 and take < n").select(*KEY, F.col("n").alias("m"), "n", "take")
    part = join_hot(_keyed(narrow, "source", "size").select(*KEY, "h"), some, KEY, "m", total)
    part = part.select(*KEY, "take", u.alias("u"), F.floor(share * F.ceil(F.col("n") / RANKED)).alias("range"))
    ranges = part.groupBy(*KEY, "range").agg(F.count("*").alias("m"), F.max("take").alias("take"), F.max("u").alias("top"))
    upto = F.sum("m").over(Window.partitionBy(*KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = materialize(ranges.withColumn("upto", upto), "mix-ranges")
    edge = ranges.where((F.col("upto") - F.col("m") < F.col("take")) & (F.col("upto") > F.col("take"))).select(*KEY, "range", (F.col("take") - F.col("upto") + F.col("m")).alias("need"))
    inside = part.drop("take").join(edge, [*KEY, "range"])
    inside = inside.withColumn("c", F.count("*").over(Window.partitionBy(*KEY, "range").orderBy("u"))).where("c <= need").select(*KEY, "u")
    whole_ranges = ranges.where("upto <= take").select(*KEY, F.col("top").alias("u"))
    cuts = inside.unionByName(whole_ranges).groupBy(*KEY).agg(F.max("u").alias("cut"))
    done = made.join(cuts, KEY, "left")
    cut = F.when(F.col("take") >= F.col("n"), F.lit(2**63 - 1)).when(F.col("take") > 0, F.coalesce("cut", F.lit(-1))).otherwise(F.lit(-1))
    return narrow, materialize(done.select(*KEY, "n", "source_size", "target", "whole", cut.cast("long").alias("cut")), "mix-cuts")


def _keyed(rows: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """rows with the join key of a length of a source; a null source is one of its own."""
    source = F.col(source_col).cast("string")
    return rows.withColumns({"__s": F.coalesce(source, F.lit("")), "__null": source.isNull(), "__z": F.col(size_col)})


def _hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def _placed(rows: DataFrame, cuts: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """rows with their length's plan: broadcast up to BROADCAST_ROWS lengths, else joined with the frequent lengths broadcast."""
    side = cuts.select(*KEY, F.col("n").alias("__n"), F.col("source_size").alias("__total"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    rows = _keyed(rows, source_col, size_col)
    if cuts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), KEY)
    return join_hot(rows, side, KEY, "__n", int(cuts.agg(F.sum("n")).first()[0]))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: taken words count repeats and are 0 to passes times the size.

    Rows that share an id, source and size share one decision; a null text has size 0 and a null source is a source;
    an empty table gives an empty result. The seed and the ids fix the choice, so reruns agree.
    """
    narrow, cuts = plan(docs, **options)
    more = (F.shiftrightunsigned("h", 1) <= F.col("__cut")).cast("long")
    rows = _placed(narrow, cuts, "source", "size")
    return rows.select("doc_id", "size", F.col("__total").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * (F.col("__whole") + more)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it was taken (not at all, once, or up to passes times)."""
    _, cuts = plan(docs, id_col, source_col, text_col, seed=seed, **options)
    rows = _placed(docs.withColumn("__size", word_count(text_col)), cuts, source_col, "__size")
    copies = F.when(F.col("__size") > 0, F.col("__whole") + (F.shiftrightunsigned(_hash(id_col, seed), 1) <= F.col("__cut")).cast("long")).otherwise(0)
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
