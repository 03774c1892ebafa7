"""Agreement, contingency and resampling statistics, as aggregates over keyed frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most cells of a table that is permuted on the driver's account.
MAX_CELLS = 100_000


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed): pairs that occur."""
    return df.groupBy(a, b).agg(F.count("*").alias("observed"))


def dense_grid(cells: DataFrame, a: str, b: str) -> DataFrame:
    """observed and expected of every pair of the two key sets, missing pairs as 0. The key sets are the margins of a table."""
    rows, cols = cells.groupBy(a).agg(F.sum("observed").alias("__r")), cells.groupBy(b).agg(F.sum("observed").alias("__c"))
    total = cells.agg(F.sum("observed").alias("__n"))
    grid = rows.crossJoin(cols).crossJoin(total).join(cells, [a, b], "left")
    return grid.select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("__r") * F.col("__c") / F.col("__n")).alias("expected"))


def residuals(grid: DataFrame) -> DataFrame:
    return grid.withColumn("residual", (F.col("observed") - F.col("expected")) / F.sqrt("expected"))


def chi_square(grid: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, n, cells with an expected count under 5, Cramer's V and its bias-corrected form."""
    one = grid.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"), F.sum("observed").alias("n"), F.count_if(F.col("expected") < 5).alias("low_expected_cells"))
    return one.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), "n", "low_expected_cells", *cramers_v(F.col("chi2"), F.col("n"), F.col("r"), F.col("c")))


def chi_square_p(chi2: Column, dof: Column) -> Column:
    """Upper tail probability of a chi-square variable, by the power series of the lower incomplete gamma function; null without a degree of freedom.

    Beyond 1,000 and six times the degrees of freedom it is below any printed precision, and 0.
    """
    a, x = dof.cast("double") / 2, chi2.cast("double") / 2
    far = x > F.greatest(F.lit(500.0), 3 * a)
    terms = F.when(far, 1).otherwise(F.ceil(F.greatest(F.lit(400.0), 2 * x)) + 100).cast("int")
    # log gamma(a + 1) of a half-integer: steps of 1 up from 1 or from gamma(1/2)
    odd = dof % 2 == 1
    steps = F.sequence(F.lit(0), F.greatest(F.floor(a).cast("int"), F.lit(0)))
    start = F.when(odd, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    log_gamma = F.aggregate(steps, start, lambda s, i: s + F.when(odd, F.log(i + 0.5)).when(i > 0, F.log(i.cast("double"))).otherwise(0.0))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), terms), zero, step)["sum"]
    below = F.exp(a * F.log(x) - x - log_gamma) * series
    return F.when(dof <= 0, None).when(chi2 <= 0, 1.0).when(far, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - below))


def cramers_v(chi2: Column, n: Column, r: Column, c: Column) -> list[Column]:
    phi2 = chi2 / n
    fixed = F.greatest(F.lit(0.0), phi2 - (c - 1) * (r - 1) / (n - 1))
    rc, cc = r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)
    low = F.least(rc, cc) - 1
    return [F.sqrt(phi2 / F.least(r - 1, c - 1)).alias("cramers_v"), F.when(low > 0, F.sqrt(fixed / low)).otherwise(0.0).alias("cramers_v_corrected")]


def project_dominance(cells: DataFrame, a: str, b: str) -> DataFrame:
    """The largest cell of each row, its share, and how many cells aren't empty."""
    out = cells.groupBy(a).agg(F.min_by(b, F.struct(-F.col("observed"), F.col(b))).alias("dominant"), F.max("observed").alias("n_dominant"), F.sum("observed").alias("total"), F.count_if(F.col("observed") > 0).alias("n_nonzero"))
    return out.withColumn("dominant_ratio", F.col("n_dominant") / F.col("total")).withColumn("is_dominated", F.col("n_dominant") / F.col("total") > 0.6)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, adjusted Rand index, normalized mutual information (arithmetic mean) and V-measure of two labelings."""
    cells = contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    x = F.col("observed").cast("double")
    pairs = lambda c: c * (c - 1) / 2
    entropy = lambda side: cells.groupBy(side).agg(F.sum("observed").cast("double").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(f"p_{side}"), F.sum(F.col("m") * F.ln("m")).alias(f"e_{side}"))
    one = cells.agg(F.sum(x).alias("n"), F.sum(pairs(x)).alias("p"), F.sum(x * F.ln(x)).alias("e")).crossJoin(entropy(a)).crossJoin(entropy(b))  # one row each
    n, pa, pb = F.col("n"), F.col(f"p_{a}"), F.col(f"p_{b}")
    expected = pa * pb / pairs(n)
    ari = F.when((pa + pb) / 2 == expected, 1.0).otherwise((F.col("p") - expected) / ((pa + pb) / 2 - expected))
    ha, hb = F.ln(n) - F.col(f"e_{a}") / n, F.ln(n) - F.col(f"e_{b}") / n
    mi = F.col("e") / n - F.col(f"e_{a}") / n - F.col(f"e_{b}") / n + F.ln(n)
    nmi = F.when(ha + hb == 0, 1.0).otherwise(2 * mi / (ha + hb))
    return one.select(n.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"), nmi.alias("v_measure"))


def dominant_fraction(df: DataFrame, original: str, other: str) -> DataFrame:
    """The label of the other labeling that most of each original cluster has (ties: the smallest), and its share."""
    c = df.groupBy(original, other).agg(F.count("*").alias("n"))
    return c.groupBy(original).agg(F.min_by(other, F.struct(-F.col("n"), F.col(other))).alias("dominant_label"), (F.max("n") / F.sum("n")).alias("dominant_fraction"))


def noise_rates(df: DataFrame, original: str, other: str) -> DataFrame:
    """How often noise stays noise, other rows become noise, and noise is right."""
    a, b = F.col(original) == -1, F.col(other) == -1
    rate = lambda x, y: F.count_if(x & y) / F.nullif(F.count_if(y), F.lit(0))
    return df.agg(rate(b, a).alias("noise_to_noise"), rate(b, ~a).alias("nonnoise_to_noise"), rate(a, b).alias("noise_precision"))


def stable_clusters(summary: DataFrame) -> DataFrame:
    """summary (label, dominant_fraction, noise_fraction) with its stability class; noise is left out."""
    d, q = F.col("dominant_fraction"), F.col("noise_fraction")
    kind = F.when((d >= 0.7) & (q <= 0.35), "stable").when((d < 0.6) | (q > 0.5), "unstable").otherwise("intermediate")
    return summary.where("label <> -1").withColumn("stability", kind)


def recommendation(ari: Column, ari_nonnoise: Column, noise: Column, n_unstable: Column) -> Column:
    good = (ari >= 0.55) & (ari_nonnoise >= 0.6) & (n_unstable <= 2) & (noise <= 0.55)
    fair = (ari >= 0.45) & (ari_nonnoise >= 0.5)
    return F.when(good, "maintain_current_hdbscan_and_proceed_to_stability_reporting").when(fair, "keep_current_hdbscan_for_now_but_report_noise_and_small_cluster_sensitivity").otherwise("consider_parameter_retuning_before_final_role_claims")


def rank_k_by_quality(metrics: DataFrame) -> DataFrame:
    """Competition ranks of the three quality measures alone over k, their sum, and the best k: least sum, then greatest silhouette, then least k."""
    every = lambda o: F.rank().over(Window.orderBy(o))
    total = every(F.desc("silhouette")) + every(F.asc("davies_bouldin")) + every(F.desc("calinski_harabasz"))
    best = Window.orderBy("rank_sum", F.desc("silhouette"), "k")
    return metrics.withColumn("rank_sum", total).withColumn("selected", F.row_number().over(best) == 1)


def agreement_by(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, ari, nmi, v_measure) of two labelings within each group, from contingency counts."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    logs = lambda c: F.sum(F.col(c) * F.log(F.col(c).cast("double")))
    cells = df.groupBy(group, a, b).agg(F.count("*").alias("o"))
    side = lambda c, x: cells.groupBy(group, c).agg(F.sum("o").alias("m")).groupBy(group).agg(pairs("m").alias(f"p{x}"), logs("m").alias(f"e{x}"))
    one = cells.groupBy(group).agg(F.sum("o").alias("n"), pairs("o").alias("p"), logs("o").alias("e")).join(side(a, "a"), group).join(side(b, "b"), group)
    n = F.col("n")
    chance = F.col("pa") * F.col("pb") / (n * (n - 1) / 2)
    room = (F.col("pa") + F.col("pb")) / 2 - chance
    ha, hb = F.log(n) - F.col("ea") / n, F.log(n) - F.col("eb") / n
    shared = F.log(n) + (F.col("e") - F.col("ea") - F.col("eb")) / n
    nmi = F.when(ha + hb > 1e-12, 2 * shared / (ha + hb)).otherwise(1.0)
    return one.select(group, "n", F.when(room.isNull() | (F.abs(room) < 1e-12), 1.0).otherwise((F.col("p") - chance) / room).alias("ari"), nmi.alias("nmi"), nmi.alias("v_measure"))


def summary(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, runs, mean, median, std, min, max) of each column over repeated runs; std is the sample deviation."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    named = {"mean": F.avg("v"), "median": F.median("v"), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")}
    return long.groupBy("metric").agg(F.count("v").alias("runs"), *[c.alias(n) for n, c in named.items()])


def rank_k(metrics: DataFrame) -> DataFrame:
    """Competition ranks of five quality columns over k, and their sum. One row per k."""
    every = lambda o: F.rank().over(Window.orderBy(o))
    ranks = {"rank_silhouette": F.desc("silhouette"), "rank_davies_bouldin": F.asc("davies_bouldin"), "rank_calinski_harabasz": F.desc("calinski_harabasz"), "rank_largest_balance": F.asc("largest_cluster_ratio"), "rank_smallest_cluster": F.desc("smallest_cluster_size")}
    out = metrics.withColumns({k: every(o) for k, o in ranks.items()})
    return out.withColumn("combined_rank_score", sum((F.col(k) for k in ranks), F.lit(0)))


def recommend_k(ranked: DataFrame, least: int = 100, largest: float = 0.5) -> DataFrame:
    """ranked with recommended: the best rank among those within the size limits, or among all if none is."""
    fits = (F.col("smallest_cluster_size") >= least) & (F.col("largest_cluster_ratio") <= largest)
    order = Window.orderBy(F.desc("__fits"), "combined_rank_score", "k")
    return ranked.withColumn("__fits", fits.cast("int")).withColumn("recommended", F.row_number().over(order) == 1).drop("__fits")


def subsample(df: DataFrame, key: str, share: float, repeats: int, seed: int = 42) -> DataFrame:
    """rep and the rows of each repeat: exactly round(share * n) rows without replacement, by seeded hash."""
    n = df.count()
    m = round(share * n)
    reps = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))
    w = Window.partitionBy("rep").orderBy(F.xxhash64(F.col(key), F.lit(seed) + F.col("rep")), key)
    return df.crossJoin(F.broadcast(reps)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= m).drop("__r")  # repeats rows


def permutation_p(df: DataFrame, a: str, b: str, repeats: int = 1000, seed: int = 42) -> DataFrame:
    """chi2 and the share of label permutations whose statistic is as large: the counts of a fixed-margin table are drawn, not the rows."""
    cells = contingency(df, a, b).limit(MAX_CELLS + 1).toPandas()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} cells; a permutation test needs a small table")
    table = cells.pivot_table(index=a, columns=b, values="observed", fill_value=0, aggfunc="sum").to_numpy().astype(np.int64)
    rows, cols, n = table.sum(axis=1), table.sum(axis=0), table.sum()
    expected = np.outer(rows, cols) / n
    stat = float(((table - expected) ** 2 / expected).sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rep in pdf["id"]:
                rng, left, sim = np.random.default_rng([seed, int(rep)]), cols.copy(), []
                for r in rows:
                    got = rng.multivariate_hypergeometric(left, int(r))
                    sim.append(got)
                    left = left - got
                out.append(float(((np.array(sim) - expected) ** 2 / expected).sum()))
            yield pd.DataFrame({"chi2": out})

    sims = df.sparkSession.range(repeats).mapInPandas(draw, "chi2 double")
    return sims.agg(F.lit(stat).alias("chi2"), F.lit(repeats).alias("repeats"), ((F.count_if(F.col("chi2") >= stat - 1e-9) + 1) / (F.lit(repeats) + 1)).alias("p_value"))
