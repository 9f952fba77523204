"""Tests, effect sizes, intervals and resampling; clusters give sufficient statistics, the driver the last formula."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import special
from lodestone.plans.durable import written
from lodestone.plans.patterns import dealt, ranks, ratio, running_by, running_extreme, thresholds


def two_sample(df: DataFrame, value: str, group: str, a: object, b: object) -> dict[str, float | None]:
    """Welch's t, Cohen's d and Hedges' g of group a against b; None where a group has fewer than two values or neither has a
    spread. Null values take no part."""
    rows = {r[0]: r[1:] for r in df.filter(F.col(group).isin(a, b)).groupBy(F.col(group)).agg(F.count(value), F.avg(value), F.var_samp(value)).collect()}
    (n, m, v), (k, q, u) = (rows.get(g) or (0, None, None) for g in (a, b))
    if n < 2 or k < 2 or v + u == 0:
        return dict.fromkeys(("statistic", "df", "p_value", "cohens_d", "hedges_g"))
    se = v / n + u / k
    t, dof = (m - q) / math.sqrt(se), se**2 / ((v / n) ** 2 / (n - 1) + (u / k) ** 2 / (k - 1))
    pooled = math.sqrt(((n - 1) * v + (k - 1) * u) / (n + k - 2))
    d = (m - q) / pooled
    j = math.exp(math.lgamma((n + k - 2) / 2) - math.lgamma((n + k - 3) / 2)) / math.sqrt((n + k - 2) / 2) if n + k > 3 else None
    return {"statistic": t, "df": dof, "p_value": 2 * special.student_sf(abs(t), dof), "cohens_d": d, "hedges_g": d * j if j else None}


def welch_statistics(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """(statistic, df, cohens_d) as one row, without p-value; null where a group has fewer than two values or neither has a
    spread. Null values take no part."""
    d = df.select(F.col(value).cast("double").alias("x"), F.col(group).alias("g")).filter(F.col("g").isin(a, b))
    s = d.agg(*(f(F.when(F.col("g") == g, F.col("x"))).alias(f"{k}{i}") for i, g in enumerate((a, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    s = s.select("*", F.expr("v0 / nullif(n0, 0) + v1 / nullif(n1, 0)").alias("se"), F.expr("((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0)").alias("pooled"))
    df_ = ratio(F.expr("se * se"), F.expr("(v0 / nullif(n0, 0)) * (v0 / nullif(n0, 0)) / nullif(n0 - 1, 0) + (v1 / nullif(n1, 0)) * (v1 / nullif(n1, 0)) / nullif(n1 - 1, 0)"), None)
    return s.select(ratio(F.expr("m0 - m1"), F.sqrt("se"), None).alias("statistic"), df_.alias("df"), ratio(F.expr("m0 - m1"), F.sqrt("pooled"), None).alias("cohens_d"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, df, cohens_dz) of the paired differences; null where fewer than two differ at all or all are equal. A pair
    with a null takes no part."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    size = ratio(F.col("m"), F.col("s"), None)
    return s.select((size * F.sqrt("n")).alias("statistic"), (F.col("n") - 1).alias("df"), size.alias("cohens_dz"))


def mann_whitney(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """(u, z, auc, cliffs_delta) of group a against b, by mid-ranks of counted values with the tie term; z is null when all
    values are equal, all are null when a group is empty. Null values take no part."""
    known = df.select(F.col(value).cast("double").alias("x"), F.col(group).alias("g")).filter(F.col("g").isin(a, b) & F.col("x").isNotNull())
    r = ranks(known, "x", "g")
    mine = F.when(F.col("g") == a, F.col("n_group")).otherwise(0)
    other = F.when(F.col("g") == b, F.col("n_group")).otherwise(0)
    cells = r.groupBy("value").agg(F.sum(mine).alias("na"), F.sum(other).alias("nb"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    s = cells.agg(F.sum("na").cast("double").alias("na"), F.sum("nb").cast("double").alias("nb"), F.sum(F.col("na") * F.col("rank")).alias("ra"), F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    u = F.expr("ra - na * (na + 1) / 2")
    sd = F.sqrt(F.expr("na * nb / 12 * (na + nb + 1 - ties / nullif((na + nb) * (na + nb - 1), 0))"))
    auc = ratio(u, F.expr("na * nb"), None)
    return s.select(u.alias("u"), ratio(u - F.expr("na * nb / 2"), sd, None).alias("z"), auc.alias("auc"), (2 * auc - 1).alias("cliffs_delta"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, df, epsilon_squared) with tie correction; h is null when all values are equal or there are none. Rows with a null
    take no part."""
    known = df.select(F.col(value).cast("double").alias("x"), F.col(group).alias("g")).filter("x is not null and g is not null")
    r = ranks(known, "x", "g")
    sums = r.groupBy("g").agg(F.sum(F.col("n_group") * F.col("rank")).alias("r"), F.sum("n_group").alias("n"))
    ties = r.select("value", "n").distinct().agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("ties"))
    s = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), (F.count("*") - 1).alias("df")).crossJoin(F.broadcast(ties))
    h = ratio(F.expr("12 / nullif(n * (n + 1), 0) * q - 3 * (n + 1)"), F.expr("1 - ties / nullif(n * n * n - n, 0)"), None)
    return s.select(h.alias("h"), "df", ratio(h, F.col("n") - 1, None).alias("epsilon_squared"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(statistic, df, kendalls_w): mid-ranks within each block; null when every block has all values tied or there are none.
    Rows with a null take no part."""
    known = df.select(F.col(block).alias("block"), F.col(treatment).alias("treatment"), F.col(value).alias("value")).dropna()
    w = Window.partitionBy("block")
    same = Window.partitionBy("block", "value")
    placed = known.select("block", "treatment", (F.rank().over(w.orderBy("value")) + (F.count("*").over(same) - 1) / 2).alias("r"), F.count("*").over(same).alias("c"), F.count("*").over(w).alias("k"))
    per = placed.groupBy("treatment").agg(F.sum("r").alias("r"), F.first("k").cast("double").alias("k"))
    more = placed.agg(F.countDistinct("block").cast("double").alias("b"), F.sum(F.col("c") * F.col("c") - 1).cast("double").alias("ties"))
    s = per.agg(F.sum(F.col("r") * F.col("r")).alias("q"), F.first("k").alias("k")).crossJoin(F.broadcast(more))
    x = ratio(F.expr("12 / nullif(b * k * (k + 1), 0) * q - 3 * b * (k + 1)"), F.expr("1 - ties / nullif(b * k * (k * k - 1), 0)"), None)
    return s.select(x.alias("statistic"), (F.col("k") - 1).cast("long").alias("df"), ratio(x, F.expr("b * (k - 1)"), None).alias("kendalls_w"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w_plus, w_minus, rank_biserial) of the signed ranks without zero differences; the last is null where all are zero."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).filter("d <> 0").select(F.abs("d").alias("m"), F.signum("d").alias("s"))
    r = ranks(d, "m", "s")
    s = r.agg(F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("n_group") * F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("s") < 0, F.col("n_group") * F.col("rank"))), F.lit(0.0)).alias("w_minus"))
    return s.select("w_plus", "w_minus", ratio(F.expr("w_plus - w_minus"), F.expr("w_plus + w_minus"), None).alias("rank_biserial"))


def mcnemar(df: DataFrame, correct_a: str, correct_b: str) -> DataFrame:
    """(b, c, statistic): discordant pairs and chi-square with continuity correction (0 without any)."""
    s = df.agg(F.count_if((F.col(correct_a) == 1) & (F.col(correct_b) == 0)).alias("b"), F.count_if((F.col(correct_a) == 0) & (F.col(correct_b) == 1)).alias("c"))
    return s.select("b", "c", F.expr("case when b + c = 0 then 0.0D else power(greatest(abs(b - c) - 1, 0), 2) / (b + c) end").alias("statistic"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact for fewer than 25 discordant pairs, else chi-square with continuity correction."""
    if b + c == 0:
        return 1.0
    return special.binomial_two_sided(b, b + c) if b + c < 25 else special.chi2_sf(max(abs(b - c) - 1, 0) ** 2 / (b + c), 1)


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """(statistic, df, cramers_v) of a contingency table, without continuity correction; cramers_v is null for a table of one
    row or column. Rows with a null take no part."""
    cells = df.select(F.col(row).alias("i"), F.col(column).alias("j")).dropna().groupBy("i", "j").agg(F.count("*").cast("double").alias("o"))
    rows, columns = cells.groupBy("i").agg(F.sum("o").alias("r")), cells.groupBy("j").agg(F.sum("o").alias("c"))
    s = rows.crossJoin(columns).join(cells, ["i", "j"], "left").na.fill(0.0, ["o"])  # a row for each cell of the table
    s = s.agg(F.sum("o").alias("n"), F.countDistinct("i").alias("k"), F.countDistinct("j").alias("m"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"))
    x = F.expr("n * (q - 1)")
    return s.select(x.alias("statistic"), F.expr("(k - 1) * (m - 1)").alias("df"), F.sqrt(ratio(x, F.expr("n * (least(k, m) - 1)"), None)).alias("cramers_v"))


def adjust_pvalues(df: DataFrame, key: str, p: str, family: Sequence[str] = ()) -> DataFrame:
    """``df`` with bonferroni, holm, hochberg, bh and by adjusted values, within each family: numbers, a running maximum and running
    minima from the end over the ordered p-values, by ranges, so a large family is many tasks. A null p stays null and does
    not count."""
    named = df.withColumns({"__family": F.to_json(F.struct(F.lit(0).alias("x"), *family)), "__p": F.col(p).cast("double"), "__key": F.col(key)})
    known = named.filter("__p is not null")
    order = ["__p", "__key"]
    placed = running_by(dealt(known, ["__family", *order]), order, {"n": F.lit(1)}, ["__family"])
    i, n, value = F.col("cum_n"), F.col("all_n"), F.col("__p")
    step, share = (n - i + 1) * value, value * n / i
    tuned = running_extreme(written(placed, "numbered"), order, {"holm": (step, "max", False), "hochberg": (step, "min", True), "bh": (share, "min", True)}, ["__family"])
    one = lambda c: F.least(F.lit(1.0), c)
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(1000))), F.lit(0.0), lambda a, k: a + 1.0 / k)
    # beyond 1,000 the sum follows from its expansion, which is exact to the last digits there
    sums = F.when(n <= 1000, harmonic).otherwise(F.log(n.cast("double")) + 0.5772156649015329 + 1 / (2.0 * n) - 1 / (12.0 * n * n))
    told = tuned.select(*df.columns, one(value * n).alias("bonferroni"), *(one(F.col(c)).alias(c) for c in ("holm", "hochberg", "bh")), one(F.col("bh") * sums).alias("by"))
    none = F.lit(None).cast("double")
    return told.unionByName(named.filter("__p is null").select(*df.columns, *(none.alias(c) for c in ("bonferroni", "holm", "hochberg", "bh", "by"))))


def delong(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(auc, variance) from the placements of positives among negatives and the reverse, by counts of distinct scores."""
    s = thresholds(df, truth, score)
    total = F.broadcast(s.agg(F.sum("pos").alias("m"), F.sum("neg").alias("n")))
    d = s.crossJoin(total).select("pos", "neg", "m", "n", ratio(F.col("n") - F.col("cum_neg") + F.col("neg") / 2, F.col("n"), None).alias("v10"), ratio(F.col("cum_pos") - F.col("pos") / 2, F.col("m"), None).alias("v01"))
    mean = d.agg(F.first("m").alias("m"), F.first("n").alias("n"), ratio(F.sum(F.col("pos") * F.col("v10")), F.first("m"), None).alias("auc"), F.sum(F.col("pos") * F.col("v10") * F.col("v10")).alias("q1"), F.sum(F.col("neg") * F.col("v01") * F.col("v01")).alias("q0"))
    return mean.select("auc", F.expr("(q1 - m * auc * auc) / nullif(m - 1, 0) / m + (q0 - n * auc * auc) / nullif(n - 1, 0) / n").alias("variance"))


def bootstrap_accuracy(df: DataFrame, truth: str, pred: str, *, replicates: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(estimate, low, high) of accuracy by the percentile bootstrap. Sums of Poisson(1) weights of n rows are Poisson(n), so rows
    are counted, right and wrong, in one pass, and each replicate draws its two totals from these counts. Rows with a null
    take no part; without rows all three are null."""
    if replicates < 100:
        raise ValueError("at least 100 replicates are needed")

    def bounds(hit, n):  # noqa: ANN001, ANN202
        if not n:
            return None, None, None
        rng = np.random.default_rng(seed)
        ups, downs = rng.poisson(hit, replicates), rng.poisson(n - hit, replicates)
        values = (ups / np.maximum(ups + downs, 1))[ups + downs > 0]
        a = (1 - level) / 2
        return hit / n, float(np.quantile(values, a)), float(np.quantile(values, 1 - a))

    hit = F.col(truth) == F.col(pred)
    counts = df.agg(F.count_if(hit).alias("hit"), F.count(hit).alias("n"))
    return counts.select(F.udf(bounds, "estimate double, low double, high double")("hit", "n").alias("r")).select("r.*")  # one row
