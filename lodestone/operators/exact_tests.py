"""Exact and order-based tests, intervals of proportions, accelerated bootstrap, and the comparison of models.

Clusters give counts, rank sums and placements; only tables whose size a parameter bounds reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import special
from lodestone.operators.statistics import adjust_pvalues, mann_whitney, mcnemar_p
from lodestone.plans.patterns import ranks, ratio, running, thresholds, wilson

# The published polynomials of the approximation to the Shapiro-Wilk weights and to the distribution of W,
# lowest power first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_SHIFT = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(c: Sequence[float], x: float) -> float:
    return sum(v * x**k for k, v in enumerate(c))


def shapiro_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row (n, mx, mm, ss, x1, x2, y2, y1): count, sums of normal scores times order statistics and of squared scores, sum of
    squared deviations, the two least and the two greatest values. Nulls take no part; equal values share one row of the
    ranking, whose scores are summed where it stands."""
    known = df.select(F.col(value).cast("double").alias("value")).filter("value is not null")
    counted = known.groupBy("value").agg(F.count("*").alias("n"))
    total = F.broadcast(known.agg(F.count("*").alias("all"), F.avg("value").alias("mean")))
    placed = running(counted, "value", ("n",), descending=False).crossJoin(total)

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantile = NormalDist().inv_cdf
        for f in frames:
            first, second = np.zeros(len(f)), np.zeros(len(f))
            for k, (last, n, every) in enumerate(zip(f["cum_n"], f["n"], f["all"], strict=True)):
                for rank in range(last - n + 1, last + 1):
                    m = quantile((rank - 0.375) / (every + 0.25))
                    first[k] += m
                    second[k] += m * m
            yield f.assign(m1=first, m2=second)[["value", "n", "cum_n", "all", "mean", "m1", "m2"]]

    scored = placed.select("value", "n", "cum_n", "all", "mean").mapInPandas(scores, "value double, n long, cum_n long, all long, mean double, m1 double, m2 double")
    at = lambda rank: F.max(F.when((F.col("cum_n") >= rank) & (F.col("cum_n") - F.col("n") < rank), F.col("value")))
    return scored.agg(
        F.first("all").alias("n"), F.sum(F.col("m1") * F.col("value")).alias("mx"), F.sum("m2").alias("mm"),
        F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2.0)).alias("ss"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(F.col("all") - 1).alias("y2"), at(F.col("all")).alias("y1"),
    )


def shapiro_wilk(df: DataFrame, value: str) -> dict[str, float]:
    """statistic W and p_value; at least three values that are not all equal. Beyond 5,000 values p is a rough guide only."""
    s = shapiro_statistics(df, value).first()
    n = s["n"] or 0
    if n < 3 or not s["ss"]:
        raise ValueError("at least three values, not all equal, are needed")
    top, scale = NormalDist().inv_cdf((n - 0.375) / (n + 0.25)), math.sqrt(s["mm"])
    ends = s["y1"] - s["x1"]
    if n == 3:
        weighted = math.sqrt(0.5) * ends
    else:
        last = _poly(LAST_WEIGHT, 1 / math.sqrt(n)) + top / scale
        if n <= 5:
            rest = math.sqrt((s["mm"] - 2 * top**2) / (1 - 2 * last**2))
            weighted = last * ends + (s["mx"] - top * ends) / rest
        else:
            second = NormalDist().inv_cdf((n - 1.375) / (n + 0.25))
            following = _poly(NEXT_WEIGHT, 1 / math.sqrt(n)) + second / scale
            rest = math.sqrt((s["mm"] - 2 * top**2 - 2 * second**2) / (1 - 2 * last**2 - 2 * following**2))
            inner = s["y2"] - s["x2"]
            weighted = last * ends + following * inner + (s["mx"] - top * ends - second * inner) / rest
    w = min(1.0, weighted**2 / s["ss"])
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif w == 1.0:
        p = 1.0
    else:
        y = math.log1p(-w)
        if n <= 11:
            shift = _poly(SMALL_SHIFT, n)
            if y >= shift:
                return {"statistic": w, "p_value": 1e-99, "n": n}
            z = (-math.log(shift - y) - _poly(SMALL_MEAN, n)) / math.exp(_poly(SMALL_LOG_SD, n))
        else:
            z = (y - _poly(LARGE_MEAN, math.log(n))) / math.exp(_poly(LARGE_LOG_SD, math.log(n)))
        p = 1 - special.normal_cdf(z) if z < 0 else special.normal_cdf(-z)
    return {"statistic": w, "p_value": p, "n": n}


def two_by_two(df: DataFrame, row: str, column: str) -> DataFrame:
    """(a, b, c, d, odds_ratio): counts of two 0/1 columns, (1, 1), (1, 0), (0, 1), (0, 0); the ratio is null when b or c is 0."""
    is_ = lambda r, c: F.count_if((F.col(row) == r) & (F.col(column) == c))
    s = df.agg(is_(1, 1).alias("a"), is_(1, 0).alias("b"), is_(0, 1).alias("c"), is_(0, 0).alias("d"))
    return s.withColumn("odds_ratio", F.expr("case when b * c > 0 then cast(a as double) * d / (cast(b as double) * c) end"))


def fisher_exact_p(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """Exact p of a 2 by 2 table with its margins held: "two-sided" sums the tables no likelier than the one seen."""
    n, first, column = a + b + c + d, a + b, a + c
    if 0 in (first, c + d, column, b + d):
        return 1.0
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    x = np.arange(max(0, first + column - n), min(first, column) + 1)
    mass = np.exp([choose(column, k) + choose(n - column, first - k) - choose(n, first) for k in x.tolist()])
    seen = mass[x == a][0]
    chosen = {"two-sided": mass <= seen * (1 + 1e-7), "greater": x >= a, "less": x <= a}[alternative]
    return float(min(1.0, mass[chosen].sum()))


def _rank_sum_counts(n: int, m: int) -> np.ndarray:
    """For each U from 0 to n * m, the chance of it among all orders of n and m different values: the product of
    (1 - q^(m + i)) / (1 - q^i), factor by factor."""
    size = n * m + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, n + 1):
        if m + i < size:
            ways[m + i :] -= ways[: size - m - i].copy()
        for k in range(i, size):
            ways[k] += ways[k - i]
    return ways / ways.sum()


def mann_whitney_test(df: DataFrame, value: str, group: str, a: object, b: object) -> dict[str, float]:
    """u of group a, two-sided p_value, auc and rank_biserial. p is exact when a group has 8 values at most and no two values
    are equal, else normal with ties and continuity."""
    known = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    seen = known.agg(F.count_if(F.col(group) == a).alias("n"), F.count_if(F.col(group) == b).alias("m"), F.countDistinct(value).alias("k")).first()
    n, m = seen["n"], seen["m"]
    if not n or not m:
        raise ValueError("both groups need a value")
    s = mann_whitney(known, value, group, a, b).first()
    if min(n, m) <= 8 and seen["k"] == n + m:
        # The product needs the smaller group only; chances are alike from both ends.
        p = 2 * float(_rank_sum_counts(min(n, m), max(n, m))[: int(min(s["u"], n * m - s["u"])) + 1].sum())
    elif seen["k"] == 1:
        p = 1.0
    else:
        sd = abs((s["u"] - n * m / 2) / s["z"]) if s["z"] else math.inf
        p = 2 * special.normal_cdf(-max(0.0, abs(s["u"] - n * m / 2) - 0.5) / sd)
    return {"statistic": s["u"], "p_value": min(1.0, p), "auc": s["auc"], "rank_biserial": s["cliffs_delta"]}


def _signed_rank_chances(n: int) -> np.ndarray:
    """The chance of each sum of the ranks with a positive sign, of n differences."""
    ways = np.ones(1)
    for i in range(1, n + 1):
        ways = (np.pad(ways, (0, i)) + np.pad(ways, (i, 0))) / 2
    return ways


def wilcoxon_test(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Smaller signed-rank sum, two-sided p_value and rank_biserial of paired values; zero differences take no part. p is exact
    for 50 differences at most that are all different in size (if none is zero), else normal with ties."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).filter("d is not null")
    r = ranks(d.filter("d <> 0").select(F.abs("d").alias("m"), F.signum("d").alias("s")), "m", "s")
    # A size with both signs stands in two rows of the ranking: its ties are counted once, by its share of each row.
    s = r.agg(
        F.sum(F.when(F.col("s") > 0, F.col("n_group") * F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("s") < 0, F.col("n_group") * F.col("rank")).otherwise(0.0)).alias("down"),
        F.sum("n_group").alias("n"), F.sum(F.col("n_group") * (F.pow(F.col("n").cast("double"), 2.0) - 1)).alias("ties"),
    ).first()
    n = s["n"] or 0
    if not n:
        raise ValueError("all differences are zero")
    least = min(s["up"], s["down"])
    if n <= 50 and not s["ties"] and d.filter("d = 0").isEmpty():
        p = 2 * float(_signed_rank_chances(n)[: int(least) + 1].sum())
    else:
        p = 2 * special.normal_cdf((least - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - s["ties"] / 48))
    return {"statistic": least, "p_value": min(1.0, p), "rank_biserial": (s["up"] - s["down"]) / (s["up"] + s["down"])}


def proportion_interval(k: int, n: int, *, level: float = 0.95, method: str = "wilson") -> tuple[float, float]:
    """Bounds of the share k / n: "wilson", "clopper-pearson" or "normal" (cut to 0 and 1)."""
    if not 0 <= k <= n or n == 0:
        raise ValueError("0 <= k <= n and n > 0 are needed")
    z, p = special.normal_quantile(0.5 + level / 2), k / n
    if method == "wilson":
        mid, half, den = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
        return max(0.0, (mid - half) / den), min(1.0, (mid + half) / den)
    if method == "normal":
        half = z * math.sqrt(p * (1 - p) / n)
        return max(0.0, p - half), min(1.0, p + half)
    if method != "clopper-pearson":
        raise ValueError(f"unknown method {method}")

    def where(x: float, y: float, share: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if special.beta_regularized(x, y, mid) < share else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    return (0.0 if k == 0 else where(k, n - k + 1, tail)), (1.0 if k == n else where(k + 1, n - k, 1 - tail))


def delong_placements(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, v10, v01): for each distinct score the share of negatives below a positive there, and of positives above a
    negative there; equal scores count half."""
    s = thresholds(df, truth, score)
    total = F.broadcast(s.agg(F.sum("pos").alias("m"), F.sum("neg").alias("k")))
    return s.crossJoin(total).select("score", ((F.col("k") - F.col("cum_neg") + F.col("neg") / 2) / F.col("k")).alias("v10"), ((F.col("cum_pos") - F.col("pos") / 2) / F.col("m")).alias("v01"))


def delong_difference(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(auc_a, auc_b, difference, variance) of two scores of the same rows. Rows are counted by (truth, a, b) before the
    placements of both scores are joined to them. Both classes are needed, two rows of each."""
    known = df.filter(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    counted = known.groupBy(F.col(truth).alias("t"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count("*").cast("double").alias("n"))
    side = lambda c, x: delong_placements(known, truth, c).select(F.col("score").alias(x), F.col("v10").alias(f"{x}10"), F.col("v01").alias(f"{x}01"))
    both = counted.join(side(a, "a"), "a").join(side(b, "b"), "b").select("t", "n", F.when(F.col("t") == 1, F.col("a10")).otherwise(F.col("a01")).alias("va"), F.when(F.col("t") == 1, F.col("b10")).otherwise(F.col("b01")).alias("vb"))
    d = both.withColumn("d", F.col("va") - F.col("vb"))
    of = lambda t, v: F.sum(F.when(F.col("t") == t, v))
    s = d.agg(*(of(t, F.col("n") * v).alias(f"{k}{t}") for t in (0, 1) for k, v in (("n", F.lit(1.0)), ("d", F.col("d")), ("q", F.col("d") * F.col("d")), ("a", F.col("va")), ("b", F.col("vb")))))
    spread = lambda t: f"(q{t} - d{t} * d{t} / nullif(n{t}, 0)) / nullif(n{t} - 1, 0) / nullif(n{t}, 0)"
    return s.select(F.expr("a1 / nullif(n1, 0)").alias("auc_a"), F.expr("b1 / nullif(n1, 0)").alias("auc_b"), F.expr("(a1 - b1) / nullif(n1, 0)").alias("difference"), F.expr(f"{spread(0)} + {spread(1)}").alias("variance"))


def delong_test(df: DataFrame, truth: str, a: str, b: str, *, level: float = 0.95) -> dict[str, float]:
    """auc_a, auc_b, difference, z, two-sided p_value, low, high; no variance gives z 0 and p 1."""
    s = delong_difference(df, truth, a, b).first()
    sd = math.sqrt(max(0.0, s["variance"]))
    z, half = (s["difference"] / sd if sd > 0 else 0.0), special.normal_quantile(0.5 + level / 2) * sd
    return {"auc_a": s["auc_a"], "auc_b": s["auc_b"], "difference": s["difference"], "z": z, "p_value": 2 * special.normal_cdf(-abs(z)), "low": s["difference"] - half, "high": s["difference"] + half}


def accelerated_bounds(replicates: Sequence[float], estimate: float, left_out: Sequence[float], level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated bounds from resampled values and from values without one block each; resamples all on one side
    of the estimate give the plain percentiles."""
    v, tail = np.sort(np.asarray(replicates, dtype=float)), (1 - level) / 2
    share = float(((v < estimate).sum() + (v == estimate).sum() / 2) / len(v))
    levels = (tail, 1 - tail)
    if 0 < share < 1:
        z0 = special.normal_quantile(share)
        u = np.mean(left_out) - np.asarray(left_out, dtype=float)
        spread = float((u**2).sum())
        speed = float((u**3).sum()) / (6 * spread**1.5) if spread > 0 else 0.0
        z = [z0 + special.normal_quantile(p) for p in levels]
        levels = tuple(special.normal_cdf(z0 + x / (1 - speed * x)) for x in z)
    low, high = np.quantile(v, levels)
    return float(low), float(high)


def compare_counts(df: DataFrame, truth: str, models: Mapping[str, str], baseline: str) -> DataFrame:
    """(model, accuracy, difference, b, c): a row for each model with its predicted column; b rows only the baseline has right, c
    rows only the model. One pass over the rows gives all counts; rows with a null in a used column take no part."""
    known = df.dropna(subset=list(dict.fromkeys([truth, *models.values()])))
    right = {m: (F.col(c) == F.col(truth)) for m, c in models.items()}
    aggs = [F.struct(F.lit(m).alias("model"), F.avg(ok.cast("double")).alias("accuracy"), F.count_if(right[baseline] & ~ok).alias("b"), F.count_if(~right[baseline] & ok).alias("c"), F.avg(right[baseline].cast("double")).alias("base")) for m, ok in right.items()]
    return known.agg(F.array(*aggs).alias("each")).select(F.inline("each")).select("model", "accuracy", (F.col("accuracy") - F.col("base")).alias("difference"), "b", "c")


def compare(df: DataFrame, truth: str, models: Mapping[str, str], *, baseline: str, scores: Mapping[str, str] | None = None, correction: str = "holm") -> DataFrame:
    """(metric, model, estimate, difference, p_value, p_adjusted): each model against the baseline, accuracy by McNemar's test
    and, with ``scores``, the ROC area of a 0/1 truth by DeLong's; p adjusted within a metric by ``correction`` (bonferroni,
    holm, hochberg, bh). The baseline's own rows have null p. There are as many rows as models."""
    found: list[tuple] = []
    for r in compare_counts(df, truth, models, baseline).collect():  # a row a model
        found.append(("accuracy", r["model"], r["accuracy"], r["difference"], None if r["model"] == baseline else mcnemar_p(r["b"], r["c"])))
    for model, column in (scores or {}).items():
        if model != baseline:
            t = delong_test(df, truth, column, scores[baseline])
            found.append(("roc_auc", model, t["auc_a"], t["difference"], t["p_value"]))
            if not any(f[:2] == ("roc_auc", baseline) for f in found):
                found.append(("roc_auc", baseline, t["auc_b"], 0.0, None))
    table = df.sparkSession.createDataFrame(found, "metric string, model string, estimate double, difference double, p_value double")
    tested = adjust_pvalues(table.filter("p_value is not null").select("metric", "model", "p_value"), "model", "p_value", ["metric"]).select("metric", "model", F.col(correction).alias("p_adjusted"))
    return table.join(tested, ["metric", "model"], "left")


def bootstrap_accuracy_bca(df: DataFrame, truth: str, pred: str, *, replicates: int = 500, blocks: int = 200, seed: int = 7, level: float = 0.95) -> dict[str, float]:
    """estimate, low, high of accuracy by the accelerated bootstrap: rows are counted by block of a row hash, right and wrong, and
    each replicate draws Poisson weights for these counts, so one pass over the rows suffices and the driver holds
    ``blocks`` rows at most. Sums of Poisson(1) weights of n rows are Poisson(n)."""
    known = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    cells = known.groupBy(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(blocks)).alias("k")).agg(F.count_if(F.col(truth) == F.col(pred)).alias("hit"), F.count("*").alias("n")).orderBy("k").collect()
    hit, n = (np.array([c[k] for c in cells], dtype=np.int64) for k in ("hit", "n"))
    if n.sum() < 2:
        raise ValueError("at least two rows are needed")
    rng = np.random.default_rng(seed)
    ups, downs = rng.poisson(hit.sum(), replicates), rng.poisson((n - hit).sum(), replicates)
    values = (ups / np.maximum(ups + downs, 1))[ups + downs > 0]
    estimate = float(hit.sum() / n.sum())
    rest = n.sum() - n
    left = ((hit.sum() - hit) / np.maximum(rest, 1))[rest > 0]
    low, high = accelerated_bounds(values, estimate, left, level)
    return {"estimate": estimate, "low": low, "high": high}


def accuracy_interval(df: DataFrame, truth: str, pred: str, *, level: float = 0.95) -> DataFrame:
    """(accuracy, low, high, n): Wilson's interval from one aggregate; null without rows. Rows with a null take no part."""
    hit = F.col(truth) == F.col(pred)
    s = df.agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"), special.normal_quantile(0.5 + level / 2))
    return s.select(ratio(F.col("k").cast("double"), F.col("n"), None).alias("accuracy"), F.when(F.col("n") > 0, F.greatest(F.lit(0.0), low)).alias("low"), F.when(F.col("n") > 0, F.least(F.lit(1.0), high)).alias("high"), "n")


def paired_bootstrap(df: DataFrame, truth: str, a: str, b: str, *, replicates: int = 2000, seed: int = 7, level: float = 0.95) -> dict[str, float]:
    """difference, low, high, p_value of the accuracies of predictions a and b on the same rows. Rows are counted by the four
    outcomes (both right, one, none) and each replicate draws Poisson totals of these, so one pass over the rows suffices;
    p is two-sided, the share of replicates on the other side of 0 (half of those at 0), doubled."""
    if replicates < 100:
        raise ValueError("at least 100 replicates are needed")
    x, y = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    s = df.agg(*(F.count_if((x == i) & (y == j)).alias(f"n{int(i)}{int(j)}") for i in (True, False) for j in (True, False))).first()
    n = sum(s)
    if not n:
        raise ValueError("no rows")
    rng = np.random.default_rng(seed)
    draws = rng.poisson(np.array([s["n11"], s["n10"], s["n01"], s["n00"]]), (replicates, 4))
    total = draws.sum(1)
    values = ((draws[:, 1] - draws[:, 2]) / np.maximum(total, 1))[total > 0]
    low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2])
    side = min((values < 0).sum(), (values > 0).sum()) + (values == 0).sum() / 2
    return {"difference": (s["n10"] - s["n01"]) / n, "low": float(low), "high": float(high), "p_value": float(min(1.0, 2 * side / len(values)))}
