"""Label and score metrics: everything follows from the confusion cube or from the steps of a threshold curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.special import chi2_sf
from lodestone.plans.durable import written
from lodestone.plans.patterns import binned, cube, one_vs_rest, ratio, reached, thresholds, wilson


def class_scores(df: DataFrame, truth: str, pred: str, *, weight: str | None = None, beta: float = 2.0, by: Sequence[str] = (), zero: float | None = 0.0) -> DataFrame:
    """(by, label, tp, fp, fn, tn, support, precision, recall, specificity, npv, f1, fbeta, jaccard) of each label.

    Labels are all that occur as truth or prediction. F-scores come from counts, not from rounded precision and recall.
    ``zero`` stands where a denominator is 0 (None: null).
    """
    c = one_vs_rest(cube(df, truth, pred, weight, by), by)
    tp, fp, fn, tn, b = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), beta * beta
    return c.select(
        *by, "label", "tp", "fp", "fn", "tn", (tp + fn).alias("support"),
        ratio(tp, tp + fp, zero).alias("precision"), ratio(tp, tp + fn, zero).alias("recall"),
        ratio(tn, tn + fp, zero).alias("specificity"), ratio(tn, tn + fn, zero).alias("npv"),
        ratio(2 * tp, 2 * tp + fp + fn, zero).alias("f1"), ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp, zero).alias("fbeta"),
        ratio(tp, tp + fp + fn, zero).alias("jaccard"),
    )


SCORES = ("precision", "recall", "specificity", "npv", "f1", "fbeta", "jaccard")


def averaged_scores(df: DataFrame, truth: str, pred: str, *, weight: str | None = None, beta: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, average, <scores>): macro (every label counts), weighted (by true support) and micro (from summed counts)."""
    c = class_scores(df, truth, pred, weight=weight, beta=beta, by=by)
    macro = c.groupBy(*by).agg(*(F.avg(s).alias(s) for s in SCORES)).withColumn("average", F.lit("macro"))
    weighted = c.groupBy(*by).agg(*((F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in SCORES)).withColumn("average", F.lit("weighted"))
    tp, fp, fn, tn, b = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("tn"), beta * beta
    micro = c.groupBy(*by).agg(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tn, tn + fn).alias("npv"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp).alias("fbeta"), ratio(tp, tp + fp + fn).alias("jaccard"),
    ).withColumn("average", F.lit("micro"))
    return macro.unionByName(weighted).unionByName(micro)


def agreement_scores(df: DataFrame, truth: str, pred: str, labels: Sequence[object], *, weight: str | None = None) -> DataFrame:
    """(mcc, balanced_accuracy, cohen_kappa, kappa_linear, kappa_quadratic); ``labels`` fixes the order for weighted kappa."""
    cells = cube(df, truth, pred, weight)
    place = F.create_map(*(x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))))
    placed = cells.select(place[F.col("t")].alias("i"), place[F.col("p")].alias("j"), "w")
    rows, cols = placed.groupBy("i").agg(F.sum("w").alias("r")), placed.groupBy("j").agg(F.sum("w").alias("c"))
    grid = rows.crossJoin(cols).join(placed, ["i", "j"], "left").na.fill(0.0, ["w"])  # k * k cells
    n = F.sum("w")
    far = lambda power: F.pow(F.abs(F.col("i") - F.col("j")).cast("double"), power)
    unlike = (F.col("i") != F.col("j")).cast("double")
    kappa = lambda d: 1 - ratio(F.sum(d * F.col("w")) * n, F.sum(d * F.col("r") * F.col("c")), None)
    k = grid.agg(n.alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0)).alias("hit"), F.sum(F.when(F.col("i") == F.col("j"), F.col("r") * F.col("c")).otherwise(0.0)).alias("rc"), kappa(unlike).alias("cohen_kappa"), kappa(far(1.0)).alias("kappa_linear"), kappa(far(2.0)).alias("kappa_quadratic"))
    r2, c2 = rows.agg(F.sum(F.col("r") * F.col("r")).alias("r2")), cols.agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    hits = placed.groupBy("i").agg(F.sum("w").alias("r"), F.sum(F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0)).alias("h")).filter("r > 0").agg(F.avg(F.col("h") / F.col("r")).alias("balanced_accuracy"))
    every = k.crossJoin(r2).crossJoin(c2).crossJoin(hits)  # one row each
    mcc = ratio(F.col("hit") * F.col("n") - F.col("rc"), F.sqrt((F.col("n") * F.col("n") - F.col("r2")) * (F.col("n") * F.col("n") - F.col("c2"))))
    return every.select(mcc.alias("mcc"), "balanced_accuracy", "cohen_kappa", "kappa_linear", "kappa_quadratic")


def confusion_matrix(df: DataFrame, truth: str, pred: str, *, weight: str | None = None, normalize: str | None = None) -> DataFrame:
    """(t, p, w) for every pair of labels, 0 where it does not occur; ``normalize``: true, pred or all."""
    cells = cube(df, truth, pred, weight)
    labels = cells.select(F.col("t").alias("label")).union(cells.select("p")).distinct()
    dense = labels.select(F.col("label").alias("t")).crossJoin(labels.select(F.col("label").alias("p"))).join(cells, ["t", "p"], "left").na.fill(0.0, ["w"])
    if normalize is None:
        return dense
    scope = {"true": Window.partitionBy("t"), "pred": Window.partitionBy("p"), "all": Window.partitionBy(F.lit(1))}[normalize]
    return dense.withColumn("w", ratio(F.col("w"), F.sum("w").over(scope)))


def roc_curve(df: DataFrame, truth: str, score: str, *, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, fpr, tpr), one point for each distinct score from the highest; the start (0, 0) is implied."""
    steps = thresholds(df, truth, score, weight, by)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = steps.join(totals, list(by)) if by else steps.crossJoin(F.broadcast(totals))
    return joined.select(*by, "score", ratio(F.col("cum_neg"), F.col("all_neg"), None).alias("fpr"), ratio(F.col("cum_pos"), F.col("all_pos"), None).alias("tpr"))


def pr_curve(df: DataFrame, truth: str, score: str, *, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, precision, recall), one point for each distinct score."""
    steps = thresholds(df, truth, score, weight, by)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    joined = steps.join(totals, list(by)) if by else steps.crossJoin(F.broadcast(totals))
    return joined.select(*by, "score", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"), ratio(F.col("cum_pos"), F.col("all_pos"), None).alias("recall"))


def curve_areas(df: DataFrame, truth: str, score: str, *, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, roc_auc, average_precision). A step of distinct score adds neg * (positives above + half of its own) to the ROC
    area and pos * precision to the step-wise PR area, so no neighbouring row is needed."""
    s = thresholds(df, truth, score, weight, by)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return s.groupBy(*by).agg(ratio(area, F.sum("pos") * F.sum("neg"), None).alias("roc_auc"), ratio(ap, F.sum("pos"), None).alias("average_precision"))


def top_k_accuracy(df: DataFrame, truth_index: str, probs: str, *, k: int = 2) -> DataFrame:
    """Share of rows where fewer than k classes are more probable than the true one (0-based ``truth_index``)."""
    own = F.element_at(probs, F.col(truth_index) + 1)
    return df.agg(F.avg((F.size(F.filter(F.col(probs), lambda x: x > own)) < k).cast("double")).alias("top_k_accuracy"))


def calibration_curve(df: DataFrame, truth: str, score: str, *, bins: int = 10, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, observed, predicted, w) of the bins that have rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return binned(df, score, bins).groupBy(*by, "bin").agg((F.sum(w * F.col(truth)) / F.sum(w)).alias("observed"), (F.sum(w * F.col(score)) / F.sum(w)).alias("predicted"), F.sum(w).alias("w"))


def calibration_errors(df: DataFrame, truth: str, score: str, *, bins: int = 10, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, expected_calibration_error, maximum_calibration_error)."""
    c = calibration_curve(df, truth, score, bins=bins, weight=weight, by=by).withColumn("gap", F.abs(F.col("observed") - F.col("predicted")))
    return c.groupBy(*by).agg((F.sum(F.col("w") * F.col("gap")) / F.sum("w")).alias("expected_calibration_error"), F.max("gap").alias("maximum_calibration_error"))


def calibration_line(df: DataFrame, truth: str, score: str, *, offset: bool = False, tolerance: float = 1e-12, rounds: int = 100) -> tuple[float, float]:
    """(intercept, slope) of logit P(y) = a + b logit(score) by Newton steps, each one aggregate of five sums over the written
    counts of distinct scores; ``offset``: b is held at 1."""
    x = F.least(F.greatest(F.col(score).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    counted = df.select(F.col(truth).cast("double").alias("y"), F.log(x / (1 - x)).alias("x")).groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    data = written(counted, "scores")
    a, b = 0.0, 1.0 if offset else 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        v = F.col("n") * p * (1 - p)
        g0, g1, h00, h01, h11 = data.agg(F.sum(F.col("y") - F.col("n") * p), F.sum((F.col("y") - F.col("n") * p) * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x"))).first()
        if offset:
            da, db = g0 / h00, 0.0
        else:
            det = h00 * h11 - h01 * h01
            if det == 0:
                raise ValueError("the fit is singular")
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tolerance:
            return a, b
    raise ValueError("the fit does not converge")


def hosmer_lemeshow(df: DataFrame, truth: str, score: str, row_id: str, *, groups: int = 10) -> DataFrame:
    """(statistic, df): groups of equal size in order of score (ties by ``row_id``); the first ones take the remainder."""
    known = df.select(F.col(truth).cast("double").alias("y"), F.col(score).cast("double").alias("score"), F.col(row_id).alias("id")).filter("y is not null and score is not null")
    placed = written(known.repartitionByRange("score", "id").withColumn("__part", F.spark_partition_id()), "ranges")  # ranges are sampled, so they are dealt once
    counts = placed.groupBy("__part").count()
    n = placed.count()
    size, more = divmod(n, groups)
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__part").orderBy("score", "id")
    rank = F.row_number().over(inner) - 1
    ranked = placed.withColumn("__r", rank).join(F.broadcast(before), "__part").withColumn("r", F.col("__r") + F.col("__before"))
    cut = more * (size + 1)
    group = F.when(F.col("r") < cut, F.floor(F.col("r") / (size + 1))).otherwise(more + F.floor((F.col("r") - cut) / max(size, 1)))
    g = ranked.groupBy(group.alias("g")).agg(F.sum("y").alias("o"), F.sum("score").alias("e"), F.count("*").alias("m"))
    term = ratio(F.pow(F.col("o") - F.col("e"), 2), F.col("e") * (1 - F.col("e") / F.col("m")), None)
    return g.agg(F.sum(term).alias("statistic"), (F.count("*") - 2).alias("df"))


def decision_curve(df: DataFrame, truth: str, score: str, cuts: Sequence[float] = tuple(k / 100 for k in range(1, 100))) -> DataFrame:
    """(threshold, net_benefit, treat_all): scores are counted by the number of thresholds they reach, then summed from above,
    so a row is read once whatever the number of thresholds."""
    cuts = sorted(map(float, cuts))
    level = df.groupBy(reached(F.col(score), cuts).alias("level")).agg(F.sum(F.col(truth)).cast("double").alias("pos"), F.sum(1 - F.col(truth)).cast("double").alias("neg"))
    grid = df.sparkSession.createDataFrame([(i, cuts[i - 1] if i else None) for i in range(len(cuts) + 1)], "level int, threshold double")
    above, every = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reach = grid.join(level, "level", "left").select("level", "threshold", *(f.alias(n) for c, t in (("pos", "tp"), ("neg", "fp")) for n, f in ((t, F.sum(zero(c)).over(above)), (f"all_{c}", F.sum(zero(c)).over(every))))).filter("level > 0")  # a row a threshold
    odds, n = F.col("threshold") / (1 - F.col("threshold")), F.col("all_pos") + F.col("all_neg")
    return reach.select("threshold", ratio(F.col("tp") - F.col("fp") * odds, n, None).alias("net_benefit"), ratio(F.col("all_pos") - F.col("all_neg") * odds, n, None).alias("treat_all"))


def risk_coverage(df: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(confidence, coverage, risk) at the end of each block of equal confidence, from the most confident."""
    s = thresholds(df, correct, confidence)
    total = s.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    done = F.col("cum_pos") + F.col("cum_neg")
    return s.crossJoin(F.broadcast(total)).select(F.col("score").alias("confidence"), (done / F.col("n")).alias("coverage"), (F.col("cum_neg") / done).alias("risk"))


def diagnostic_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(metric, value, low, high) of a binary test: shares with Wilson intervals, ratios with those of their logarithm; null where
    undefined. One pass."""
    is_ = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    c = df.agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    shares = {"sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp), "ppv": (tp, tp + fp), "npv": (tn, tn + fn), "accuracy": (tp + tn, tp + fp + fn + tn), "prevalence": (tp + fn, tp + fp + fn + tn)}
    none = F.lit(None).cast("double")
    row = lambda name, value, low, high, spread: F.struct(F.lit(name).alias("metric"), value.alias("value"), low.alias("low"), high.alias("high"), spread.alias("spread"))
    rows = [row(name, ratio(k, n, None), *(F.when(n > 0, F.least(F.greatest(b, F.lit(0.0)), F.lit(1.0))) for b in wilson(k, F.when(n > 0, n))), none) for name, (k, n) in shares.items()]
    # the variance of a ratio's logarithm is a sum of reciprocals; there is none where a cell is 0
    of_ratio = lambda name, value, variance: row(name, value, none, none, F.expr(variance))
    rows += [
        of_ratio("lr_positive", ratio(tp * (fp + tn), fp * (tp + fn), None), "case when tp * fp > 0 then sqrt(greatest(0, 1D / tp - 1D / (tp + fn) + 1D / fp - 1D / (fp + tn))) end"),
        of_ratio("lr_negative", ratio(fn * (fp + tn), tn * (tp + fn), None), "case when fn * tn > 0 then sqrt(greatest(0, 1D / fn - 1D / (tp + fn) + 1D / tn - 1D / (fp + tn))) end"),
        of_ratio("diagnostic_odds_ratio", ratio(tp * tn, fp * fn, None), "case when tp > 0 and fp > 0 and fn > 0 and tn > 0 then sqrt(1D / tp + 1D / fp + 1D / fn + 1D / tn) end"),
        row("youden_j", ratio(tp, tp + fn, None) + ratio(tn, tn + fp, None) - 1, none, none, none),
    ]
    z = 1.959963984540054
    bound = lambda c, sign: F.coalesce(c, F.when(F.col("value") > 0, F.col("value") * F.exp(sign * z * F.col("spread")))).alias(c)
    return c.select(F.array(*rows).alias("rows")).select(F.inline("rows")).select("metric", "value", bound("low", -1), bound("high", 1))


def calibration_report(df: DataFrame, truth: str, score: str, row_id: str, *, bins: int = 10, fit: bool = False) -> DataFrame:
    """(expected_calibration_error, maximum_calibration_error, brier_score, mean_score, prevalence, hosmer_lemeshow, df) as one row; with
    ``fit`` also (slope, intercept, intercept_at_slope_one, hosmer_lemeshow_p) of the fitted logistic line and the test."""
    y, p = F.col(truth).cast("double"), F.col(score).cast("double")
    plain = df.agg(F.avg((p - y) * (p - y)).alias("brier_score"), F.avg(p).alias("mean_score"), F.avg(y).alias("prevalence"))
    told = calibration_errors(df, truth, score, bins=bins).crossJoin(plain).crossJoin(hosmer_lemeshow(df, truth, score, row_id).withColumnRenamed("statistic", "hosmer_lemeshow"))
    if not fit:
        return told
    intercept, slope = calibration_line(df, truth, score)
    tail = F.udf(lambda x, k: None if x is None or k is None or k <= 0 else chi2_sf(x, k), "double")  # one row
    numbers = {"slope": slope, "intercept": intercept, "intercept_at_slope_one": calibration_line(df, truth, score, offset=True)[0]}
    return told.withColumns({n: F.lit(v) for n, v in numbers.items()} | {"hosmer_lemeshow_p": tail("hosmer_lemeshow", "df")})
