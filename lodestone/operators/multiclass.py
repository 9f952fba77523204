"""Scores of several classes: areas one against the rest and one against one, log loss and Brier score.

Scores are counted by (class, score) before they are shuffled; running totals go by ranges of (class, score), so a class that
most rows have is as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.patterns import dealt, ratio, running_by

#: The least probability that log loss counts, of 64-bit floats.
EPSILON = 2.220446049250313e-16


def _areas(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, roc_auc, average_precision, support) of rows (keys, score, y, w)."""
    counted = long.groupBy(*keys, "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    order = [F.desc("score")]
    steps = running_by(dealt(counted, [*keys, *order]), order, {"pos": F.col("pos"), "neg": F.col("neg")}, keys)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")))
    return steps.groupBy(*keys).agg(ratio(area, F.sum("pos") * F.sum("neg"), None).alias("roc_auc"), ratio(ap, F.sum("pos"), None).alias("average_precision"), F.sum("pos").alias("support"))


def _known(df: DataFrame, truth: str, probs: Mapping[object, str], weight: str | None) -> DataFrame:
    """(t, w, p0, p1, ...) of rows whose truth is one of the classes and whose scores are all there."""
    if len(probs) < 2:
        raise ValueError("at least two classes are needed")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(truth).alias("t"), w.alias("w"), *(F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(probs.values())))
    return rows.filter(F.col("t").isin(list(probs))).dropna()


def class_areas(df: DataFrame, truth: str, probs: Mapping[object, str], *, weight: str | None = None) -> DataFrame:
    """(label, roc_auc, average_precision, support) of each class against all others. ``probs``: {label: column of its score}. Null where
    a class, or all others, have no row."""
    rows = _known(df, truth, probs, weight)
    each = F.inline(F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"p{i}").alias("score"), (F.col("t") == F.lit(v)).cast("double").alias("y"), "w") for i, v in enumerate(probs))))
    return _areas(rows.select(each), ["label"])


def one_vs_one_areas(df: DataFrame, truth: str, probs: Mapping[object, str], *, weight: str | None = None) -> DataFrame:
    """(label, other, roc_auc): for each ordered pair of classes the area of the first one's score over the rows of both. A row is
    counted in the pairs of its own class only."""
    rows = _known(df, truth, probs, weight)
    names = list(probs)
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if i != j]
    own = lambda i: F.col("t") == F.lit(names[i])
    each = F.inline(F.filter(F.array(*(F.when(own(i) | own(j), F.struct(F.lit(names[i]).alias("label"), F.lit(names[j]).alias("other"), F.col(f"p{i}").alias("score"), own(i).cast("double").alias("y"), "w")) for i, j in pairs)), lambda x: x.isNotNull()))
    return _areas(rows.select(each), ["label", "other"]).select("label", "other", "roc_auc")


def multiclass_scores(df: DataFrame, truth: str, probs: Mapping[object, str], *, weight: str | None = None) -> DataFrame:
    """One row (roc_auc_macro, roc_auc_weighted, roc_auc_one_vs_one, average_precision_macro, average_precision_weighted,
    average_precision_micro, log_loss, brier_score). Weighted means go by the weight of the classes; the Brier score sums over classes."""
    areas = class_areas(df, truth, probs, weight=weight)
    by_weight = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum(F.when(F.col(c).isNotNull(), F.col("support"))), None)
    whole = areas.agg(F.avg("roc_auc").alias("roc_auc_macro"), by_weight("roc_auc").alias("roc_auc_weighted"), F.avg("average_precision").alias("average_precision_macro"), by_weight("average_precision").alias("average_precision_weighted"))
    pairs = one_vs_one_areas(df, truth, probs, weight=weight).agg(F.avg("roc_auc").alias("roc_auc_one_vs_one"))
    rows = _known(df, truth, probs, weight)
    is_own = lambda v: F.col("t") == F.lit(v)
    pooled = rows.select(F.inline(F.array(*(F.struct(F.lit(0).alias("one"), F.col(f"p{i}").alias("score"), is_own(v).cast("double").alias("y"), "w") for i, v in enumerate(probs)))))
    micro = _areas(pooled, ["one"]).agg(F.max("average_precision").alias("average_precision_micro"))
    square: Column = F.lit(0.0)
    own: Column = F.lit(0.0)
    for i, v in enumerate(probs):
        p = F.least(F.greatest(F.col(f"p{i}"), F.lit(EPSILON)), F.lit(1 - EPSILON))
        own = own + F.when(is_own(v), p).otherwise(0.0)
        square = square + F.pow(F.col(f"p{i}") - is_own(v).cast("double"), 2.0)
    losses = rows.agg(ratio(F.sum(F.col("w") * -F.log(own)), F.sum("w"), None).alias("log_loss"), ratio(F.sum(F.col("w") * square), F.sum("w"), None).alias("brier_score"))
    one = whole.crossJoin(pairs).crossJoin(micro).crossJoin(losses)  # a row each
    return one.select("roc_auc_macro", "roc_auc_weighted", "roc_auc_one_vs_one", "average_precision_macro", "average_precision_weighted", "average_precision_micro", "log_loss", "brier_score")
