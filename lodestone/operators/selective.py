"""Selective prediction: what a confidence is worth for abstaining. Rows are ranked by falling confidence, ties by an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.classification import risk_coverage
from lodestone.plans.patterns import ranks, ratio, running


def ranked_errors(df: DataFrame, correct: str, confidence: str, row_id: str) -> DataFrame:
    """(confidence, err, k, errors): place of each row and errors up to it. Rows with a null take no part."""
    known = df.select(F.col(confidence).cast("double").alias("confidence"), (1 - F.col(correct).cast("double")).alias("err"), F.col(row_id).alias("id")).filter("confidence is not null and err is not null")
    placed = running(known.select("confidence", "err", F.lit(1).cast("long").alias("one"), F.struct((-F.col("confidence")).alias("c"), "id").alias("place")), "place", ("err", "one"), descending=False)
    return placed.select("confidence", "err", F.col("cum_one").alias("k"), F.col("cum_err").alias("errors"))


def aurc(df: DataFrame, correct: str, confidence: str, row_id: str) -> DataFrame:
    """(aurc, e_aurc, optimal_aurc): mean selective risk over all coverages, and its excess over a perfect ranking."""
    r = ranked_errors(df, correct, confidence, row_id)
    total = r.agg(F.count("*").alias("n"), F.sum("err").alias("wrong"))
    s = r.crossJoin(F.broadcast(total)).agg(F.avg(F.col("errors") / F.col("k")).alias("aurc"), F.avg(F.greatest(F.lit(0.0), F.col("k") - (F.col("n") - F.col("wrong"))) / F.col("k")).alias("optimal_aurc"))
    return s.select("aurc", (F.col("aurc") - F.col("optimal_aurc")).alias("e_aurc"), "optimal_aurc")


def selective_risk(df: DataFrame, correct: str, confidence: str, row_id: str, *, coverage: float = 0.8) -> DataFrame:
    """(risk, coverage, threshold, full_coverage_risk) when the ceil(coverage n) most confident rows are answered."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    r = ranked_errors(df, correct, confidence, row_id)
    total = r.agg(F.count("*").alias("n"), F.avg("err").alias("all"))
    taken = r.crossJoin(F.broadcast(total)).filter(F.col("k") <= F.ceil(F.lit(coverage) * F.col("n")))
    return taken.agg(F.avg("err").alias("risk"), ratio(F.count("*").cast("double"), F.first("n"), None).alias("coverage"), F.min("confidence").alias("threshold"), F.first("all").alias("full_coverage_risk"))


def adaptive_calibration_error(df: DataFrame, correct: str, confidence: str, row_id: str, *, bins: int = 15) -> DataFrame:
    """Unweighted mean gap of accuracy and confidence over ``bins`` groups of equal count in order of rising confidence; the first
    groups take the remainder. Fewer rows than bins make a group each."""
    known = df.select(F.col(confidence).cast("double").alias("p"), F.col(correct).cast("double").alias("c"), F.col(row_id).alias("id")).filter("p is not null and c is not null")
    placed = running(known.select("p", "c", F.lit(1).cast("long").alias("one"), F.struct("p", "id").alias("place")), "place", ("one",), descending=False)
    total = placed.agg(F.count("*").alias("n")).select("n", F.least(F.lit(bins).cast("long"), "n").alias("r")).select("n", "r", F.expr("n div nullif(r, 0)").alias("size"), F.expr("n % nullif(r, 0)").alias("more"))
    at = F.expr("case when cum_one - 1 < more * (size + 1) then (cum_one - 1) div (size + 1) else more + (cum_one - 1 - more * (size + 1)) div size end")
    gaps = placed.crossJoin(F.broadcast(total)).groupBy(at.alias("bin")).agg(F.abs(F.avg("c") - F.avg("p")).alias("gap"))
    return gaps.agg(F.avg("gap").alias("adaptive_calibration_error"))


def risk_at_coverage(df: DataFrame, correct: str, confidence: str, *, coverage: float = 0.8) -> DataFrame:
    """(risk, coverage, threshold) at the first point of the curve, where ties go together, that reaches ``coverage``."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    reached = risk_coverage(df, correct, confidence).filter(F.col("coverage") >= coverage - 1e-12)
    return reached.agg(F.min_by(F.struct("risk", "coverage", "confidence"), "coverage").alias("p")).select("p.risk", "p.coverage", F.col("p.confidence").alias("threshold"))


def coverage_at_risk(df: DataFrame, correct: str, confidence: str, *, risk: float = 0.05) -> DataFrame:
    """(coverage, risk, threshold) of the last point of the curve with at most that risk; coverage 0 if there is none."""
    if not 0 <= risk < 1:
        raise ValueError("risk must be in [0, 1)")
    good = risk_coverage(df, correct, confidence).filter(F.col("risk") <= risk + 1e-12)
    return good.agg(F.max_by(F.struct("risk", "coverage", "confidence"), "coverage").alias("p")).select(F.coalesce("p.coverage", F.lit(0.0)).alias("coverage"), "p.risk", F.col("p.confidence").alias("threshold"))


def confidence_correlation(df: DataFrame, correct: str, confidence: str) -> DataFrame:
    """(auroc, point_biserial, spearman, accuracy, mean_confidence); null where all answers are right or all wrong, correlations
    also where all confidences are equal. Ranks are those of counted values."""
    known = df.select(F.col(confidence).cast("double").alias("p"), F.col(correct).cast("double").alias("c")).filter("p is not null and c is not null")
    r = ranks(known, "p", "c")
    n, n1, n0 = F.sum("n_group"), F.sum(F.col("n_group") * F.col("c")), F.sum(F.col("n_group") * (1 - F.col("c")))
    moments = {k: F.sum(F.col("n_group") * v) for k, v in (("x", F.col("value")), ("xx", F.col("value") * F.col("value")), ("xc", F.col("value") * F.col("c")), ("r", F.col("rank")), ("rr", F.col("rank") * F.col("rank")), ("rc", F.col("rank") * F.col("c")))}
    s = r.agg(n.cast("double").alias("n"), n1.alias("n1"), n0.alias("n0"), *(v.alias(k) for k, v in moments.items()))
    spread = lambda a, aa: f"(n * {aa} - {a} * {a})"
    tied = lambda a, aa, ac: ratio(F.expr(f"n * {ac} - {a} * n1"), F.sqrt(F.expr(f"greatest({spread(a, aa)}, 0) * n1 * n0")), None)
    return s.select(ratio(F.expr("rc - n1 * (n1 + 1) / 2"), F.expr("n1 * n0"), None).alias("auroc"), tied("x", "xx", "xc").alias("point_biserial"), tied("r", "rr", "rc").alias("spearman"), ratio(F.col("n1"), F.col("n"), None).alias("accuracy"), ratio(F.col("x"), F.col("n"), None).alias("mean_confidence"))
