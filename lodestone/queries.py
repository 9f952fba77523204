"""Registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import agents, catalog, classification, exact_tests, groups, judges, neighbours, retrieval, safety, selective, statistics, structured, text, vision
from lodestone.plans.patterns import spread
from lodestone.streaming.rates import windowed_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: One observation for each line item, with every column that the metrics take; each query reads the few that it needs.
OBSERVATIONS = """
select b.*, case when h then t else 1 - t end as p, (mod1000 / 1000e0) * 6e-1 + 4e-1 * t as prob,
  case when (l_orderkey * 7 + l_linenumber) % 10 < 7 then l_returnflag when (l_partkey + l_linenumber) % 3 = 0 then 'A' when (l_partkey + l_linenumber) % 3 = 1 then 'N' else 'R' end as label_pred,
  l_extendedprice as y, l_extendedprice * (9e-1 + 2e-2 * ((l_partkey + l_linenumber * 3) % 11)) as yhat, l_discount + 1e-2 as wy,
  cast(l_partkey % 7 = 0 as int) as harmful, cast(l_partkey % 5 = 0 as int) as succeeded, cast(l_partkey % 4 = 0 as int) as best_attempt, cast(l_suppkey % 3 = 0 as int) as refused, cast(l_partkey % 2 = 0 as int) as should_refuse,
  (l_partkey % 101) / 100e0 as max_score, l_tax as stereo, l_discount as anti_stereo, l_linenumber % 3 as n_violations, l_partkey % 50 + 1 as rank_canary, 1000 as space,
  cast(l_partkey % 10 < 8 as int) as clean, cast(l_suppkey % 10 < 6 as int) as noisy, cast(l_partkey % 10 < 7 as int) as correct, cast(l_linenumber = 1 as int) as is_ood, cast(l_partkey % 3 = 0 as int) as failed, cast(l_partkey % 6 = 0 as int) as recovered,
  l_returnflag as original, case when l_partkey % 9 = 0 then 'X' else l_returnflag end as counterfactual, case l_partkey % 3 when 0 then 'contradiction' when 1 then 'neutral' else 'entailment' end as relation,
  case l_partkey % 5 when 0 then 'error' when 1 then 'timeout' else 'ok' end as status, l_discount as score, l_linenumber % 2 as is_target,
  cast(l_suppkey % 4 > 0 as int) as completed, l_linenumber as n_calls, l_partkey % 4 as optimal_calls, l_linenumber + l_partkey % 3 as steps, l_partkey % 5 - l_partkey % 5 % 2 as interventions, l_tax as cost,
  l_returnflag as expected, case when l_suppkey % 8 = 0 then 'N' else l_returnflag end as detected, cast(l_partkey % 10 < 8 as int) as mono, cast(l_partkey % 10 < 7 as int) as switched, l_partkey % 5 + 1 as rating,
  10 as n, l_partkey % 11 as c, case when l_partkey % 6 = 0 then 'failed' else 'passed' end as outcome_text, l_linenumber as covered, 7 as total, cast(l_partkey % 2 = 0 as int) as fails_before, cast(l_partkey % 3 = 0 as int) as passes_after,
  l_partkey % 3 as f2p_passed, 2 as f2p, l_suppkey % 4 as p2p_passed, 3 as p2p, l_linenumber % 4 as passed, 4 as tests, 4 as checks, l_partkey % 3 as violations, 20 + l_linenumber as lines, l_partkey % 4 as max_severity, l_quantity as time, 10e0 as reference,
  (l_partkey % 101) / 100e0 as position, l_linenumber % 3 as cited, 3 as statements, l_partkey % 6 as used, 6 as provided, l_discount as covered_weight, 1e0 as total_weight, 100 + l_partkey % 50 as source_words, 10 + l_suppkey % 9 as summary_words,
  l_orderkey * 1e0 as request, l_orderkey + l_linenumber / 1e1 as first, l_orderkey + l_linenumber / 1e1 + l_quantity / 1e1 as finish, cast(l_quantity as int) as tokens, l_quantity as latency, l_partkey % 900 as tokens_in, l_suppkey % 300 as tokens_out,
  cast(l_partkey % 3 > 0 as int) as success, l_partkey % 2 as should, l_suppkey % 2 as did, l_partkey % 4 as tp, l_suppkey % 3 as fp, l_linenumber % 3 as fn, l_partkey % 4 as supported, 3 as claims, l_tax as support, l_partkey % 3 as supported_cited, l_partkey % 4 as relevant_citations, 3 as citations, l_returnflag as gold, case when l_partkey % 4 = 0 then 'A' else l_returnflag end as verdict, case when l_partkey % 5 = 0 then 'N' else l_returnflag end as swapped,
  l_partkey % 500 as code, l_partkey % 4 as turn, case when l_discount > 5e-2 then 1e0 when l_discount < 5e-2 then 0e0 else 5e-1 end as outcome, cast(l_discount > 5e-2 as int) as a_wins, l_partkey % 40 as length_a, l_suppkey % 40 as length_b, l_partkey % 2 as judge_own, l_suppkey % 2 as human_own, -1e1 * l_tax as logprob
from (select *, case when l_returnflag = 'R' then 1 else 0 end as t, l_quantity as w, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 10 < 7 as h, (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 1000 as mod1000 from lineitem) b
"""
_RENAMED = {"regression": {"w": "wy"}, "code": {"outcome": "outcome_text"}}


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "lineitem")
    return spark.sql(OBSERVATIONS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long: sums differ in their last digits by order."""
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = f"with obs as ({OBSERVATIONS}) {oracle}" if "from obs" in oracle else oracle
        return f

    return add


def _catalogued(key: str) -> None:
    metric = catalog.CATALOG[key]
    renamed = _RENAMED.get(metric.category, {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = observations(spark, sf_dir)
        own = obs.select(*(F.col(renamed.get(c, c)).alias(c) for c in metric.needs))
        return catalog.evaluate(own, [key], digits=6, strict=False)

    columns = ", ".join(f"{renamed.get(c, c)} as {c}" for c in metric.needs)
    sql = metric.expression().replace("quantile(", "quantile_cont(")
    QUERIES[key.replace(".", "_")] = run
    ORACLE[key.replace(".", "_")] = f"with obs as ({OBSERVATIONS}), own as (select {columns} from obs) select round(cast({sql} as double), 6) as {metric.name} from own"


for _key in catalog.CATALOG:
    _catalogued(_key)


@query("evaluate_by_group", "select l_linestatus, round(cast(sum(case when t = p then w else 0e0 end) / sum(w) as double), 6) as accuracy, round(cast(sum(w * (prob - t) * (prob - t)) / sum(w) as double), 6) as brier_score from obs group by 1")
def _(spark, d):  # noqa: ANN001, ANN202
    return catalog.evaluate(observations(spark, d), ["classification.accuracy", "classification.brier_score"], by=["l_linestatus"], strict=False)


_CELLS = "cells as (select l_returnflag as t, label_pred as p, cast(count(*) as double) as w from obs group by 1, 2), labels as (select distinct t as label from cells union select distinct p from cells), c as (select label, sum(case when t = label and p = label then w else 0e0 end) as tp, sum(case when p = label and t <> label then w else 0e0 end) as fp, sum(case when t = label and p <> label then w else 0e0 end) as fn, sum(w) as n from labels, cells group by label), s as (select label, tp, fp, fn, n - tp - fp - fn as tn, tp + fn as support, tp / (tp + fp) as \"precision\", tp / (tp + fn) as recall, (n - tp - fp - fn) / (n - tp - fn) as specificity, (n - tp - fp - fn) / (n - tp - fp) as npv, 2 * tp / (2 * tp + fp + fn) as f1, 5 * tp / (5 * tp + 4 * fn + fp) as fbeta, tp / (tp + fp + fn) as jaccard from c)"
_ALL = ("precision", "recall", "specificity", "npv", "f1", "fbeta", "jaccard")
_DUCK_ALL = ", ".join(f'round("{s}", 6) as "{s}"' for s in _ALL)
_OBS = f"with obs as ({OBSERVATIONS})"


@query("classification_report", f"{_OBS}, {_CELLS} select label, round(tp, 6) as tp, round(fp, 6) as fp, round(fn, 6) as fn, round(tn, 6) as tn, round(support, 6) as support, {_DUCK_ALL} from s")
def classification_report(spark, d):  # noqa: ANN001, ANN201
    return classification.class_scores(observations(spark, d), "l_returnflag", "label_pred")


ORACLE["classification_report"] = f"{_OBS}, {_CELLS} select label, round(tp, 6) as tp, round(fp, 6) as fp, round(fn, 6) as fn, round(tn, 6) as tn, round(support, 6) as support, {_DUCK_ALL} from s"


@query("classification_averages")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.averaged_scores(observations(spark, d), "l_returnflag", "label_pred")


ORACLE["classification_averages"] = f"""{_OBS}, {_CELLS}, sums as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from s), every as (
select 'macro' as average, {", ".join(f'avg("{s}") as "{s}"' for s in _ALL)} from s union all select 'weighted', {", ".join(f'sum("{s}" * support) / sum(support)' for s in _ALL)} from s
union all select 'micro', tp / (tp + fp), tp / (tp + fn), tn / (tn + fp), tn / (tn + fn), 2 * tp / (2 * tp + fp + fn), 5 * tp / (5 * tp + 4 * fn + fp), tp / (tp + fp + fn) from sums) select average, {_DUCK_ALL} from every"""


@query("classification_agreement")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.agreement_scores(observations(spark, d), "l_returnflag", "label_pred", ["A", "N", "R"])


ORACLE["classification_agreement"] = f"""{_OBS}, x as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as i, case label_pred when 'A' then 0 when 'N' then 1 else 2 end as j from obs), cells as (select i, j, cast(count(*) as double) as w from x group by 1, 2), r as (select i, sum(w) as r from cells group by 1), k as (select j, sum(w) as c from cells group by 1),
g as (select i, j, r, c, coalesce(w, 0) as w from r cross join k left join cells using (i, j)), tot as (select sum(w) as n, sum(case when i = j then w else 0 end) as hit, sum(case when i = j then r * c else 0 end) as rc, 1 - sum(case when i <> j then w else 0 end) * sum(w) / sum(case when i <> j then r * c else 0 end) as k0, 1 - sum(abs(i - j) * w) * sum(w) / sum(abs(i - j) * r * c) as k1, 1 - sum((i - j) * (i - j) * w) * sum(w) / sum((i - j) * (i - j) * r * c) as k2 from g)
select round((hit * n - rc) / sqrt((n * n - (select sum(r * r) from r)) * (n * n - (select sum(c * c) from k))), 6) as mcc, round((select avg(w / r) from g where i = j), 6) as balanced_accuracy, round(k0, 6) as cohen_kappa, round(k1, 6) as kappa_linear, round(k2, 6) as kappa_quadratic from tot"""


@query("confusion_matrix")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.confusion_matrix(observations(spark, d), "l_returnflag", "label_pred", normalize="true")


ORACLE["confusion_matrix"] = f"{_OBS}, cells as (select l_returnflag as t, label_pred as p, cast(count(*) as double) as w from obs group by 1, 2) select t, p, round(w / sum(w) over (partition by t), 6) as w from cells"

_STEPS = "st as (select prob as score, cast(sum(t) as double) as pos, cast(sum(1 - t) as double) as neg from obs group by 1), cu as (select score, pos, neg, sum(pos) over o as cp, sum(neg) over o as cn, sum(pos) over () as ap, sum(neg) over () as an from st window o as (order by score desc rows unbounded preceding))"


def _curve(name: str, f: Callable[..., DataFrame], columns: str) -> None:
    query(name)(lambda spark, d: f(observations(spark, d), "t", "prob"))
    ORACLE[name] = f"{_OBS}, {_STEPS} select {columns} from cu"


_curve("roc_curve", classification.roc_curve, "round(score, 6) as score, round(cn / an, 6) as fpr, round(cp / ap, 6) as tpr")
_curve("pr_curve", classification.pr_curve, 'round(score, 6) as score, round(cp / (cp + cn), 6) as "precision", round(cp / ap, 6) as recall')
_curve("roc_auc_and_average_precision", classification.curve_areas, "round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(pos * cp / (cp + cn)) / sum(pos), 6) as average_precision")
_curve("delong_variance", statistics.delong, "round(sum(pos * (an - cn + neg / 2)) / (max(ap) * max(an)), 6) as auc, round((sum(pos * power((an - cn + neg / 2) / an, 2)) - max(ap) * power(sum(pos * (an - cn + neg / 2)) / (max(ap) * max(an)), 2)) / (max(ap) - 1) / max(ap) + (sum(neg * power((cp - pos / 2) / ap, 2)) - max(an) * power(sum(pos * (an - cn + neg / 2)) / (max(ap) * max(an)), 2)) / (max(an) - 1) / max(an), 6) as variance")


@query("risk_coverage_curve")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.risk_coverage(observations(spark, d), "t", "prob")


ORACLE["risk_coverage_curve"] = f"{_OBS}, {_STEPS} select round(score, 6) as confidence, round((cp + cn) / (ap + an), 6) as coverage, round(cn / (cp + cn), 6) as risk from cu"
_BINS = "bi as (select " + " + ".join(f"cast({k / 10!r}e0 <= prob as int)" for k in range(1, 10)) + " as bin, avg(t * 1e0) as observed, avg(prob) as predicted, cast(count(*) as double) as w from obs group by 1)"


@query("calibration_curve")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.calibration_curve(observations(spark, d), "t", "prob")


ORACLE["calibration_curve"] = f"{_OBS}, {_BINS} select bin, round(observed, 6) as observed, round(predicted, 6) as predicted, round(w, 6) as w from bi"


@query("calibration_errors")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.calibration_errors(observations(spark, d), "t", "prob")


ORACLE["calibration_errors"] = f"{_OBS}, {_BINS} select round(sum(w * abs(observed - predicted)) / sum(w), 6) as expected_calibration_error, round(max(abs(observed - predicted)), 6) as maximum_calibration_error from bi"


@query("calibration_slope_and_intercept")
def _(spark, d):  # noqa: ANN001, ANN202
    obs = observations(spark, d).select("t", (F.col("mod1000") / 1000).alias("prob"))
    slope, large = classification.calibration_line(obs, "t", "prob"), classification.calibration_line(obs, "t", "prob", offset=True)
    return spark.createDataFrame([(slope[0], slope[1], large[0])], "intercept double, slope double, calibration_intercept double")


@query("hosmer_lemeshow", "select round(sum(power(o - e, 2) / (e * (1 - e / m))), 6) as statistic, count(*) - 2 as df from (select g, sum(t) as o, sum(prob) as e, count(*) as m from (select t, prob, ntile(10) over (order by prob, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as g from obs) group by g)")
def _(spark, d):  # noqa: ANN001, ANN202
    obs = observations(spark, d).withColumn("row_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return classification.hosmer_lemeshow(obs, "t", "prob", "row_id")


@query("decision_curve", "select k / 100e0 as threshold, round((sum(case when prob >= k / 100e0 then t else 0 end) - sum(case when prob >= k / 100e0 then 1 - t else 0 end) * (k / 100e0) / (1 - k / 100e0)) / count(*), 6) as net_benefit, round((sum(t) - sum(1 - t) * (k / 100e0) / (1 - k / 100e0)) / count(*), 6) as treat_all from obs, range(1, 100) r(k) group by k")
def _(spark, d):  # noqa: ANN001, ANN202
    return classification.decision_curve(observations(spark, d), "t", "prob")


@query("top_k_accuracy", "select round(avg(case when (cast(q0 > own as int) + cast(q1 > own as int) + cast(q2 > own as int)) < 2 then 1e0 else 0e0 end), 6) as top_k_accuracy from (select *, case i when 0 then q0 when 1 then q1 else q2 end as own from (select l_partkey % 3 as i, (l_partkey % 17) / 50e0 as q0, (l_suppkey % 13) / 50e0 as q1, (l_linenumber % 7) / 50e0 as q2 from obs))")
def _(spark, d):  # noqa: ANN001, ANN202
    obs = observations(spark, d).selectExpr("cast(l_partkey % 3 as int) as i", "array((l_partkey % 17) / 50e0, (l_suppkey % 13) / 50e0, (l_linenumber % 7) / 50e0) as q")
    return classification.top_k_accuracy(obs, "i", "q", k=2)


@query("weighted_relative_errors", "select round(sum(abs(yhat - y)) / sum(abs(y - m)), 6) as rae from obs, (select avg(y) as m from (select l_extendedprice as y from lineitem))")
def _(spark, d):  # noqa: ANN001, ANN202
    obs = observations(spark, d)
    return obs.crossJoin(F.broadcast(obs.agg(F.avg("y").alias("m")))).agg((F.sum(F.abs(F.col("yhat") - F.col("y"))) / F.sum(F.abs(F.col("y") - F.col("m")))).alias("rae"))


_NR = "l_returnflag in ('N', 'R')"
_TWO = "(select count(*) filter (where l_returnflag = 'N') as n0, avg(y) filter (where l_returnflag = 'N') as m0, var_samp(y) filter (where l_returnflag = 'N') as v0, count(*) filter (where l_returnflag = 'R') as n1, avg(y) filter (where l_returnflag = 'R') as m1, var_samp(y) filter (where l_returnflag = 'R') as v1 from obs)"
query("t_test", f"{_OBS} select round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) as statistic, round(power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)), 3) as df, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) as cohens_d from {_TWO}")(lambda s, d: statistics.welch_statistics(observations(s, d), "y", "l_returnflag", "N", "R").withColumn("df", F.round("df", 3)))
ORACLE["t_test"] = f"{_OBS} select round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) as statistic, round(power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)), 3) as df, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) as cohens_d from {_TWO}"
query("paired_t_test", "select round(avg(l_tax - l_discount) / stddev_samp(l_tax - l_discount) * sqrt(count(*)), 6) as statistic, count(*) - 1 as df, round(avg(l_tax - l_discount) / stddev_samp(l_tax - l_discount), 6) as cohens_dz from lineitem")(lambda s, d: statistics.paired_t(observations(s, d), "l_tax", "l_discount"))
_RANK = "rk as (select *, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2e0 as r, count(*) over (partition by l_quantity) as ties from {src})"
query("mann_whitney")(lambda s, d: statistics.mann_whitney(observations(s, d), "l_quantity", "l_returnflag", "N", "R"))
ORACLE["mann_whitney"] = f"with src as (select * from lineitem where {_NR}), {_RANK.format(src='src')}, g as (select cast(count(*) filter (where l_returnflag = 'N') as double) as na, cast(count(*) filter (where l_returnflag = 'R') as double) as nb, sum(r) filter (where l_returnflag = 'N') as ra, cast(sum(ties * ties - 1) as double) as tt from rk) select round(ra - na * (na + 1) / 2, 6) as u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - tt / ((na + nb) * (na + nb - 1)))), 6) as z, round((ra - na * (na + 1) / 2) / (na * nb), 6) as auc, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 6) as cliffs_delta from g"
query("kruskal_wallis")(lambda s, d: statistics.kruskal_wallis(observations(s, d), "l_quantity", "l_returnflag"))
ORACLE["kruskal_wallis"] = f"with {_RANK.format(src='lineitem')}, p as (select l_returnflag, sum(r) as r, count(*) as m from rk group by 1), q as (select sum(r * r / m) as q, cast(sum(m) as double) as n, count(*) - 1 as df from p), t as (select cast(sum(ties * ties - 1) as double) as tt from rk), h as (select (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tt / (n * n * n - n)) as h, df, n from q, t) select round(h, 6) as h, df, round(h / (n - 1), 6) as epsilon_squared from h"
_BLOCK = "select l_partkey as block, t as treatment, max(case when l_linenumber = t then l_quantity else 0e0 end) as v from lineitem, (select 1 as t union all select 2 union all select 3 union all select 4) k group by 1, 2"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    view(spark, d, "lineitem")
    return spark.sql(_BLOCK)


query("friedman")(lambda s, d: statistics.friedman(_blocks(s, d), "block", "treatment", "v"))
ORACLE["friedman"] = f"with b as ({_BLOCK}), r as (select *, rank() over (partition by block order by v) + (count(*) over (partition by block, v) - 1) / 2e0 as r, count(*) over (partition by block, v) as c, count(*) over (partition by block) as k from b), p as (select treatment, sum(r) as r, max(k) as k from r group by 1), m as (select cast(count(distinct block) as double) as b, cast(sum(c * c - 1) as double) as t from r), q as (select sum(r * r) as q, cast(max(k) as double) as k from p), x as (select (12 / (b * k * (k + 1)) * q - 3 * b * (k + 1)) / (1 - t / (b * k * (k * k - 1))) as x, b, k from q, m) select round(x, 6) as statistic, cast(k - 1 as bigint) as df, round(x / (b * (k - 1)), 6) as kendalls_w from x"
query("wilcoxon")(lambda s, d: statistics.wilcoxon(observations(s, d), "l_linenumber", "turn"))
ORACLE["wilcoxon"] = f"{_OBS}, x as (select l_linenumber - turn as d from obs where l_linenumber <> turn), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2e0 as r from x), s as (select sum(case when d > 0 then r else 0e0 end) as a, sum(case when d < 0 then r else 0e0 end) as b from r) select round(a, 6) as w_plus, round(b, 6) as w_minus, round((a - b) / (a + b), 6) as rank_biserial from s"
query("mcnemar", "select cast(sum(clean * (1 - noisy)) as bigint) as b, cast(sum((1 - clean) * noisy) as bigint) as c, round(power(abs(sum(clean * (1 - noisy)) - sum((1 - clean) * noisy)) - 1, 2) / (sum(clean * (1 - noisy)) + sum((1 - clean) * noisy)), 6) as statistic from obs")(lambda s, d: statistics.mcnemar(observations(s, d), "clean", "noisy"))
query("chi_square")(lambda s, d: statistics.chi_square(observations(s, d), "l_returnflag", "label_pred"))
ORACLE["chi_square"] = f"{_OBS}, c as (select l_returnflag as a, label_pred as b, cast(count(*) as double) as o from obs group by 1, 2), m as (select o, sum(o) over (partition by a) as r, sum(o) over (partition by b) as k, sum(o) over () as n from c), x as (select max(n) * (sum(o * o / (r * k)) - 1) as x, max(n) as n from m) select round(x, 6) as statistic, (select (count(distinct a) - 1) * (count(distinct b) - 1) from c) as df, round(sqrt(x / (n * (least((select count(distinct a) from c), (select count(distinct b) from c)) - 1))), 6) as cramers_v from x"
_PVALUES = "select s_suppkey as k, s_nationkey % 5 as family, ((s_suppkey * 37) % 1000 + 1) / 20000e0 as p from supplier"


@query("adjust_pvalues", f"with x as (select *, count(*) over (partition by family) as n, row_number() over (partition by family order by p, k) as i from ({_PVALUES})) select k, family, round(p, 6) as p, round(least(1e0, p * n), 6) as bonferroni, round(least(1e0, max((n - i + 1) * p) over (partition by family order by p, k)), 6) as holm, round(least(1e0, min((n - i + 1) * p) over (partition by family order by p desc, k desc)), 6) as hochberg, round(least(1e0, min(p * n / i) over (partition by family order by p desc, k desc)), 6) as bh, round(least(1e0, list_sum(list_transform(range(1, n + 1), lambda j: 1e0 / j)) * min(p * n / i) over (partition by family order by p desc, k desc)), 6) as \"by\" from x")
def _(spark, d):  # noqa: ANN001, ANN202
    view(spark, d, "supplier")
    return statistics.adjust_pvalues(spark.sql(_PVALUES), "k", "p", ["family"])


query("bootstrap_accuracy")(lambda s, d: statistics.bootstrap_accuracy(observations(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "t", "p"), "t", "p", replicates=2000))

def _one(spark: SparkSession, numbers: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in numbers.values())], ", ".join(f"{k} double" for k in numbers))


query("fisher_exact", "select cast(sum(clean * noisy) as bigint) as a, cast(sum(clean * (1 - noisy)) as bigint) as b, cast(sum((1 - clean) * noisy) as bigint) as c, cast(sum((1 - clean) * (1 - noisy)) as bigint) as d, round(cast(sum(clean * noisy) as double) * sum((1 - clean) * (1 - noisy)) / (cast(sum(clean * (1 - noisy)) as double) * sum((1 - clean) * noisy)), 6) as odds_ratio from obs")(lambda s, d: exact_tests.two_by_two(observations(s, d), "clean", "noisy"))
_MID = "rank() over ({part} order by {v}) + (count(*) over ({also}) - 1) / 2e0"
_PLACED = ", ".join(_MID.format(part="", v=v, also=f"partition by {v}") + " - (" + _MID.format(part="partition by t", v=v, also=f"partition by t, {v}") + f") as m{v}" for v in ("a", "b"))
query("delong_test", f", s as (select t, prob as a, score as b from obs), r as (select t, {_PLACED} from s), k as (select cast(sum(t) as double) as n1, cast(sum(1 - t) as double) as n0 from s), v as (select t, n0, n1, case when t = 1 then ma / n0 else 1 - ma / n1 end as va, case when t = 1 then mb / n0 else 1 - mb / n1 end as vb from r, k) select round(avg(va) filter (where t = 1), 6) as auc_a, round(avg(vb) filter (where t = 1), 6) as auc_b, round(avg(va - vb) filter (where t = 1), 6) as difference, round(1e6 * (var_samp(va - vb) filter (where t = 1) / max(n1) + var_samp(va - vb) filter (where t = 0) / max(n0)), 3) as variance_millionths from v")(
    lambda s, d: exact_tests.delong_difference(observations(s, d), "t", "prob", "score").select("auc_a", "auc_b", "difference", F.round(F.col("variance") * 1e6, 3).alias("variance_millionths"))
)
_RIVALS = {"first": "p", "second": "succeeded", "third": "harmful"}
query("compare_models", " union all ".join(f"select '{m}' as model, round(avg(cast({c} = t as int)), 6) as accuracy, round(avg(cast({c} = t as int)) - avg(cast(p = t as int)), 6) as difference, count(*) filter (where p = t and {c} <> t) as b, count(*) filter (where p <> t and {c} = t) as c from obs" for m, c in _RIVALS.items()))(lambda s, d: exact_tests.compare_counts(observations(s, d), "t", _RIVALS, "first"))
query("shapiro_wilk")(lambda s, d: _one(s, exact_tests.shapiro_wilk(s.read.parquet(f"{d}/supplier.parquet"), "s_acctbal")))
query("mann_whitney_p")(lambda s, d: _one(s, exact_tests.mann_whitney_test(observations(s, d), "l_quantity", "l_returnflag", "N", "R")))
query("wilcoxon_p")(lambda s, d: _one(s, exact_tests.wilcoxon_test(observations(s, d), "l_linenumber", "turn")))
query("bootstrap_accuracy_bca")(lambda s, d: _one(s, exact_tests.bootstrap_accuracy_bca(observations(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t", "p"), "t", "p")))

_SIMILAR = "v as (select vec_id, label, e from (select vec_id, label, embedding as e from embeddings)), pairs as (select q.vec_id as query, d.vec_id as doc, q.label as ql, d.label as dl, round(list_dot_product(cast(q.e as double[]), cast(d.e as double[])) / sqrt(list_dot_product(cast(q.e as double[]), cast(q.e as double[])) * list_dot_product(cast(d.e as double[]), cast(d.e as double[]))), 9) as sim from v q, v d where q.vec_id % 25 = 0 and q.vec_id <> d.vec_id), run as (select * from (select query, doc, ql, dl, row_number() over (partition by query order by sim desc, doc) as rank from pairs) where rank <= 20), qrels as (select q.vec_id as query, d.vec_id as doc, 1 + d.vec_id % 3 as grade from v q, v d where q.vec_id % 25 = 0 and q.vec_id <> d.vec_id and q.label = d.label)"


def _retrieval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The run of a cosine search (queries: every 25th vector, a stated set) and judgements by equal label."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v"))
    q = v.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql"), "v")
    near = neighbours.neighbours(q.select(F.col("query").alias("id"), "v"), v.select(F.col("vec_id").alias("id"), "v"), k=20, skip_same=True)
    ranked = near.select(F.col("query_id").alias("query"), F.col("id").alias("doc"), F.round("score", 9).alias("sim")).withColumn("rank", F.expr("row_number() over (partition by query order by sim desc, doc)"))
    qrels = q.join(v, (F.col("ql") == F.col("label")) & (F.col("query") != F.col("vec_id"))).select("query", F.col("vec_id").alias("doc"), (1 + F.col("vec_id") % 3).alias("grade"))
    return ranked.select("query", "doc", "rank"), qrels


@query("retrieval_scores", f"with {_SIMILAR}, ideal as (select query, count(*) as n, sum(case when i <= 10 then grade / log2(i + 1e0) else 0e0 end) as ideal from (select *, row_number() over (partition by query order by grade desc, doc) as i from qrels) group by 1), hit as (select *, row_number() over (partition by query order by rank) as seen from (select r.query, r.rank, j.grade from run r join qrels j using (query, doc) where rank <= 10)), got as (select query, count(*) as hits, min(rank) as first, sum(seen * 1e0 / rank) as ap, sum(grade / log2(rank + 1e0)) as gain from hit group by 1) select query, round(coalesce(hits / 10e0, 0), 6) as \"precision\", round(coalesce(hits * 1e0 / n, 0), 6) as recall, case when hits > 0 then 1e0 else 0e0 end as hit_rate, round(coalesce(1e0 / first, 0), 6) as mrr, round(coalesce(ap / n, 0), 6) as average_precision, round(coalesce(gain / ideal, 0), 6) as ndcg from ideal left join got using (query)")
def _(spark, d):  # noqa: ANN001, ANN202
    return retrieval.retrieval_scores(*_retrieval(spark, d), k=10)


_CHUNKS = "select l_orderkey as query, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, cast(l_partkey % 3 = 0 as int) as flag from lineitem"


@query("context_precision", f"select query, round(coalesce(sum(case when flag = 1 then h * 1e0 / pos end) / nullif(sum(flag), 0), 0), 6) as context_precision, round(avg(flag * 1e0), 6) as context_relevance from (select *, sum(flag) over (partition by query order by pos) as h from ({_CHUNKS})) group by 1")
def _(spark, d):  # noqa: ANN001, ANN202
    view(spark, d, "lineitem")
    return retrieval.context_precision(spark.sql(_CHUNKS), "query", "pos", "flag")


_RATINGS = "select l_partkey as item, t as rater, cast((l_partkey + max(case when l_linenumber = t then l_orderkey else 0 end) % 2) % 5 + 1 as double) as v from lineitem, (select 1 as t union all select 2 union all select 3 union all select 4) k group by 1, 2"


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    view(spark, d, "lineitem")
    return spark.sql(_RATINGS)


query("krippendorff_nominal", f"with c as (select item, v, cast(count(*) as double) as c from ({_RATINGS}) group by 1, 2), i as (select item, sum(c) as m, sum(c * c) as cc from c group by 1 having sum(c) > 1), p as (select v, sum(c) as c from c where item in (select item from i) group by 1) select round(1 - ((select sum(m) from i) - 1) * (select sum((m * m - cc) / (m - 1)) from i) / (select power(sum(c), 2) - sum(c * c) from p), 6) as alpha")(lambda s, d: judges.krippendorff_alpha(_ratings(s, d), "item", "v"))
query("krippendorff_interval", f"with c as (select item, v, cast(count(*) as double) as c from ({_RATINGS}) group by 1, 2), i as (select item, sum(c) as m, sum(c * v) as s, sum(c * v * v) as q from c group by 1 having sum(c) > 1), p as (select v, sum(c) as c from c where item in (select item from i) group by 1) select round(1 - ((select sum(m) from i) - 1) * (select sum((2 * m * q - 2 * s * s) / (m - 1)) from i) / (select 2 * sum(c) * sum(c * v * v) - 2 * power(sum(c * v), 2) from p), 6) as alpha")(lambda s, d: judges.krippendorff_alpha(_ratings(s, d), "item", "v", "interval"))
for _level, _far in (("ordinal", "power(x.r - y.r, 2)"), ("ratio", "power((x.v - y.v) / (x.v + y.v), 2)")):
    query(f"krippendorff_{_level}")(lambda s, d, level=_level: judges.krippendorff_alpha(_ratings(s, d), "item", "v", level))
    ORACLE[f"krippendorff_{_level}"] = f"with c as (select item, v, cast(count(*) as double) as c, sum(cast(count(*) as double)) over (partition by item) as m from ({_RATINGS}) group by 1, 2), p as (select v, sum(c) as c from c where m > 1 group by 1), q as (select v, c, sum(c) over (order by v) - c / 2 as r from p), z as (select item, m, c, v, r from (select item, m, c.c, c.v, r from c join q using (v) where m > 1)) select round(1 - (max(n) - 1) * max(o) / max(e), 6) as alpha from (select sum(x.c * y.c * {_far} / (x.m - 1)) as o from z x join z y on x.item = y.item), (select sum(x.c * y.c * {_far}) as e from q x, q y), (select sum(c) as n from q)"
query("fleiss_kappa", f"with c as (select item, v, cast(count(*) as double) as c from ({_RATINGS}) group by 1, 2), i as (select sum(c) as m, sum(c * (c - 1)) as p from c group by item), s as (select v, sum(c) as c from c group by 1), o as (select avg(p / (m * (m - 1))) as o from i), e as (select sum(c * c) / power(sum(c), 2) as e from s) select round((o - e) / (1 - e), 6) as kappa from o, e")(lambda s, d: judges.fleiss_kappa(_ratings(s, d), "item", "v"))
query("sample_agreement", f"with c as (select item, v, count(*) as c from ({_RATINGS}) group by 1, 2), i as (select sum(c) as n, sum(c * (c - 1)) as same, max(c) as top, count(*) as k from c group by item) select round(avg(cast(k = 1 as int) * 1e0), 6) as unanimous, round(avg(case when n > 1 then same * 1e0 / (n * (n - 1)) end), 6) as pairwise, round(avg(top * 1e0 / n), 6) as modal_share from i")(lambda s, d: judges.sample_agreement(_ratings(s, d), "item", "v"))
query("majority_vote_accuracy", f"with c as (select item, v, count(*) as c, min(rater) as p from ({_RATINGS}) group by 1, 2), t as (select *, row_number() over (partition by item order by c desc, p) as i from c) select round(avg(cast(v = item % 5 + 1 as int) * 1e0), 6) as majority_vote_accuracy from t where i = 1")(lambda s, d: judges.majority_vote(_ratings(s, d).withColumn("ref", (F.col("item") % 5 + 1).cast("double")), "item", "v", "rater", "ref"))
query("direct_assessment", f"select item % 4 as system, round(avg(case when sd > 0 then (v - m) / sd else 0e0 end), 6) as z from (select *, avg(v) over (partition by rater) as m, stddev_samp(v) over (partition by rater) as sd from ({_RATINGS})) group by 1")(lambda s, d: judges.rater_z_scores(_ratings(s, d).withColumn("system", F.col("item") % 4), "rater", "v", "system"))
_GAMES = "select l_suppkey % 5 as a, l_partkey % 5 as b, outcome, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from obs where l_suppkey % 5 <> l_partkey % 5"


def _games(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).selectExpr("l_suppkey % 5 as a", "l_partkey % 5 as b", "outcome", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o").filter("a <> b")


query("win_matrix", f"{_OBS}, g as ({_GAMES}) select a, b, round(sum(w), 6) as wins, count(*) as n from (select a, b, outcome as w from g union all select b, a, 1 - outcome from g) group by 1, 2")(lambda s, d: judges.win_counts(_games(s, d), "a", "b", "outcome"))
ORACLE["win_matrix"] = f"{_OBS}, g as ({_GAMES}) select a, b, round(sum(w), 6) as wins, count(*) as n from (select a, b, outcome as w from g union all select b, a, 1 - outcome from g) group by 1, 2"
query("bradley_terry")(lambda s, d: s.createDataFrame([(int(k), float(v)) for k, v in judges.bradley_terry(_games(s, d), "a", "b", "outcome").items()], "system long, strength double"))
query("elo_ratings")(lambda s, d: judges.elo(_games(s, d).withColumn("o", F.to_json("o")), "o", "a", "b", "outcome"))

_PAIRS_SPARK = "select doc_id, array_join(w, ' ') as reference, array_join(filter(w, (x, i) -> (i + 1) % 5 <> 0), ' ') as prediction from (select doc_id, filter(split(text, '\\\\s+'), x -> x <> '') as w from documents)"
_PAIRS_DUCK = "pr as (select doc_id, w as r, list_filter(w, lambda x, i: i % 5 <> 0) as p from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).createOrReplaceTempView("documents")
    return spark.sql(_PAIRS_SPARK)


def _overlap_oracle(words: str, columns: str) -> str:
    return f"with {_PAIRS_DUCK}, w as (select doc_id, {words.format(x='r')} as r, {words.format(x='p')} as p from pr), x as (select doc_id, unnest(r) as g, 1 as r, 0 as p from w union all select doc_id, unnest(p), 0, 1 from w), c as (select doc_id, g, sum(r) as r, sum(p) as p from x group by 1, 2), o as (select doc_id, cast(sum(least(r, p)) as double) as hits, cast(sum(r) as double) as nr, cast(sum(p) as double) as np from c group by 1) select doc_id, {columns} from o union all select doc_id, 1e0, 1e0, 1e0 from w where len(r) = 0 and len(p) = 0"


_PRF = 'round(case when np = 0 then 0 else hits / np end, 6) as "precision", round(case when nr = 0 then 0 else hits / nr end, 6) as recall, round(2 * hits / (nr + np), 6) as f1'
query("token_f1", _overlap_oracle("{x}", _PRF))(lambda s, d: text.overlap_scores(_pairs(s, d), "doc_id", text.tokens(F.col("reference")), text.tokens(F.col("prediction"))))
_ROUGE = "list_filter(string_split_regex(lower(array_to_string({x}, ' ')), '[^a-z0-9]+'), lambda y: y <> '')"
query("rouge_1", _overlap_oracle(_ROUGE, _PRF))(lambda s, d: text.overlap_scores(_pairs(s, d), "doc_id", text.rouge_words(F.col("reference")), text.rouge_words(F.col("prediction"))))
_BIGRAMS = f"list_transform(list_zip(({_ROUGE})[:-2], ({_ROUGE})[2:]), lambda z: z[1] || chr(1) || z[2])"
query("rouge_2", _overlap_oracle(_BIGRAMS, _PRF))(lambda s, d: text.overlap_scores(_pairs(s, d), "doc_id", text.rouge_words(F.col("reference")), text.rouge_words(F.col("prediction")), 2))
query("distinct_1", "select round(count(*) * 1e0 / sum(c), 6) as distinct_1 from (select g, count(*) as c from (select unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as g from documents) group by 1)")(lambda s, d: text.distinct_n(s.read.parquet(f"{d}/documents.parquet"), "text", 1))
_NORMAL = "trim(regexp_replace(regexp_replace(translate(lower(array_to_string({x}, ' ')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
query("exact_match", f"with {_PAIRS_DUCK} select round(avg(cast({_NORMAL.format(x='r')} = {_NORMAL.format(x='p')} as int) * 1e0), 6) as exact_match from pr")(lambda s, d: text.exact_match(_pairs(s, d), "reference", "prediction"))
query("bleu")(lambda s, d: text.bleu(_pairs(s, d)))
query("sentence_bleu")(lambda s, d: text.scored(_pairs(s, d), lambda r, p: [text.bleu_from(text.bleu_statistics(r, p), effective=True)], ["sentence_bleu"]).select("doc_id", "sentence_bleu"))
query("chrf")(lambda s, d: text.scored(_pairs(s, d), lambda r, p: [text.chrf_from(text.chrf_statistics(r, p))], ["chrf"]).select("doc_id", "chrf"))
query("ter")(lambda s, d: text.scored(_pairs(s, d), text.translation_edits, ["edits", "words"]).agg((100 * F.sum("edits") / F.sum("words")).alias("ter")))
query("rouge_l")(lambda s, d: text.scored(_pairs(s, d), text.rouge_l, ["precision", "recall", "f1"]).select("doc_id", "precision", "recall", "f1"))
query("meteor")(lambda s, d: text.scored(_pairs(s, d), lambda r, p: text.meteor(r, p), ["meteor"]).select("doc_id", "meteor"))
query("cider")(lambda s, d: text.cider(_pairs(s, d), "doc_id"))

_CALLS = "select user_id as task, event_id as o, event_type as tool, cast(event_type <> 'error' as int) as ok, props as args, value from events"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    view(spark, d, "events")
    return spark.sql(_CALLS)


query("unnecessary_tool_calls", f"with x as (select task, tool, row_number() over (partition by task, tool order by o) as m, row_number() over (partition by task order by o) - row_number() over (partition by task, tool order by o) as i from ({_CALLS})), r as (select task, tool, i, count(*) as run, sum(cast(m > 1 as int)) as again from x group by 1, 2, 3), t as (select task, max(run) as run, sum(again) as again, sum(run) as n from r group by 1) select round(sum(again) * 1e0 / sum(n), 6) as unnecessary_rate, round(avg(cast(run >= 3 as int) * 1e0), 6) as loop_rate from t")(lambda s, d: agents.repeated_calls(_calls(s, d), "task", "o", "tool"))
query("tool_failure_recovery", f"select round(avg(later * 1e0), 6) as recovery_rate from (select ok, coalesce(max(ok) over (partition by task, floor(value / 10) order by o rows between 1 following and unbounded following), 0) as later from ({_CALLS})) where ok = 0")(lambda s, d: agents.failure_recovery(_calls(s, d).withColumn("tool", F.floor(F.col("value") / 10)), "task", "o", "tool", "ok"))
query("invalid_tool_calls", f"select round(avg(cast(tool not in ('click', 'view') as int) * 1e0), 6) as invalid_tool_rate from ({_CALLS})")(lambda s, d: agents.invalid_tools(_calls(s, d), "tool", ["click", "view"]))
query("latency_summary", f"select tool, count(value) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from ({_CALLS}) group by 1")(lambda s, d: agents.summary(_calls(s, d), "value", ("tool",)))
query("needle_in_haystack", "select l_linenumber as length, depth, round(avg(correct * 1e0), 6) as accuracy from (select l_linenumber, l_partkey % 4 as depth, correct from obs) group by cube (l_linenumber, depth)")(lambda s, d: agents.accuracy_grid(observations(s, d).selectExpr("l_linenumber as length", "l_partkey % 4 as depth", "correct"), "correct", "length", "depth"))
query("pass_at_k", "select round(avg(case when n - c < 3 then 1e0 else 1 - (n - c) * (n - c - 1) * (n - c - 2) * 1e0 / (n * (n - 1) * (n - 2)) end), 6) as pass_at_k from obs")(lambda s, d: agents.pass_at_k(observations(s, d), "n", "c", 3))
query("energy", "select round(sum((u - o) * (p + q) / 2), 4) as joules from (select o, value as p, lead(o) over (order by o) as u, lead(value) over (order by o) as q from (select event_id as o, value from events))")(lambda s, d: agents.energy(_calls(s, d), "o", "value").select(F.round("joules", 4).alias("joules")))
query("tool_call_scores", f"with e as (select task, tool as c, count(*) as e from ({_CALLS}) group by 1, 2), p as (select task, tool as c, count(*) as p from ({_CALLS}) where o % 5 <> 0 group by 1, 2), t as (select coalesce(e.task, p.task) as task, sum(least(coalesce(e, 0), coalesce(p, 0))) as hit, sum(coalesce(e, 0)) as e, sum(coalesce(p, 0)) as p from e full join p on e.task = p.task and e.c = p.c group by 1) select round(sum(hit) * 1e0 / sum(p), 6) as \"precision\", round(sum(hit) * 1e0 / sum(e), 6) as recall, round(2e0 * sum(hit) / (sum(e) + sum(p)), 6) as f1, round(avg(cast(hit = e and hit = p as int) * 1e0), 6) as exact from t")(lambda s, d: structured.tool_call_scores(_calls(s, d), _calls(s, d).filter("o % 5 <> 0"), "task", "tool"))
_OUTPUTS = "select event_id, case when event_id % 7 = 0 then substring(props, 1, length(props) - 1) else props end as output from events"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    view(spark, d, "events")
    return spark.sql(_OUTPUTS)


query("json_validity", f"select round(avg(cast(json_valid(output) as int) * 1e0), 6) as json_validity from ({_OUTPUTS})")(lambda s, d: _outputs(s, d).agg(F.avg(structured.valid_json(F.col("output")).cast("double")).alias("json_validity")))
query("json_schema_compliance", f"select round(avg(cast(json_valid(output) as int) * 1e0), 6) as json_schema_compliance from ({_OUTPUTS})")(lambda s, d: _outputs(s, d).agg(F.avg(structured.schema_error(F.col("output"), {"type": "object"}).isNull().cast("double")).alias("json_schema_compliance")))
query("extra_content_rate")(lambda s, d: structured.extra_content_rate(_outputs(s, d), "output"))
query("format_compliance", f"select round(avg(cast(regexp_full_match(trim(output), '(?s)\\{{.*\\}}') as int) * 1e0), 6) as format_compliance from ({_OUTPUTS})")(lambda s, d: structured.format_compliance(_outputs(s, d), "output", r"\{.*\}"))
query("xml_validity")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").agg(F.avg(structured.valid_xml(F.col("html")).cast("double")).alias("xml_validity")))
query("pii_leakage")(lambda s, d: safety.pii_leakage(s.read.parquet(f"{d}/documents.parquet"), "text"))
query("syntax_validity")(lambda s, d: s.read.parquet(f"{d}/events.parquet").agg(F.avg(agents.valid_python(F.col("props")).cast("double")).alias("syntax_validity")))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Masks of 32 x 32 pixels, an image for each supplier."""
    px = spread(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("cast(s_suppkey as long) as image")).selectExpr("image", "explode(sequence(0, 31)) as y").selectExpr("image", "y", "explode(sequence(0, 31)) as x")
    disc = lambda shift: f"case when (x - {shift} - 8 - image % 16) * (x - {shift} - 8 - image % 16) + (y - 8 - image * 5 % 16) * (y - 8 - image * 5 % 16) <= 36 then 1 + image % 3 else 0 end"
    return px.selectExpr("image", "y", "x", f"cast({disc('0')} as int) as t", f"cast({disc('image % 3')} as int) as p")


_PX = "px as (select i as image, y, x, case when (x - 8 - i % 16) * (x - 8 - i % 16) + (y - 8 - i * 5 % 16) * (y - 8 - i * 5 % 16) <= 36 then 1 + i % 3 else 0 end as t, case when (x - i % 3 - 8 - i % 16) * (x - i % 3 - 8 - i % 16) + (y - 8 - i * 5 % 16) * (y - 8 - i * 5 % 16) <= 36 then 1 + i % 3 else 0 end as p from (select s_suppkey as i from supplier), range(32) b(y), range(32) c(x)), k as (select l.l as label, cast(count(*) filter (where t = l.l and p = l.l) as double) as tp, cast(count(*) filter (where t <> l.l and p = l.l) as double) as fp, cast(count(*) filter (where t = l.l and p <> l.l) as double) as fn from px, (values (0), (1), (2), (3)) l(l) group by 1)"
query("segmentation_scores", f"with {_PX} select cast(label as int) as label, round(tp / (tp + fp + fn), 6) as iou, round(2 * tp / (2 * tp + fp + fn), 6) as dice, round(tp / (tp + fn), 6) as recall, round(tp + fn, 6) as support from k")(lambda s, d: vision.segmentation_scores(_pixels(s, d)))
query("segmentation_summary", f"with {_PX} select round(avg(tp / (tp + fp + fn)), 6) as miou, round(avg(2 * tp / (2 * tp + fp + fn)), 6) as dice, round(avg(tp / (tp + fn)), 6) as mean_pixel_accuracy, round((select avg(cast(t = p as int) * 1e0) from px), 6) as pixel_accuracy from k")(lambda s, d: vision.segmentation_summary(_pixels(s, d)))
query("surface_distances")(lambda s, d: vision.surface_distances(_pixels(s, d), "image"))


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """True and found boxes, 40 an image, so that images grow with the table and the 100 detections of an image and class lose none."""
    view(spark, d, "part")
    base = "select p_partkey div 40 as image, cast(p_partkey % 3 as int) as label, p_partkey as id, cast(p_partkey % 400 as double) as x, cast(p_partkey * 7 % 400 as double) as y, p_size + 10.0D as s, cast(p_partkey % 7 - 3 as double) as j from part"
    t = spark.sql(f"select image, label, array(x, y, x + s, y + s) as box, id from ({base})")
    f = spark.sql(f"select image, label, array(x + j, y + j, x + j + s, y + j + s) as box, (id * 31 % 1000) / 1000.0D as score, id from ({base})")
    return t, f


query("detection_average_precision")(lambda s, d: vision.detection_average_precision(*_boxes(s, d)))
query("windowed_event_rates", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(cast(event_type <> 'error' as int) * 1e0), 6) as rate, round(avg(value), 6) as mean from events group by 1, 2")(lambda s, d: windowed_rates(s.read.parquet(f"{d}/events.parquet").withColumn("ok", (F.col("event_type") != "error").cast("int")), "ts", "ok", "value", by=("event_type",)))
query("metric_catalogue")(lambda s, d: s.createDataFrame([(k, m.category, m.higher_is_better) for k, m in catalog.CATALOG.items()], "id string, category string, higher_is_better boolean"))

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_BY_KEY = ", ".join(_KEY)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).withColumn("row_id", F.struct(*_KEY))


def _plain(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


_ERRORS = f"{_OBS}, o as (select prob, 1 - correct as err, row_number() over w as k, sum(1 - correct) over (order by prob desc, {_BY_KEY} rows unbounded preceding) as e from obs window w as (order by prob desc, {_BY_KEY})), n as (select count(*) as n, sum(err) as wrong from o)"
query("aurc")(lambda s, d: selective.aurc(_keyed(s, d), "correct", "prob", "row_id"))
ORACLE["aurc"] = f"{_ERRORS} select round(avg(e * 1e0 / k), 6) as aurc, round(avg(e * 1e0 / k) - avg(greatest(0, k - (n - wrong)) * 1e0 / k), 6) as e_aurc, round(avg(greatest(0, k - (n - wrong)) * 1e0 / k), 6) as optimal_aurc from o, n"
query("selective_risk")(lambda s, d: selective.selective_risk(_keyed(s, d), "correct", "prob", "row_id"))
ORACLE["selective_risk"] = f"{_ERRORS} select round(avg(err * 1e0), 6) as risk, round(count(*) * 1e0 / max(n), 6) as coverage, round(min(prob), 6) as threshold, round(max(wrong) * 1e0 / max(n), 6) as full_coverage_risk from o, n where k <= ceil(8e-1 * n)"
query("adaptive_calibration_error")(lambda s, d: selective.adaptive_calibration_error(_keyed(s, d), "correct", "prob", "row_id"))
ORACLE["adaptive_calibration_error"] = f"{_OBS}, o as (select prob, correct, row_number() over (order by prob, {_BY_KEY}) - 1 as k, count(*) over () as n from obs), b as (select case when k < (n % 15) * (n // 15 + 1) then k // (n // 15 + 1) else n % 15 + (k - (n % 15) * (n // 15 + 1)) // (n // 15) end as b, prob, correct from o) select round(avg(g), 6) as adaptive_calibration_error from (select abs(avg(correct * 1e0) - avg(prob)) as g from b group by b)"
_RISKS = f"{_OBS}, {_STEPS}, rc as (select score, (cp + cn) / (ap + an) as coverage, cn / (cp + cn) as risk from cu)"
query("risk_at_coverage")(lambda s, d: selective.risk_at_coverage(observations(s, d), "t", "prob"))
ORACLE["risk_at_coverage"] = f"{_RISKS} select round(arg_min(risk, coverage), 6) as risk, round(min(coverage), 6) as coverage, round(arg_min(score, coverage), 6) as threshold from rc where coverage >= 8e-1 - 1e-12"
query("coverage_at_risk")(lambda s, d: selective.coverage_at_risk(observations(s, d), "t", "prob", risk=0.3))
ORACLE["coverage_at_risk"] = f"{_RISKS} select round(coalesce(max(coverage), 0), 6) as coverage, round(arg_max(risk, coverage), 6) as risk, round(arg_max(score, coverage), 6) as threshold from rc where risk <= 3e-1 + 1e-12"
query("confidence_accuracy_correlation")(lambda s, d: selective.confidence_correlation(observations(s, d), "t", "prob"))
ORACLE["confidence_accuracy_correlation"] = f"{_OBS}, {_STEPS}, r as (select t, prob, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2e0 as r from obs) select (select round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) from cu) as auroc, round(corr(prob, t), 6) as point_biserial, round(corr(r, t), 6) as spearman, round(avg(t * 1e0), 6) as accuracy, round(avg(prob), 6) as mean_confidence from r"

query("answer_consistency", "with c as (select l_partkey as q, l_returnflag as a, count(*) as c from lineitem group by 1, 2), q as (select sum(c) as n, sum(c * (c - 1)) as same from c group by q having sum(c) > 1) select round(avg(cast(same = n * (n - 1) as int) * 1e0), 6) as consistency, round(avg(same * 1e0 / (n * (n - 1))), 6) as pairwise_agreement from q")(lambda s, d: groups.agreement(observations(s, d), "l_partkey", "l_returnflag"))
query("language_id_accuracy")(lambda s, d: groups.language_identification(observations(s, d), "l_returnflag", "label_pred"))
ORACLE["language_id_accuracy"] = f"{_OBS}, {_CELLS} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1 from s"
query("language_parity", "with m as (select cast(l_linenumber as varchar) as g, avg(l_quantity) as m from lineitem group by 1) select round(min(m) / max(m), 6) as parity, round(max(m) - min(m), 6) as max_gap, round(stddev_samp(m), 6) as sd, arg_min(g, m) as worst from m")(lambda s, d: groups.parity(observations(s, d), "l_linenumber", "l_quantity"))
query("prompt_sensitivity", "with t as (select avg(correct * 1e0) as m from obs group by l_linenumber), e as (select cast(max(correct) <> min(correct) as int) as d from obs group by l_orderkey) select round(max(m) - min(m), 6) as spread, round(stddev_samp(m), 6) as sd, round(min(m), 6) as worst, round(max(m), 6) as best, round(avg(m), 6) as mean, (select round(avg(d * 1e0), 6) from e) as example_disagreement_rate from t".replace("with t as", ", t as"))(lambda s, d: groups.prompt_sensitivity(observations(s, d), "l_linenumber", "l_orderkey", "correct"))
query("truncation_sensitivity", ", a as (select l_linenumber * 100e0 as n, avg(correct * 1e0) as y from obs group by 1) select round(regr_slope(y, log2(n)), 6) as slope, round(arg_min(y, n) - arg_max(y, n), 6) as drop_shortest_to_longest from a")(lambda s, d: groups.truncation_sensitivity(observations(s, d).withColumn("n", F.col("l_linenumber") * 100), "correct", "n"))
query("retrieval_accuracy_by_length", ", a as (select l_linenumber * 1e0 as n, sum(correct * 1e0) as c, count(*) as m from obs group by 1), f as (select min(n) as f from a where c / m < 7e-1) select round(sum(c) / sum(m), 6) as accuracy, max(n) filter (where f is null or n < f) as effective_length, count(*) filter (where c / m >= 7e-1) as passing_lengths from a, f")(lambda s, d: groups.accuracy_by_length(observations(s, d), "correct", "l_linenumber", threshold=0.7))
query("position_accuracy", ", b as (select " + " + ".join(f"cast({k / 5!r}e0 <= position as int)" for k in range(1, 5)) + " as b, avg(correct * 1e0) as m, sum(correct) as c, count(*) as n from obs group by 1) select round(max(m) - min(m), 6) as spread, round(sum(c) * 1e0 / sum(n), 6) as accuracy from b")(lambda s, d: groups.position_accuracy(observations(s, d), "correct", "position"))
query("failure_attribution", "with f as (select case l_partkey % 4 when 0 then 'retrieval' when 1 then 'generation' end as stage from lineitem where l_partkey % 4 < 2), n as (select unnest(['retrieval', 'ranking', 'generation']) as stage) select stage, round(count(f.stage) * 1e0 / (select count(*) from f), 6) as share, count(f.stage) as n from n left join f using (stage) group by 1")(lambda s, d: groups.failure_attribution(observations(s, d).selectExpr("case l_partkey % 4 when 0 then ' Retrieval' when 1 then 'generation' when 2 then 'none' end as stage"), "stage", ["retrieval", "ranking", "generation"]))
query("knowledge_consistency", "with j as (select l_orderkey as o, count(*) as n, count(p_partkey) as h from lineitem left join (select p_partkey from part where p_partkey % 3 = 0) on l_partkey = p_partkey group by 1) select round(sum(h) * 1e0 / sum(n), 6) as micro, round(avg(h * 1e0 / n), 6) as macro from j")(lambda s, d: groups.knowledge_consistency(observations(s, d), "l_orderkey", "l_partkey", s.read.parquet(f"{d}/part.parquet").filter("p_partkey % 3 = 0"), "p_partkey"))
query("context_recall", "with q as (select avg(cast(l_partkey % 3 = 0 as int) * 1e0) as m, sum(cast(l_partkey % 3 = 0 as int)) as h, count(*) as n from lineitem group by l_orderkey) select round(avg(m), 6) as context_recall, round(sum(h) * 1e0 / sum(n), 6) as pooled from q")(lambda s, d: groups.context_recall(observations(s, d).withColumn("ok", F.col("l_partkey") % 3 == 0), "l_orderkey", "ok"))
_TWINS = "select a.vec_id, a.label, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
_COS = "list_cosine_similarity(cast(x as double[]), cast(y as double[]))"
query("embedding_similarity", f"select round(avg({_COS}), 6) as embedding_similarity from ({_TWINS})")(lambda s, d: groups.embedding_similarity(_plain(s, _TWINS, embeddings=s.read.parquet(f"{d}/embeddings.parquet")), "x", "y"))
query("answer_relevance", f"select round(avg(c), 6) as answer_relevance from (select avg({_COS}) as c from ({_TWINS}) group by vec_id // 4)")(lambda s, d: groups.answer_relevance(_plain(s, _TWINS, embeddings=s.read.parquet(f"{d}/embeddings.parquet")).withColumn("a", F.expr("vec_id div 4")), "a", "x", "y"))
query("state_tracking_accuracy", ", t as (select count(*) as n, count(*) filter (where l_returnflag = label_pred) as ok from obs group by l_orderkey) select round(avg(cast(n = ok as int) * 1e0), 6) as joint_goal_accuracy, round(sum(ok) * 1e0 / sum(n), 6) as slot_accuracy from t")(lambda s, d: groups.state_tracking(observations(s, d), "l_orderkey", "l_linenumber", "l_returnflag", "label_pred"))
query("resource_utilization", f"select tool as series, round(max(value), 6) as peak, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95 from ({_CALLS}) group by 1")(lambda s, d: groups.resource_utilization(_calls(s, d), "tool", "value"))
query("judge_agreement", "with j as (select l_quantity as x, l_linenumber as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2e0 as rx, rank() over (order by l_linenumber) + (count(*) over (partition by l_linenumber) - 1) / 2e0 as ry from lineitem), c as (select sum(a.n * b.n) * 1e0 / power((select count(*) from j), 2) as c from (select x, count(*) as n from j group by x) a join (select y, count(*) as n from j group by y) b on a.x = b.y), t as (select corr(x, y) as pearson, corr(rx, ry) as spearman, avg(cast(x = y as int) * 1e0) as o, 1 - avg(power(x - y, 2)) / (avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y)) as quadratic, count(*) as n from j) select round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(o, 6) as raw_agreement, round((o - c) / (1 - c), 6) as cohen_kappa, round(quadratic, 6) as quadratic_kappa, n from t, c")(lambda s, d: groups.judge_agreement(observations(s, d), "l_quantity", "l_linenumber"))
query("tool_selection_accuracy", f"with e as (select task, tool, count(*) as e, count(*) filter (where o % 5 <> 0) as p from ({_CALLS}) group by 1, 2), t as (select min(cast(e = p as int)) as ok from e group by task) select round(avg(ok * 1e0), 6) as tool_selection_accuracy from t")(lambda s, d: groups.tool_selection(_calls(s, d), _calls(s, d).filter("o % 5 <> 0"), "task", "tool"))
query("tool_argument_accuracy", f"with e as (select task, tool, args, count(*) as e, count(*) filter (where o % 5 <> 0) as p from ({_CALLS}) group by 1, 2, 3) select round(sum(least(e, p)) * 1e0 / sum(e), 6) as tool_argument_accuracy from e")(lambda s, d: groups.tool_arguments(_calls(s, d), _calls(s, d).filter("o % 5 <> 0"), "task", "tool", "args"))
query("plan_adherence")(lambda s, d: agents.plan_adherence(_calls(s, d).groupBy("task").agg(*(F.expr(f"transform(sort_array(collect_list(case when {c} then struct(o, tool) end)), x -> x.tool)").alias(k) for k, c in (("plan", "true"), ("done", "o % 5 <> 0")))), "plan", "done"))
query("benchmark_accuracy", "select round(avg(cast(l_partkey % 10 > 0 and l_suppkey % 5 = l_linenumber % 5 as int) * 1e0), 6) as accuracy, count(*) filter (where l_partkey % 10 = 0) as no_answer from lineitem")(lambda s, d: text.benchmark_accuracy(observations(s, d).selectExpr("cast(l_linenumber % 5 as string) as gold", "case when l_partkey % 10 = 0 then 'no idea' when l_partkey % 10 < 5 then concat('first $', l_partkey, ' then ', l_suppkey % 5, '.0 in all') else concat(l_partkey, ' so #### ', l_suppkey % 5, ' of 7') end as output"), "gold", "output"))
_LINES = "array_join(transform(sequence(0, size(split({c}, ' ')) - 1, 40), i -> array_join(slice(split({c}, ' '), i + 1, 40), ' ')), '\n') as {c}"
query("rouge_lsum")(lambda s, d: text.scored(_pairs(s, d).selectExpr("doc_id", _LINES.format(c="reference"), _LINES.format(c="prediction")), text.rouge_lsum, ["precision", "recall", "f1"]).select("doc_id", "precision", "recall", "f1"))
query("accuracy_ci", ", c as (select cast(sum(cast(t = p as int)) as double) as k, cast(count(*) as double) as n from obs), z as (select k, n, k / n as q, 1.959963984540054e0 as z from c) select round(q, 6) as accuracy, round((q + z * z / (2 * n) - z * sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((q + z * z / (2 * n) + z * sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high, cast(n as bigint) as n from z")(lambda s, d: exact_tests.accuracy_interval(observations(s, d), "t", "p"))
query("paired_bootstrap")(lambda s, d: _one(s, exact_tests.paired_bootstrap(observations(s, d), "t", "p", "succeeded")))
_SHARES = {"sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "accuracy": ("tp + tn", "tp + fp + fn + tn"), "prevalence": ("tp + fn", "tp + fp + fn + tn")}
_WILSON = "select metric, round(k / n, 6) as value, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from sh"
query("diagnostic_report")(lambda s, d: classification.diagnostic_report(observations(s, d), "t", "p"))
ORACLE["diagnostic_report"] = f"{_OBS}, c as (select cast(sum(t * p) as double) as tp, cast(sum((1 - t) * p) as double) as fp, cast(sum(t * (1 - p)) as double) as fn, cast(sum((1 - t) * (1 - p)) as double) as tn from obs), sh as ({' union all '.join(f'select {chr(39)}{m}{chr(39)} as metric, {k} as k, {n} as n, 1.959963984540054e0 as z from c' for m, (k, n) in _SHARES.items())}) {_WILSON} union all select 'lr_positive', round(tp * (fp + tn) / (fp * (tp + fn)), 6), round(exp(ln(tp * (fp + tn) / (fp * (tp + fn))) - 1.959963984540054e0 * sqrt(1 / tp - 1 / (tp + fn) + 1 / fp - 1 / (fp + tn))), 6), round(exp(ln(tp * (fp + tn) / (fp * (tp + fn))) + 1.959963984540054e0 * sqrt(1 / tp - 1 / (tp + fn) + 1 / fp - 1 / (fp + tn))), 6) from c union all select 'lr_negative', round(fn * (fp + tn) / (tn * (tp + fn)), 6), round(exp(ln(fn * (fp + tn) / (tn * (tp + fn))) - 1.959963984540054e0 * sqrt(1 / fn - 1 / (tp + fn) + 1 / tn - 1 / (fp + tn))), 6), round(exp(ln(fn * (fp + tn) / (tn * (tp + fn))) + 1.959963984540054e0 * sqrt(1 / fn - 1 / (tp + fn) + 1 / tn - 1 / (fp + tn))), 6) from c union all select 'diagnostic_odds_ratio', round(tp * tn / (fp * fn), 6), round(exp(ln(tp * tn / (fp * fn)) - 1.959963984540054e0 * sqrt(1 / tp + 1 / fp + 1 / fn + 1 / tn)), 6), round(exp(ln(tp * tn / (fp * fn)) + 1.959963984540054e0 * sqrt(1 / tp + 1 / fp + 1 / fn + 1 / tn)), 6) from c union all select 'youden_j', round(tp / (tp + fn) + tn / (tn + fp) - 1, 6), null, null from c"
query("calibration_report")(lambda s, d: classification.calibration_report(_keyed(s, d), "t", "prob", "row_id"))
ORACLE["calibration_report"] = f"{_OBS}, {_BINS}, hl as (select sum(power(o - e, 2) / (e * (1 - e / m))) as x, count(*) - 2 as df from (select g, sum(t) as o, sum(prob) as e, count(*) as m from (select t, prob, ntile(10) over (order by prob, {_BY_KEY}) as g from obs) group by g)) select round(sum(w * abs(observed - predicted)) / sum(w), 6) as expected_calibration_error, round(max(abs(observed - predicted)), 6) as maximum_calibration_error, (select round(avg((prob - t) * (prob - t)), 6) from obs) as brier_score, (select round(avg(prob), 6) from obs) as mean_score, (select round(avg(t * 1e0), 6) from obs) as prevalence, (select round(x, 6) from hl) as hosmer_lemeshow, (select df from hl) as df from bi"
query("mean_average_precision")(lambda s, d: vision.mean_average_precision(*_boxes(s, d)))
