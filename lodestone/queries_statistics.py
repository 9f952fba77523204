"""Registered queries of resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import classification, multiclass, resampling, statistics
from lodestone.queries import _keyed, _PVALUES, observations, query, view

#: Columns that tell line items apart.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_MODELS = {"first": {}, "second": {"p": "succeeded"}, "third": {"p": "harmful"}}

query("bootstrap_intervals")(lambda s, d: resampling.bootstrap_intervals(observations(s, d), ["regression.rmse", "regression.r2", "regression.max_error", "clinical.sensitivity", "classification.brier_score"], LINE, by=("l_returnflag",), strata="t", replicates=400))
query("bootstrap_macro_f1")(lambda s, d: resampling.bootstrap_intervals(observations(s, d), {"macro_f1": resampling.macro_f1("l_returnflag", "label_pred", ("A", "N", "R"))}, LINE, replicates=400))
query("paired_bootstrap_metric")(lambda s, d: resampling.paired_bootstrap_test(observations(s, d), resampling.of_model("clinical.youden_j", {}), resampling.of_model("clinical.youden_j", {"p": "succeeded"}), LINE, replicates=400))
query("compare_estimates")(lambda s, d: resampling.compare_models(observations(s, d).drop("w"), _MODELS, ["classification.accuracy", "clinical.youden_j", "clinical.ppv"], LINE, replicates=400)[0])
query("compare_tests")(lambda s, d: resampling.compare_models(observations(s, d).drop("w"), _MODELS, ["classification.accuracy", "clinical.youden_j", "clinical.ppv"], LINE, replicates=400, baseline="first")[1])


_PROBS = {"A": "pa", "N": "pn", "R": "pr"}
_CLASSES = ", ".join(f"(case when label_pred = '{v}' then 5e-1 else 1e-1 end + (l_partkey * 7 + l_suppkey * {k + 3}) % 50 / 1e2) / 145e-2 as {c}" for k, (v, c) in enumerate(_PROBS.items()))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return observations(s, d).selectExpr("l_returnflag as label", "l_quantity as weight", *_CLASSES.split(", "))


_LONG = f"k as (select l_returnflag as label, l_quantity as weight, {_CLASSES} from obs), l as (" + " union all ".join(f"select '{v}' as c, {c} as score, cast(label = '{v}' as int) as y, label, weight as w from k" for v, c in _PROBS.items()) + ")"
_AREA = "{n} as (select {g}, sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) as auc, sum(pos * cp / (cp + cn)) / sum(pos) as ap, sum(pos) as support from (select *, sum(pos) over (partition by {g} order by score desc) as cp, sum(neg) over (partition by {g} order by score desc) as cn from (select {g}, score, sum(w * y) as pos, sum(w * (1 - y)) as neg from {t} group by {g}, score)) group by {g})"
_WITH = f", {_LONG}, {_AREA.format(n='ar', g='c', t='l')}"
query("class_areas", f"{_WITH} select c as label, round(auc, 6) as roc_auc, round(ap, 6) as average_precision, round(support, 6) as support from ar")(lambda s, d: multiclass.class_areas(_classes(s, d), "label", _PROBS, weight="weight"))
_PAIRS2 = "pr as (select l.*, o.o from l join (values ('A'), ('N'), ('R')) o(o) on o.o <> l.c and l.label in (l.c, o.o))"
_EPS = "least(greatest({c}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
_LOSS = "sum(weight * -ln(case label " + " ".join(f"when '{v}' then {_EPS.format(c=c)}" for v, c in _PROBS.items()) + " end)) / sum(weight)"
_BRIER = "sum(weight * (" + " + ".join(f"power({c} - cast(label = '{v}' as int), 2)" for v, c in _PROBS.items()) + ")) / sum(weight)"
query("multiclass_scores", f"{_WITH}, {_PAIRS2}, {_AREA.format(n='ov', g='c, o', t='pr')}, one as (select *, 0 as z from l), {_AREA.format(n='mi', g='z', t='one')}, e as (select {_LOSS} as a, {_BRIER} as b from k) select round(avg(auc), 6) as roc_auc_macro, round(sum(auc * support) / sum(support), 6) as roc_auc_weighted, round((select avg(auc) from ov), 6) as roc_auc_one_vs_one, round(avg(ap), 6) as average_precision_macro, round(sum(ap * support) / sum(support), 6) as average_precision_weighted, round((select ap from mi), 6) as average_precision_micro, round((select a from e), 6) as log_loss, round((select b from e), 6) as brier_score from ar")(lambda s, d: multiclass.multiclass_scores(_classes(s, d), "label", _PROBS, weight="weight"))


@query("adjust_pvalues_one_family", f"with x as (select *, count(*) over () as n, row_number() over (order by p, k) as i from ({_PVALUES})) select k, round(p, 6) as p, round(least(1e0, p * n), 6) as bonferroni, round(least(1e0, max((n - i + 1) * p) over (order by p, k)), 6) as holm, round(least(1e0, min((n - i + 1) * p) over (order by p desc, k desc)), 6) as hochberg, round(least(1e0, min(p * n / i) over (order by p desc, k desc)), 6) as bh, round(least(1e0, list_sum(list_transform(range(1, n + 1), lambda j: 1e0 / j)) * min(p * n / i) over (order by p desc, k desc)), 6) as \"by\" from x")
def _(spark, d):  # noqa: ANN001, ANN202
    view(spark, d, "supplier")
    return statistics.adjust_pvalues(spark.sql(_PVALUES).drop("family"), "k", "p")


query("calibration_report_fit")(lambda s, d: classification.calibration_report(_keyed(s, d), "t", "prob", "row_id", fit=True))
