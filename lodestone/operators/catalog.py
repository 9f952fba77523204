"""Metrics that are one aggregate over rows: a catalogue of SQL expressions, any number of which run in one pass."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.patterns import group_percentiles


@dataclass(frozen=True)
class Metric:
    """``sql``: an aggregate in the SQL that Spark and other engines share, over the columns ``needs``; rows must satisfy
    ``valid``; parameters stand as {name} and default to ``params``."""

    category: str
    name: str
    needs: tuple[str, ...]
    sql: str
    valid: str = "true"
    params: tuple[tuple[str, object], ...] = ()
    higher_is_better: bool | None = True

    def expression(self, **params: object) -> str:
        return self.sql.format(**dict(self.params) | params)


class MetricInputError(ValueError):
    """The rows do not meet what the metric needs."""


CATALOG: dict[str, Metric] = {}


def _add(category: str, better: bool | None, rows: str) -> None:
    """One metric a line: name | columns | expression [| condition that every row must meet] [| params]."""
    for line in filter(None, map(str.strip, rows.strip().splitlines())):
        name, needs, sql, *more = map(str.strip, re.split(r" \|(?= )", line))
        valid = more[0] if more and more[0] else "true"
        params = tuple((k, float(v) if "." in v else int(v)) for k, v in (p.split("=") for p in more[1].split())) if len(more) > 1 else ()
        CATALOG[f"{category}.{name}"] = Metric(category, name, tuple(needs.split()), sql, valid, params, better)


_add("classification", True, """
accuracy | t p w | sum(case when t = p then w else 0.0 end) / sum(w)
hamming_loss | t p w | sum(case when t <> p then w else 0.0 end) / sum(w)
""")
_add("clinical", True, """
sensitivity | t p | sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when t = 1 then 1.0 else 0.0 end), 0) | t in (0, 1) and p in (0, 1)
ppv | t p | sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when p = 1 then 1.0 else 0.0 end), 0) | t in (0, 1) and p in (0, 1)
specificity | t p | sum(case when t = 0 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when t = 0 then 1.0 else 0.0 end), 0) | t in (0, 1) and p in (0, 1)
npv | t p | sum(case when t = 0 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when p = 0 then 1.0 else 0.0 end), 0) | t in (0, 1) and p in (0, 1)
lr_positive | t p | (sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when t = 1 then 1.0 else 0.0 end), 0)) / nullif(sum(case when t = 0 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when t = 0 then 1.0 else 0.0 end), 0), 0) | t in (0, 1) and p in (0, 1)
lr_negative | t p | (sum(case when t = 1 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when t = 1 then 1.0 else 0.0 end), 0)) / nullif(sum(case when t = 0 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when t = 0 then 1.0 else 0.0 end), 0), 0) | t in (0, 1) and p in (0, 1)
diagnostic_odds_ratio | t p | sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) * sum(case when t = 0 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when t = 0 and p = 1 then 1.0 else 0.0 end) * sum(case when t = 1 and p = 0 then 1.0 else 0.0 end), 0) | t in (0, 1) and p in (0, 1)
youden_j | t p | sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when t = 1 then 1.0 else 0.0 end), 0) + sum(case when t = 0 and p = 0 then 1.0 else 0.0 end) / nullif(sum(case when t = 0 then 1.0 else 0.0 end), 0) - 1 | t in (0, 1) and p in (0, 1)
net_benefit | t prob | (sum(case when prob >= {threshold} and t = 1 then 1.0 else 0.0 end) - sum(case when prob >= {threshold} and t = 0 then 1.0 else 0.0 end) * {threshold} / (1 - {threshold})) / count(*) | t in (0, 1) and prob between 0 and 1 | threshold=0.3
""")
_add("classification", False, """
log_loss | t prob w | -sum(w * ln(case when t = 1 then least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16) else 1 - least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16) end)) / sum(w) | t in (0, 1) and prob between 0 and 1
brier_score | t prob w | sum(w * (prob - t) * (prob - t)) / sum(w) | t in (0, 1) and prob between 0 and 1
""")
_add("regression", False, """
mae | y yhat w | sum(w * abs(yhat - y)) / sum(w)
mse | y yhat w | sum(w * (yhat - y) * (yhat - y)) / sum(w)
rmse | y yhat w | sqrt(sum(w * (yhat - y) * (yhat - y)) / sum(w))
mape | y yhat w | sum(w * abs(yhat - y) / abs(y)) / sum(w) | y <> 0
smape | y yhat w | sum(w * case when abs(y) + abs(yhat) = 0 then 0.0 else 2 * abs(yhat - y) / (abs(y) + abs(yhat)) end) / sum(w)
msle | y yhat w | sum(w * power(ln(1 + yhat) - ln(1 + y), 2)) / sum(w) | y >= 0 and yhat >= 0
rmsle | y yhat w | sqrt(sum(w * power(ln(1 + yhat) - ln(1 + y), 2)) / sum(w)) | y >= 0 and yhat >= 0
median_absolute_error | y yhat | median(abs(yhat - y))
max_error | y yhat | max(abs(yhat - y))
mean_bias_error | y yhat w | sum(w * (yhat - y)) / sum(w)
quantile_loss | y yhat w | sum(w * greatest({alpha} * (y - yhat), ({alpha} - 1) * (y - yhat))) / sum(w) | | alpha=0.5
huber_loss | y yhat w | sum(w * case when abs(yhat - y) <= {delta} then 0.5 * (yhat - y) * (yhat - y) else {delta} * (abs(yhat - y) - 0.5 * {delta}) end) / sum(w) | | delta=1.0
""")
_add("regression", True, """
r2 | y yhat | 1 - sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(*), 0)
adjusted_r2 | y yhat | 1 - (sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(*), 0)) * (count(*) - 1) / (count(*) - {n_features} - 1) | | n_features=3
explained_variance | y yhat | 1 - var_pop(y - yhat) / nullif(var_pop(y), 0)
rse | y yhat | sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(*), 0)
""")
_add("safety", False, """
harmful_response_rate | harmful | avg(harmful * 1.0) | harmful in (0, 1)
attack_success_rate | succeeded | avg(succeeded * 1.0) | succeeded in (0, 1)
red_team_success_rate | best_attempt | avg(best_attempt * 1.0) | best_attempt in (0, 1)
over_refusal_rate | refused should_refuse | avg(case when should_refuse = 0 then refused * 1.0 end) | refused in (0, 1) and should_refuse in (0, 1)
toxicity_score | max_score | avg(max_score * 1.0) | max_score between 0 and 1
stereotype_preference | stereo anti_stereo | avg(case when stereo > anti_stereo then 1.0 when stereo = anti_stereo then 0.5 else 0.0 end)
policy_violation_rate | n_violations | avg(case when n_violations > 0 then 1.0 else 0.0 end) | n_violations >= 0
exposure | rank_canary space | avg(ln(space) / ln(2) - ln(rank_canary) / ln(2)) | rank_canary >= 1 and space >= rank_canary
""")
_add("safety", True, """
refusal_rate | refused should_refuse | avg(case when should_refuse = 1 then refused * 1.0 end) | refused in (0, 1) and should_refuse in (0, 1)
""")
_add("robustness", True, """
adversarial_robustness | clean noisy | avg(noisy * 1.0) | clean in (0, 1) and noisy in (0, 1)
noise_robustness | clean noisy | avg(clean * 1.0) - avg(noisy * 1.0) | clean in (0, 1) and noisy in (0, 1)
ood_accuracy | correct is_ood | avg(case when is_ood = 1 then correct * 1.0 end) | correct in (0, 1) and is_ood in (0, 1)
recovery_success_rate | failed recovered | avg(case when failed = 1 then recovered * 1.0 end) | failed >= recovered
""")
_add("robustness", False, """
flip_rate | clean noisy | sum(case when clean = 1 and noisy = 0 then 1.0 else 0.0 end) / nullif(sum(clean * 1.0), 0) | clean in (0, 1) and noisy in (0, 1)
invariance_violation_rate | original counterfactual | avg(case when original <> counterfactual then 1.0 else 0.0 end)
contradiction_rate | relation | avg(case when relation = 'contradiction' then 1.0 else 0.0 end) | relation in ('entailment', 'neutral', 'contradiction')
error_rate | status | avg(case when status in ('ok', 'success', '200', 'true') then 0.0 else 1.0 end)
distribution_shift_drop | score is_target | avg(case when is_target = 0 then score * 1.0 end) - avg(case when is_target = 1 then score * 1.0 end)
""")
_add("agents", True, """
task_completion_rate | completed | avg(completed * 1.0) | completed in (0, 1)
tool_use_efficiency | n_calls optimal_calls | avg(case when n_calls = 0 then case when optimal_calls = 0 then 1.0 else 0.0 end else least(1.0, optimal_calls * 1.0 / n_calls) end) | n_calls >= 0 and optimal_calls >= 0
""")
_add("agents", False, """
steps_per_task | steps | avg(steps * 1.0) | steps >= 0
human_intervention_rate | interventions | avg(case when interventions > 0 then 1.0 else 0.0 end) | interventions >= 0
agent_cost_per_task | cost | avg(cost * 1.0) | cost >= 0
cost_per_success | cost completed | sum(cost * 1.0) / nullif(sum(completed), 0) | cost >= 0
""")
_add("multilingual", True, """
language_consistency | expected detected | avg(case when expected = detected then 1.0 else 0.0 end)
code_switching_robustness | mono switched | avg(mono * 1.0) - avg(switched * 1.0) | mono in (0, 1) and switched in (0, 1)
cultural_appropriateness | rating | avg((rating - {lo}) * 1.0 / ({hi} - {lo})) | | lo=1 hi=5
""")
_add("code", True, """
execution_success_rate | outcome | avg(case when outcome in ('passed', 'ok', 'true') then 1.0 else 0.0 end)
coverage_rate | covered total | sum(covered * 1.0) / nullif(sum(total), 0) | covered between 0 and total
patch_acceptance_rate | fails_before passes_after | avg(case when fails_before = 1 and passes_after = 1 then 1.0 else 0.0 end)
resolved_rate | f2p_passed f2p p2p_passed p2p | avg(case when f2p_passed = f2p and p2p_passed = p2p then 1.0 else 0.0 end)
unit_test_pass_rate | passed tests | avg(passed * 1.0 / tests) | tests > 0 and passed between 0 and tests
""")
_add("code", False, """
static_analysis_violation_rate | violations lines | 1000.0 * sum(violations) / nullif(sum(lines), 0) | violations >= 0 and lines > 0
security_vulnerability_rate | max_severity | avg(case when max_severity >= {least} then 1.0 else 0.0 end) | | least=1
runtime_efficiency | time reference | avg(time / reference) | time > 0 and reference > 0
""")
_add("long_context", True, """
lost_in_the_middle | correct position | (avg(case when position <= 0.2 then correct * 1.0 end) + avg(case when position >= 0.8 then correct * 1.0 end)) / 2 - avg(case when position > 0.2 and position < 0.8 then correct * 1.0 end) | position between 0 and 1
citation_coverage | cited statements | sum(cited * 1.0) / nullif(sum(statements), 0) | cited between 0 and statements
context_utilization | used provided | sum(used * 1.0) / nullif(sum(provided), 0) | used between 0 and provided
summary_coverage | covered_weight total_weight | avg(covered_weight / total_weight) | total_weight > 0
compression_ratio | source_words summary_words | avg(source_words * 1.0 / summary_words) | summary_words > 0
""")
_add("efficiency", None, """
time_to_first_token | request first | avg(first - request) | first >= request
time_per_output_token | first finish tokens | avg(case when tokens > 1 then (finish - first) / (tokens - 1) end) | finish >= first
latency_percentiles | latency | quantile(latency, {q}) | latency >= 0 | q=0.95
throughput | tokens request finish | sum(tokens) / nullif(max(finish) - min(request), 0)
token_usage | tokens_in tokens_out | avg((tokens_in + tokens_out) * 1.0) | tokens_in >= 0 and tokens_out >= 0
inference_cost | tokens_in tokens_out | avg((tokens_in * {price_in} + tokens_out * {price_out}) / 1000000.0) | | price_in=2.5 price_out=10.0
requests_per_second | finish | (count(*) - 1) / nullif(max(finish) - min(finish), 0)
availability | status | avg(case when status in ('ok', 'true', '200') then 1.0 else 0.0 end)
""")
_add("rag", True, """
task_success_rate | success | avg(success * 1.0) | success in (0, 1)
abstention_accuracy | should did | avg(case when should = did then 1.0 else 0.0 end)
answer_correctness | tp fp fn | avg(case when tp + fp + fn = 0 then 1.0 else tp / (tp + 0.5 * (fp + fn)) end) | tp >= 0 and fp >= 0 and fn >= 0
faithfulness | supported claims | avg(case when claims > 0 then supported * 1.0 / claims end) | supported between 0 and claims
hallucination_rate | supported claims | 1 - sum(supported * 1.0) / nullif(sum(claims), 0) | supported between 0 and claims
groundedness | support | avg(support) | support between 0 and 1
citation_recall | supported_cited claims | avg(case when claims > 0 then supported_cited * 1.0 / claims end)
citation_precision | relevant_citations citations | avg(case when citations > 0 then relevant_citations * 1.0 / citations end)
claim_verification_accuracy | gold verdict | avg(case when gold = verdict then 1.0 else 0.0 end)
""")
_add("structured", True, """
api_call_success_rate | code | avg(case when code between 100 and 399 then 1.0 else 0.0 end)
instruction_compliance_rate | passed checks | avg(case when passed = checks then 1.0 else 0.0 end) | passed between 0 and checks
constraint_satisfaction_rate | passed checks | sum(passed * 1.0) / nullif(sum(checks), 0) | passed between 0 and checks
instruction_retention | turn passed checks | sum(case when turn > 0 then passed * 1.0 end) / nullif(sum(case when turn > 0 then checks end), 0)
""")
_add("judge", True, """
win_rate | outcome | avg(outcome * 1.0) | outcome in (0, 0.5, 1)
position_consistency | verdict swapped | avg(case when verdict = swapped then 1.0 else 0.0 end)
verbosity_bias | a_wins length_a length_b | sum(case when (a_wins = 1 and length_a > length_b) or (a_wins = 0 and length_b > length_a) then 1.0 else 0.0 end) / nullif(sum(case when length_a <> length_b then 1.0 else 0.0 end), 0)
self_preference_bias | judge_own human_own | avg(judge_own * 1.0) - avg(human_own * 1.0)
rubric_score | rating | avg((rating - {lo}) * 1.0 / ({hi} - {lo})) | | lo=1 hi=5
""")
_add("language_model", False, """
cross_entropy | logprob | -avg(logprob) | logprob <= 0
perplexity | logprob | exp(-avg(logprob)) | logprob <= 0
""")


_QUANTILE = re.compile(r"(?:median\((?P<value>.+)\)|quantile\((?P<of>.+), (?P<share>[0-9.]+)\))")

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def for_spark(sql: str) -> str:
    """The expression for Spark: its exact quantile with linear interpolation is ``percentile``, and literals are doubles."""
    return _DECIMAL.sub(r"\1D", sql).replace("quantile(", "percentile(")


def evaluate(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), digits: int | None = None, strict: bool = True, **params: object) -> DataFrame:
    """One row (for each group of ``by``) with a column for each metric, all in one pass with partial aggregation; medians and
    quantiles are found by ranges of values, one by one.

    ``strict``: raise MetricInputError if any row lacks a value that a metric needs or breaks its condition; the counts come
    from one aggregate before. Otherwise such rows are the caller's. A metric without rows is null.
    """
    chosen = [CATALOG[m] for m in metrics]
    if strict:
        bad = df.agg(*(F.count_if(F.expr(" or ".join([*(f"{c} is null" for c in m.needs), f"not ({for_spark(m.valid.format(**dict(m.params) | params))})"]))).alias(m.name) for m in chosen)).first()
        failed = [f"{m.category}.{m.name}: {bad[m.name]} rows" for m in chosen if bad[m.name]]
        if failed:
            raise MetricInputError("; ".join(failed))
    rounded = lambda c: F.round(c, digits) if digits is not None else c
    placed = {m.name: found for m in chosen if (found := _QUANTILE.fullmatch(m.expression(**params)))}
    plain = [m for m in chosen if m.name not in placed]
    out = df.groupBy(*by).agg(*(rounded(F.expr(for_spark(m.expression(**params))).cast("double")).alias(m.name) for m in plain)) if plain or not placed else None
    for name, found in placed.items():
        share = group_percentiles(df, F.expr(for_spark(found["value"] or found["of"])), {name: float(found["share"] or 0.5)}, by).withColumn(name, rounded(F.col(name)))
        if out is None:
            out = share
        elif by:
            joined = out.join(share, [out[c].eqNullSafe(share[c]) for c in by])
            out = joined.select(*(out[c] for c in out.columns), share[name])
        else:
            out = out.crossJoin(share)  # a row each
    return out.select(*by, *(m.name for m in chosen))


def list_metrics(category: str | None = None) -> list[str]:
    return sorted(k for k, m in CATALOG.items() if category in (None, m.category))
