"""Replicates, intervals and comparisons against loops over rows with the same weights."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import resampling as rs
from lodestone.operators.exact_tests import accelerated_bounds


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [(i, rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1), rng.uniform(0, 9), rng.choice([None, rng.uniform(0, 9)])) for i in range(150)]
    df = spark.createDataFrame(made, "id long, g string, t int, p int, q int, y double, yhat double").repartition(5)
    return made, df


def weights(df, replicates, seed):
    found = df.select("id", F.xxhash64("id", F.lit(seed)).alias("h")).collect()
    w = rs.poisson_weights(np.array([r["h"] for r in found]).view(np.uint64), 0, replicates, seed)
    return {r["id"]: w[i] for i, r in enumerate(found)}


def test_weights_are_poisson():
    w = rs.poisson_weights(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64), 0, 50, 3).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    for k in range(4):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


METRICS = {"rmse": "sqrt(sum(power(yhat - y, 2)) / count(yhat))", "mean": "avg(yhat)", "spread": "var_pop(y)", "low": "min(y)", "high": "max(y)", "sens": "sum(case when t = 1 and p = 1 then 1.0 else 0.0 end) / nullif(sum(case when t = 1 then 1.0 else 0.0 end), 0)"}


def metric_of(some, w):
    n = sum(w)
    known = [(r, k) for r, k in zip(some, w, strict=True) if r[6] is not None]
    m = sum(k for _, k in known)
    mean = sum(r[5] * k for r, k in zip(some, w, strict=True)) / n
    drawn = [r[5] for r, k in zip(some, w, strict=True) if k > 0]
    pos = sum(k for r, k in zip(some, w, strict=True) if r[2] == 1)
    return {
        "rmse": math.sqrt(sum(k * (r[6] - r[5]) ** 2 for r, k in known) / m), "mean": sum(k * r[6] for r, k in known) / m,
        "spread": sum(k * (r[5] - mean) ** 2 for r, k in zip(some, w, strict=True)) / n, "low": min(drawn), "high": max(drawn),
        "sens": sum(k for r, k in zip(some, w, strict=True) if r[2] == 1 and r[3] == 1) / pos,
    }


def test_replicates_equal_loops(rows):
    made, df = rows
    w = weights(df, 100, 7)
    got = {(r["g"], r["kind"], r["k"]): r for r in rs.replicated(df, METRICS, ["id"], by=("g",), replicates=100, blocks=6).collect()}
    again = {(r["g"], r["kind"], r["k"]): r for r in rs.replicated(df.repartition(2, "y"), METRICS, ["id"], by=("g",), replicates=100, blocks=6).collect()}
    assert len(got) == 2 * 107
    for g in "ab":
        mine = [r for r in made if r[1] == g]
        for kind, k, ws in [("whole", 106, [1] * len(mine)), *(("replicate", k, [float(w[r[0]][k]) for r in mine]) for k in range(100))]:
            scale = len(mine) / sum(ws)
            want = metric_of(mine, [x * scale for x in ws])
            for name, v in want.items():
                assert got[g, kind, k][name] == pytest.approx(v, rel=1e-9), (name, kind, k)
                assert again[g, kind, k][name] == pytest.approx(v, rel=1e-9)
    without = [r for r in got.values() if r["kind"] == "without" and r["g"] == "a"]
    whole = got["a", "whole", 106]
    assert sum(r["high"] < whole["high"] for r in without) == 1 and all(r["low"] >= whole["low"] for r in without)


def test_strata_keep_their_sizes(rows):
    made, df = rows
    w = weights(df, 100, 7)
    got = {r["k"]: r["share"] for r in rs.replicated(df, {"share": "sum(case when t = 1 then 1.0 else 0.0 end) / count(*)", "hit": "avg(case when t = p then 1.0 else 0.0 end)"}, ["id"], strata="t", replicates=100).filter("kind = 'replicate'").collect()}
    assert all(v == pytest.approx(sum(r[2] for r in made) / len(made)) for v in got.values())
    hit = {r["k"]: r["hit"] for r in rs.replicated(df, {"hit": "avg(case when t = p then 1.0 else 0.0 end)"}, ["id"], strata="t", replicates=100).filter("kind = 'replicate'").collect()}
    for k in range(100):
        total = 0.0
        for t in (0, 1):
            mine = [r for r in made if r[2] == t]
            total += len(mine) * sum(float(w[r[0]][k]) for r in mine if r[3] == t) / sum(float(w[r[0]][k]) for r in mine)
        assert hit[k] == pytest.approx(total / len(made))


@pytest.mark.parametrize("method", ["bca", "percentile", "basic"])
def test_intervals(rows, method):
    made, df = rows
    got = rs.bootstrap_intervals(df, ["regression.rmse", "clinical.sensitivity"], ["id"], replicates=300, blocks=10, method=method).collect()
    values = rs.replicated(df.withColumn("w", F.lit(1.0)), {"a": rs._sql("regression.rmse", {}), "b": rs._sql("clinical.sensitivity", {})}, ["id"], replicates=300, blocks=10).toPandas()
    for r, c in zip(got, "ab", strict=True):
        whole = values.loc[values["kind"] == "whole", c].iloc[0]
        own, rest = (values.loc[values["kind"] == k, c].to_numpy() for k in ("replicate", "without"))
        low, high = np.quantile(own, [0.025, 0.975])
        want = {"bca": accelerated_bounds(own, whole, rest), "percentile": (low, high), "basic": (2 * whole - high, 2 * whole - low)}[method]
        assert (r["estimate"], r["low"], r["high"], r["failed"]) == (pytest.approx(whole), pytest.approx(want[0]), pytest.approx(want[1]), 0)
        assert r["low"] < r["estimate"] < r["high"]


def test_undefined_metrics_have_no_bounds_and_quantiles_are_refused(spark, rows):
    _, df = rows
    none = rs.bootstrap_intervals(df.filter("t = 0"), ["clinical.sensitivity"], ["id"], replicates=100).first()
    assert none["estimate"] is None and none["low"] is None and none["failed"] == 100
    assert rs.bootstrap_intervals(df.limit(0), ["clinical.sensitivity"], ["id"], replicates=100).collect() == []
    with pytest.raises(ValueError, match="median"):
        rs.bootstrap_intervals(df, ["regression.median_absolute_error"], ["id"])


def test_paired_and_comparison(rows):
    _, df = rows
    a, b = rs.of_model("clinical.youden_j", {}), rs.of_model("clinical.youden_j", {"p": "q"})
    for side in ("two-sided", "greater", "less"):
        got = rs.paired_bootstrap_test(df, a, b, ["id"], replicates=200, alternative=side).first()
        v = rs.replicated(df, {"a": a, "b": b}, ["id"], replicates=200, blocks=2).toPandas()
        seen = got["metric_a"] - got["metric_b"]
        d = (v["a"] - v["b"])[v["kind"] == "replicate"].to_numpy() - seen
        extreme = {"two-sided": abs(d) >= abs(seen), "greater": d >= seen, "less": d <= seen}[side].sum()
        assert got["difference"] == pytest.approx(seen) and got["p_value"] == pytest.approx((1 + extreme) / 201)
    estimates, tests = rs.compare_models(df, {"x": {}, "y": {"p": "q"}, "z": {"p": "t"}}, ["classification.accuracy", "clinical.youden_j"], ["id"], replicates=200, scores={"x": "y", "y": "id"})
    assert {(r["metric"], r["model"]) for r in estimates.collect()} == {(m, k) for m in ("classification.accuracy", "clinical.youden_j") for k in "xyz"}
    told = {(r["metric"], r["model_a"], r["model_b"]): r for r in tests.collect()}
    assert len(told) == 7 and {r["test"] for k, r in told.items() if k[0] == "classification.accuracy"} == {"mcnemar"} and told["roc_auc", "x", "y"]["test"] == "delong"
    assert all(r["p_adjusted"] >= r["p_value"] for r in told.values()) and told["classification.accuracy", "x", "z"]["significant"]


def test_macro_f1(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "b")] * 10
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, t string, p string")
    got = rs.bootstrap_intervals(df, {"f": rs.macro_f1("t", "p", ("a", "b", "c"))}, ["id"], replicates=100, method="percentile").first()
    assert got["estimate"] == pytest.approx((2 * 1 / 4 + 2 * 2 / 5 + 0) / 3)
