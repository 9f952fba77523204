from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from lodestone.operators import exact_tests


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


def test_shapiro_wilk_published_example(spark):
    got = exact_tests.shapiro_wilk(column(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236, None]), "v")
    assert got["statistic"] == pytest.approx(0.788814694835387, abs=1e-6)
    assert got["p_value"] == pytest.approx(0.006703814, abs=1e-6)


def test_shapiro_wilk_three_values_ties_and_refusals(spark):
    assert exact_tests.shapiro_wilk(column(spark, [1, 2, 3]), "v") == {"statistic": pytest.approx(1.0), "p_value": pytest.approx(1.0, abs=1e-6), "n": 3}
    tied = exact_tests.shapiro_wilk(column(spark, [1, 1, 1, 2, 2, 3, 3, 3, 3, 4, 5, 5, 9]), "v")
    assert 0 < tied["statistic"] < 1 and 0 < tied["p_value"] < 1
    for bad in ([], [1, 2], [4, 4, 4, 4]):
        with pytest.raises(ValueError, match="three values"):
            exact_tests.shapiro_wilk(column(spark, bad), "v")


def test_fisher_by_enumeration(spark):
    assert exact_tests.fisher_exact_p(8, 2, 1, 5) == pytest.approx(0.034965034965)
    total = math.comb(16, 10)
    assert exact_tests.fisher_exact_p(8, 2, 1, 5, "greater") == pytest.approx(sum(math.comb(9, k) * math.comb(7, 10 - k) for k in (8, 9)) / total)
    assert exact_tests.fisher_exact_p(0, 3, 0, 4) == 1.0
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (None, 1)], "r int, c int")
    assert exact_tests.two_by_two(rows, "r", "c").first().asDict() == {"a": 1, "b": 1, "c": 1, "d": 1, "odds_ratio": 1.0}


def test_mann_whitney_exact_by_all_orders(spark):
    a, b = [19, 22, 16, 29, 24], [20, 11, 17, 12]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    got = exact_tests.mann_whitney_test(df, "v", "g", "a", "b")
    u = lambda x, y: sum(p > q for p in x for q in y)
    every = [u(c, [v for v in a + b if v not in c]) for c in itertools.combinations(a + b, len(a))]
    assert got["statistic"] == u(a, b)
    assert got["p_value"] == pytest.approx(2 * sum(v >= u(a, b) for v in every) / len(every))


def test_wilcoxon_exact_by_all_signs(spark):
    d = [6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56]
    got = exact_tests.wilcoxon_test(spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double"), "a", "b")
    sums = [sum(r for r, s in zip(range(1, 13), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=12)]
    assert got["statistic"] == 10
    assert got["p_value"] == pytest.approx(2 * sum(v <= 10 for v in sums) / len(sums))


def test_proportion_intervals():
    assert exact_tests.proportion_interval(0, 10, method="clopper-pearson") == (0.0, pytest.approx(1 - 0.025**0.1))
    low, high = exact_tests.proportion_interval(5, 10)
    assert low + high == pytest.approx(1) and low == pytest.approx(0.2365931)
    with pytest.raises(ValueError, match="needed"):
        exact_tests.proportion_interval(1, 0)


def test_delong_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), round(rng.random(), 1), round(rng.random(), 1)) for _ in range(120)]
    got = exact_tests.delong_test(spark.createDataFrame(rows, "t int, a double, b double"), "t", "a", "b")
    pos, neg = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    wins = lambda i: np.array([[(p[i] > q[i]) + (p[i] == q[i]) / 2 for q in neg] for p in pos])
    d = wins(1) - wins(2)
    assert got["auc_a"] == pytest.approx(wins(1).mean())
    assert got["z"] == pytest.approx(d.mean() / math.sqrt(d.mean(1).var(ddof=1) / len(pos) + d.mean(0).var(ddof=1) / len(neg)))


def test_comparison_and_accelerated_bounds(spark):
    rng = random.Random(2)
    rows = [(t, t if rng.random() < 0.9 else 1 - t, t if rng.random() < 0.6 else 1 - t) for t in (rng.randint(0, 1) for _ in range(300))]
    df = spark.createDataFrame(rows, "t int, good int, poor int")
    got = {r["model"]: r for r in exact_tests.compare(df, "t", {"good": "good", "poor": "poor"}, baseline="good").collect()}
    assert got["good"]["p_value"] is None and got["poor"]["p_adjusted"] < 1e-6
    assert got["poor"]["estimate"] == pytest.approx(sum(t == p for t, _, p in rows) / 300)
    found = exact_tests.bootstrap_accuracy_bca(df, "t", "good")
    assert found["low"] < found["estimate"] < found["high"]
    assert exact_tests.accelerated_bounds([1.0, 2.0, 3.0], 9.0, [1.0, 2.0]) == (pytest.approx(1.05), pytest.approx(2.95))
