"""Plans by ranges against sorts of all rows, with most rows in one group."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import agents, classification, groups, multiclass, statistics
from lodestone.plans import patterns as pt


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 30), rng.choice([None, rng.randint(0, 9) / 4])) for i in range(400)]
    return made, spark.createDataFrame(made, "id long, g string, k int, v double").repartition(4)


def test_running_sums_and_extremes(rows):
    made, df = rows
    ranges = pt.dealt(df, ["g", "k", "id"], 7)
    assert ranges.select("__range").distinct().count() > 3
    sums = {r["id"]: r for r in pt.running_by(ranges, ["k", "id"], {"n": F.lit(1), "k": F.col("k")}, ["g"]).collect()}
    tops = {r["id"]: r for r in pt.running_extreme(ranges, ["k", "id"], {"up": (F.col("id"), "max", False), "down": (F.col("id"), "min", True)}, ["g"]).collect()}
    for g in ("hot", "a", "b"):
        line = sorted((k, i) for i, h, k, _ in made if h == g)
        for n, (_, i) in enumerate(line):
            assert (sums[i]["cum_n"], sums[i]["all_n"], sums[i]["cum_k"]) == (n + 1, len(line), sum(k for k, _ in line[: n + 1]))
            assert (tops[i]["up"], tops[i]["down"]) == (max(j for _, j in line[: n + 1]), min(j for _, j in line[n:]))


def test_split_join(spark, rows, monkeypatch):
    made, df = rows
    monkeypatch.setattr(pt, "HEAVY", 3)
    table = spark.createDataFrame([("hot", 1, sum(r[1] == "hot" for r in made)), ("a", 2, sum(r[1] == "a" for r in made))], "g string, x int, n long")
    got = pt.split_join(df, table, ["g"], "n", len(made), how="left").collect()
    assert len(got) == len(made) and all(r["x"] == {"hot": 1, "a": 2}.get(r["g"]) for r in got)
    assert pt.split_join(df, table, ["g"], "n", len(made)).count() == sum(r[1] != "b" for r in made)


def test_percentiles(rows):
    made, df = rows
    got = {r["g"]: r for r in pt.group_percentiles(df, F.col("v"), {"m": 0.5, "q": 0.95, "low": 0.0}, ["g"]).collect()}
    for g in ("hot", "a", "b"):
        v = [r[3] for r in made if r[1] == g and r[3] is not None]
        assert (got[g]["m"], got[g]["q"], got[g]["low"]) == tuple(pytest.approx(np.quantile(v, q)) for q in (0.5, 0.95, 0))
    assert pt.group_percentiles(df.filter("v is null"), F.col("v"), {"m": 0.5}).first()["m"] is None
    assert {r["m"] for r in pt.group_percentiles(df.filter("v is null"), F.col("v"), {"m": 0.5}, ["g"]).collect()} == {None}
    assert {r["series"] for r in groups.resource_utilization(df.withColumn("g", F.when(F.col("g") != "a", F.col("g"))), "g", "v").collect()} == {"hot", "b", None}


def test_energy_over_ranges(spark):
    t = sorted(random.Random(2).sample(range(1000), 200))
    p = [float(x % 17) for x in t]
    df = spark.createDataFrame(list(zip(t, p, strict=True)), "t long, w double").repartition(5)
    assert agents.energy(df, "t", "w").first()[0] == pytest.approx(np.trapezoid(p, t))
    assert agents.energy(df.limit(1), "t", "w").first()[0] is None and agents.energy(df.limit(0), "t", "w").first()[0] is None


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_adjusted_p_values(spark, n):
    rng = random.Random(n)
    p = [rng.choice([rng.random() ** 3, 0.01]) for _ in range(n)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9999, None)], "k long, p double").repartition(3)
    got = {r["k"]: r for r in statistics.adjust_pvalues(df, "k", "p").collect()}
    order = sorted(range(n), key=lambda i: (p[i], i))
    top, want = 0.0, {}
    for rank, i in enumerate(order, 1):
        top = max(top, (n - rank + 1) * p[i])
        want[i] = [min(1, p[i] * n), min(1, top)]
    low, share = np.inf, np.inf
    for rank in range(n, 0, -1):
        i = order[rank - 1]
        low, share = min(low, (n - rank + 1) * p[i]), min(share, p[i] * n / rank)
        want[i] += [min(1, low), min(1, share), min(1, share * sum(1 / k for k in range(1, n + 1)))]
    assert {i: [got[i][c] for c in ("bonferroni", "holm", "hochberg", "bh", "by")] for i in range(n)} == {i: pytest.approx(v) for i, v in want.items()}
    assert got[9999]["holm"] is None and len(got) == n + 1


def test_agreement_of_scores(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(80)] + [(None, 3), (2, None)]
    got = groups.judge_agreement(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    x, y = (np.array([p[k] for p in pairs if None not in p], dtype=float) for k in (0, 1))
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    o = (x == y).mean()
    e = sum((x == v).mean() * (y == v).mean() for v in range(1, 6))
    quad = 1 - ((x - y) ** 2).mean() / np.mean([(u - v) ** 2 for u in x for v in y])
    assert tuple(got) == tuple(pytest.approx(v) for v in (np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1], o, (o - e) / (1 - e), quad, 80))
    assert groups.judge_agreement(spark.createDataFrame([(None, 1)], "a int, b int"), "a", "b").first()["n"] == 0


def test_multiclass_scores(spark):
    rng = random.Random(5)
    made = [(rng.choice("aab c".split()[0] + "bc"), *(rng.randint(0, 8) / 8 for _ in range(3)), rng.randint(1, 3)) for _ in range(120)]
    df = spark.createDataFrame([*made, (None, 0.1, 0.2, 0.3, 1), ("a", None, 0.2, 0.3, 1), ("other", 0.1, 0.2, 0.3, 1)], "t string, x double, y double, z double, w int").repartition(3)
    probs = dict(zip("abc", "xyz", strict=True))

    def auc(pos, neg):
        total = sum(w for _, w in pos) * sum(w for _, w in neg)
        return sum(u * v * ((a > b) + (a == b) / 2) for a, u in pos for b, v in neg) / total

    one, two, ap = {}, [], {}
    for i, c in enumerate("abc", 1):
        pos, neg = ([(r[i], r[4]) for r in made if (r[0] == c) == side] for side in (True, False))
        one[c] = auc(pos, neg)
        all_pos, last = sum(w for _, w in pos), 0.0
        ap[c] = 0.0
        for cut in sorted({r[i] for r in made}, reverse=True):
            tp, fp = (sum(w for s, w in side if s >= cut) for side in (pos, neg))
            ap[c] += (tp - last) / all_pos * tp / (tp + fp)
            last = tp
        two += [auc(pos, [(r[i], r[4]) for r in made if r[0] == o]) for o in "abc" if o != c]
    got = multiclass.multiclass_scores(df, "t", probs, weight="w").first()
    w = np.array([r[4] for r in made], dtype=float)
    support = np.array([sum(r[4] for r in made if r[0] == c) for c in "abc"])
    assert got["roc_auc_macro"] == pytest.approx(np.mean(list(one.values()))) and got["roc_auc_weighted"] == pytest.approx(np.average(list(one.values()), weights=support))
    assert got["roc_auc_one_vs_one"] == pytest.approx(np.mean(two)) and got["average_precision_macro"] == pytest.approx(np.mean(list(ap.values())))
    own = np.array([np.clip(r["abc".index(r[0]) + 1], multiclass.EPSILON, 1 - multiclass.EPSILON) for r in made])
    assert got["log_loss"] == pytest.approx(np.average(-np.log(own), weights=w))
    brier = [sum((r[i] - (r[0] == c)) ** 2 for i, c in enumerate("abc", 1)) for r in made]
    assert got["brier_score"] == pytest.approx(np.average(brier, weights=w))
    assert multiclass.class_areas(df.filter("t = 'a'"), "t", probs).filter("roc_auc is not null").isEmpty()
    assert multiclass.multiclass_scores(df.limit(0), "t", probs).first()["log_loss"] is None


def test_intervals_of_ratios(spark):
    df = spark.createDataFrame([(1, 1)] * 40 + [(1, 0)] * 10 + [(0, 1)] * 5 + [(0, 0)] * 45, "t int, p int")
    got = {r["metric"]: r for r in classification.diagnostic_report(df, "t", "p").collect()}
    sd = np.sqrt(1 / 40 - 1 / 50 + 1 / 5 - 1 / 50)
    assert (got["lr_positive"]["low"], got["lr_positive"]["high"]) == (pytest.approx(8 * np.exp(-1.959963984540054 * sd)), pytest.approx(8 * np.exp(1.959963984540054 * sd)))
    none = {r["metric"]: r for r in classification.diagnostic_report(df.filter("p = 1"), "t", "p").collect()}
    assert none["diagnostic_odds_ratio"]["low"] is None and none["sensitivity"]["value"] == 1.0


def test_calibration_report_with_fit(spark):
    rng = random.Random(1)
    made = [(i, int(rng.random() < 0.2 + 0.5 * (k := rng.randint(1, 19) / 20)), k) for i in range(600)]
    df = spark.createDataFrame(made, "id long, t int, s double")
    got = classification.calibration_report(df, "t", "s", "id", fit=True).first()
    assert (got["intercept"], got["slope"]) == pytest.approx(classification.calibration_line(df, "t", "s"))
    x, y = (np.array(v, dtype=float) for v in ([np.log(r[2] / (1 - r[2])) for r in made], [r[1] for r in made]))
    rest = y - 1 / (1 + np.exp(-(got["intercept"] + got["slope"] * x)))
    assert abs(rest.sum()) < 1e-6 and abs((rest * x).sum()) < 1e-6  # the fit's own equations
    assert abs((y - 1 / (1 + np.exp(-(got["intercept_at_slope_one"] + x)))).sum()) < 1e-6
    assert 0 <= got["hosmer_lemeshow_p"] <= 1
