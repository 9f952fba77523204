"""Selective prediction, group metrics, answers and detection against hand-made or brute-force results."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.operators import agents, classification, exact_tests, groups, selective, text, vision


def test_selective_prediction_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.random() < 0.7), rng.randrange(20) / 20) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None, 0.5), (901, 1.0, None)], "id int, c double, p double").repartition(5)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    err = np.cumsum([1 - r[1] for r in order])
    k = np.arange(1, 501)
    got = selective.aurc(df, "c", "p", "id").first()
    best = np.maximum(0, k - (500 - err[-1])) / k
    assert got["aurc"] == pytest.approx((err / k).mean()) and got["optimal_aurc"] == pytest.approx(best.mean())
    risk = selective.selective_risk(df, "c", "p", "id", coverage=0.333).first()
    assert (risk["risk"], risk["coverage"], risk["threshold"]) == (pytest.approx(err[166] / 167), 167 / 500, order[166][2])
    parts = np.array_split(sorted(rows, key=lambda r: (r[2], r[0])), 15)
    assert selective.adaptive_calibration_error(df, "c", "p", "id").first()[0] == pytest.approx(np.mean([abs(x[:, 1].mean() - x[:, 2].mean()) for x in parts]))
    assert selective.adaptive_calibration_error(df.filter("id < 0"), "c", "p", "id").first()[0] is None


def test_groups_by_hand(spark):
    df = spark.createDataFrame([(1, "A  b"), (1, "a b"), (2, "x"), (2, "y"), (3, "alone")], "q int, a string")
    assert groups.agreement(df, "q", "a").first().asDict() == {"consistency": 0.5, "pairwise_agreement": 0.5}
    lengths = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (4, 1)], "n int, c int")
    assert groups.accuracy_by_length(lengths, "c", "n").first().asDict() == {"accuracy": 0.8, "effective_length": 1.0, "passing_lengths": 2}
    with pytest.raises(Exception, match="unknown stage"):
        groups.failure_attribution(spark.createDataFrame([("moon",)], "s string"), "s", ["sun"]).collect()
    states = spark.createDataFrame([(1, "a", "x", "x"), (1, "b", "y", None), (2, "a", "z", "z")], "t int, s string, e string, p string")
    assert groups.state_tracking(states, "t", "s", "e", "p").first().asDict() == {"joint_goal_accuracy": 0.5, "slot_accuracy": pytest.approx(2 / 3)}
    plans = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], []), (["a"], [])], "p array<string>, e array<string>")
    got = agents.plan_adherence(plans, "p", "e").first()
    assert (got["precision"], got["recall"], got["exact_match"]) == (pytest.approx(2 / 3), pytest.approx((2 / 3 + 1) / 3), pytest.approx(1 / 3))


def test_answers(spark):
    cases = [("it is 1,200.0 or $3", "3"), ("a #### 42 b", "42"), ("####  none ", "none"), ("no", None), ("x = -.5", "-.5"), (None, None)]
    df = spark.createDataFrame(cases, "t string, w string")
    assert all(r["w"] == r["g"] for r in df.withColumn("g", text.extract_answer(df["t"])).collect())
    pick = spark.createDataFrame([("so (B) or C.", "C"), ("ABC", None)], "t string, w string")
    assert all(r["w"] == r["g"] for r in pick.withColumn("g", text.extract_answer(pick["t"], "choice")).collect())


def test_summaries_of_lines():
    assert text.rouge_lsum("the cat sat\non a mat", "the cat\na mat on") == [pytest.approx(4 / 5), pytest.approx(4 / 6), pytest.approx(8 / 11)]
    assert text.rouge_lsum("", "a") == [0.0, 0.0, 0.0]
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        places = text._lcs_places(a, b)
        assert len(places) == text.lcs(a, b) and places == sorted(places)


def test_bleu_matches_by_brute_force():
    from collections import Counter

    rng = random.Random(1)
    for _ in range(40):
        r, p = (" ".join(rng.choice("ab.c,") for _ in range(rng.randint(0, 30))) for _ in range(2))
        x, y = text.tokens_13a(r), text.tokens_13a(p)
        want = []
        for n in range(1, 5):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (y, x))
            want += [sum((a & b).values()), max(len(y) - n + 1, 0)]
        assert text.bleu_statistics(r, p) == [*want, len(y), len(x)]


def test_precision_at_overlaps(spark):
    t = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0], 1), (1, 0, [20.0, 0.0, 30.0, 10.0], 2), (2, 1, [0.0, 0.0, 4.0, 4.0], 3)], "image long, label int, box array<double>, id long")
    f = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 9.0], 0.9, 1), (1, 0, [50.0, 0.0, 60.0, 10.0], 0.8, 2), (1, 0, [20.0, 0.0, 30.0, 6.0], 0.7, 3)], "image long, label int, box array<double>, score double, id long")
    got = {(r["iou"], r["label"]): r["ap"] for r in vision.average_precisions(t, f, (0.5, 0.75, 0.95)).collect()}
    assert got == {(0.5, 0): pytest.approx((51 + 50 * 2 / 3) / 101), (0.75, 0): pytest.approx(51 / 101), (0.95, 0): 0.0, (0.5, 1): 0.0, (0.75, 1): 0.0, (0.95, 1): 0.0}


def test_intervals_and_reports(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (0, 0, 1), (0, 1, 0), (1, 1, 0)] * 40, "t int, a int, b int")
    got = exact_tests.paired_bootstrap(df, "t", "a", "b")
    assert got["difference"] == pytest.approx(0.0) and got["low"] < 0 < got["high"] and got["p_value"] > 0.5
    rows = {r["metric"]: r for r in classification.diagnostic_report(df, "t", "a").collect()}
    assert rows["sensitivity"]["value"] == pytest.approx(2 / 3) and rows["sensitivity"]["low"] < 2 / 3 < rows["sensitivity"]["high"]
    empty = {r["metric"]: r["value"] for r in classification.diagnostic_report(df.filter("t > 5"), "t", "a").collect()}
    assert set(empty.values()) == {None}
