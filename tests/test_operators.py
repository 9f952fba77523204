from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import special
from lodestone.operators import agents, catalog, classification, judges, retrieval, safety, statistics, structured, text, vision
from lodestone.sources.readers import read_table
from lodestone.sources.render import render


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert special.student_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.beta_regularized(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert special.binomial_two_sided(3, 10) == pytest.approx(0.34375, abs=1e-12)


def test_class_scores_by_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    got = {r["label"]: r for r in classification.class_scores(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"], got["a"]["tn"]) == (1, 1, 1, 2)
    assert got["c"]["f1"] == 0.0 and got["c"]["precision"] == 0.0
    assert got["b"]["recall"] == 1.0 and got["b"]["precision"] == pytest.approx(2 / 3)


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "t int, s double")
    assert classification.curve_areas(df, "t", "s").first()["roc_auc"] == pytest.approx(want)
    assert statistics.delong(df, "t", "s").first()["auc"] == pytest.approx(want)
    assert statistics.mann_whitney(df, "s", "t", 1, 0).first()["auc"] == pytest.approx(want)
    curve = classification.roc_curve(df, "t", "s").orderBy(F.desc("score")).collect()
    assert len(curve) == len({s for _, s in rows}) and curve[-1]["tpr"] == 1.0


def test_single_class_has_no_area(spark):
    assert classification.curve_areas(spark.createDataFrame([(1, 0.5)], "t int, s double"), "t", "s").first()["roc_auc"] is None


def test_calibration_line_recovers_the_truth(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        p = rng.uniform(0.05, 0.95)
        rows.append((int(rng.random() < p), p))
    a, b = classification.calibration_line(spark.createDataFrame(rows, "t int, p double"), "t", "p")
    assert abs(a) < 0.15 and abs(b - 1) < 0.15


def test_strict_evaluation_rejects_bad_rows(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, 2.5, 1.0)], "y double, yhat double, w double")
    with pytest.raises(catalog.MetricInputError):
        catalog.evaluate(df, ["regression.mae"])
    assert catalog.evaluate(df.na.drop(), ["regression.mae", "regression.rmse"]).first()["mae"] == 0.5
    with pytest.raises(catalog.MetricInputError):
        catalog.evaluate(spark.createDataFrame([(0.0, 1.0, 1.0)], "y double, yhat double, w double"), ["regression.mape"])


def test_metrics_of_no_rows_are_null(spark):
    df = spark.createDataFrame([], "y double, yhat double, w double")
    assert catalog.evaluate(df, ["regression.mae"]).first()["mae"] is None


def test_mcnemar_switches_to_the_exact_test():
    assert statistics.mcnemar_p(0, 0) == 1.0
    assert statistics.mcnemar_p(3, 7) == pytest.approx(0.34375)
    assert statistics.mcnemar_p(20, 40) == pytest.approx(special.chi2_sf(19**2 / 60, 1))


def test_adjusted_pvalues(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    got = {r["k"]: r for r in statistics.adjust_pvalues(df, "k", "p").collect()}
    assert [round(got[k]["holm"], 10) for k in (1, 2, 3)] == [0.03, 0.06, 0.06]
    assert [round(got[k]["bh"], 10) for k in (1, 2, 3)] == [0.03, 0.04, 0.04]


def test_retrieval_by_hand(spark):
    run = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)], "query int, doc string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "q", 1), (3, "w", 0)], "query int, doc string, grade int")
    got = {r["query"]: r for r in retrieval.retrieval_scores(run, qrels, k=3).collect()}
    assert set(got) == {1, 2}
    assert got[1]["mrr"] == 0.5 and got[1]["recall"] == 1.0 and got[1]["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got[1]["ndcg"] == pytest.approx((1 / math.log2(3) + 2 / math.log2(4)) / (2 + 1 / math.log2(3)))
    assert got[2]["mrr"] == 0.0


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat"), (2, "", ""), (3, "a", "")], "k int, reference string, prediction string")
    got = {r["k"]: r for r in text.overlap_scores(df, "k", text.tokens(F.col("reference")), text.tokens(F.col("prediction"))).collect()}
    assert got[1]["precision"] == 1.0 and got[1]["recall"] == 0.5 and got[2]["f1"] == 1.0 and got[3]["f1"] == 0.0
    same = "the quick brown fox jumps over the lazy dog"
    assert text.bleu_from(text.bleu_statistics(same, same)) == pytest.approx(100)
    assert text.chrf_from(text.chrf_statistics(same, same)) == pytest.approx(100)
    assert text.translation_edits("a b c d", "c d a b") == [1, 4]
    assert text.rouge_l("a b c", "a c")[2] == pytest.approx(0.8)
    assert text.meteor(same, same)[0] > 0.99
    assert text.distinct_n(spark.createDataFrame([("a a b",)], "t string"), "t", 2).first()[0] == 1.0


def test_json_extraction_and_schemas():
    assert structured.extract_json('x {"a": 1} y', "lenient") == {"a": 1}
    assert structured.extract_json("```json\n[1]\n```", "fenced") == [1]
    with pytest.raises(ValueError):
        structured.extract_json("x {}")
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"$ref": "#/$defs/s"}}, "additionalProperties": False, "$defs": {"s": {"enum": ["x", 1]}}}
    check = lambda v: list(structured.schema_errors(v, schema))
    assert not check({"a": 1, "b": 1.0}) and check({"a": True}) and check({"a": -1}) and check({}) and check({"a": 1, "c": 2}) and check({"a": 1, "b": True})
    with pytest.raises(structured.SchemaError):
        list(structured.schema_errors(1, {"tpye": "integer"}))


def test_tool_calls(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "task int, call string")
    p = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "task int, call string")
    got = structured.tool_call_scores(e, p, "task", "call").first()
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == pytest.approx(2 / 3) and got["exact"] == 0.0


def test_pii_and_priorities():
    kinds = lambda t: [k for k, _, _ in safety.detect_pii(t)]
    assert kinds("mail a.b@example.org or +1 (555) 010-9999") == ["email", "phone"]
    assert kinds("4111 1111 1111 1111 and 10.0.0.255") == ["card", "ipv4"]
    assert kinds("123-45-6789") == ["ssn"] and kinds("4111 1111 1111 1112") == []


def test_judges(spark):
    same = spark.createDataFrame([(i, r, float(i % 3)) for i in range(9) for r in range(3)], "item int, rater int, v double")
    assert judges.krippendorff_alpha(same, "item", "v").first()[0] == pytest.approx(1.0)
    assert judges.fleiss_kappa(same, "item", "v").first()[0] == pytest.approx(1.0)
    games = spark.createDataFrame([(k, "x", "y", 1.0) for k in range(3)] + [(9, "x", "y", 0.0)], "o int, a string, b string, w double")
    bt = judges.bradley_terry(games, "a", "b", "w")
    assert bt["x"] - bt["y"] == pytest.approx(math.log(3))
    elo = {r["system"]: r["rating"] for r in judges.elo(games, "o", "a", "b", "w").collect()}
    assert elo["x"] + elo["y"] == pytest.approx(2000) and elo["x"] > elo["y"]


def test_agents_and_code(spark):
    calls = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "a", 0), (1, 3, "a", 1), (1, 4, "b", 0), (2, 5, "a", 1)], "task int, o int, tool string, ok int")
    got = agents.repeated_calls(calls, "task", "o", "tool").first()
    assert got["unnecessary_rate"] == pytest.approx(2 / 5) and got["loop_rate"] == 0.5
    assert agents.failure_recovery(calls, "task", "o", "tool", "ok").first()[0] == pytest.approx(2 / 3)
    assert agents.cyclomatic("def f(x):\n    if x and x > 1:\n        return 1\n    return 0\n") == 3
    assert agents.pass_at_k(spark.createDataFrame([(5, 0), (5, 5), (5, 1)], "n int, c int"), "n", "c", 1).first()[0] == pytest.approx((0 + 1 + 0.2) / 3)


def test_detection_and_masks(spark):
    t = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0], 1), (1, 0, [20.0, 20.0, 30.0, 30.0], 2)], "image long, label int, box array<double>, id long")
    f = spark.createDataFrame([(1, 0, [0.0, 0.0, 10.0, 10.0], 0.9, 1), (1, 0, [0.0, 0.0, 10.0, 9.0], 0.8, 2)], "image long, label int, box array<double>, score double, id long")
    assert [r["hit"] for r in vision.matched_detections(t, f).orderBy("det").collect()] == [1, 0]
    assert vision.detection_average_precision(t, f).first()["ap"] == pytest.approx(51 / 101)
    masks = spark.createDataFrame([(1, [[1, 1], [0, 0]], [[1, 0], [0, 0]])], "image long, a array<array<int>>, b array<array<int>>")
    got = {r["label"]: r for r in vision.segmentation_scores(vision.pixels(masks, "image", "a", "b")).collect()}
    assert got[1]["iou"] == 0.5 and got[0]["iou"] == pytest.approx(2 / 3)


def test_sources_and_rendering(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    df = read_table(spark, str(tmp_path / "x.csv"))
    assert df.count() == 2
    assert render(df.orderBy("a"), "csv").splitlines()[1] == "1,x" and render(df, "html").startswith("<table>")
    with pytest.raises(ValueError):
        read_table(spark, "x.bin")


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__ as entry

    assert "classification_report" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("run", [7, 40, 1000])
def test_elo_runs_equal_one_stream(spark, run):
    snap = 1.5 * 2.0**20
    games = [(None if k == 5 else k * 37 % 300, ("l", "m")[k % 3 == 0], "abcde"[k % 5], "abcde"[(k // 5 + k + 1) % 5], (k * 7 % 5) / 4) for k in range(300)]
    want: dict = {}
    for _, league, x, y, w in sorted(games, key=lambda g: (g[0] is None, g[0] or 0)):
        rx, ry = want.get((league, x), 1000.0), want.get((league, y), 1000.0)
        gain = 4.0 * (w - 1 / (1 + 10 ** ((ry - rx) / 400))) + snap - snap
        want[league, x] = rx + gain
        want[league, y] = ry - gain
    df = spark.createDataFrame(games, "o int, league string, a string, b string, w double").repartition(3)
    got = judges.elo(df, "o", "a", "b", "w", league="league", run=run).collect()
    assert {(r["league"], r["system"]): r["rating"] for r in got} == want
    assert judges.elo(df.limit(0), "o", "a", "b", "w", run=run).isEmpty()
