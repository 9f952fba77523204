"""Statistics without a value: null, never an error; columns may have any name."""

from __future__ import annotations

import pytest

from lodestone.operators import exact_tests, judges, statistics


def one(df) -> dict:  # noqa: ANN001
    return df.first().asDict()


@pytest.mark.parametrize("rows", [[], [("a", 1.0)], [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], [("a", None), ("b", None)]])
def test_two_samples_without_spread(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double")
    assert one(statistics.welch_statistics(df, "x", "g", "a", "b"))["statistic"] is None
    assert statistics.two_sample(df, "x", "g", "a", "b")["statistic"] is None
    assert one(statistics.mann_whitney(df, "x", "g", "a", "b"))["z"] is None
    assert one(statistics.kruskal_wallis(df, "x", "g"))["h"] is None


def test_all_equal_values_have_no_effect(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, x double")
    assert exact_tests.mann_whitney_test(df, "x", "g", "a", "b") == {"statistic": 1.0, "p_value": 1.0, "auc": 0.5, "rank_biserial": 0.0}


def test_paired_without_differences(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, None)], "a double, b double")
    assert one(statistics.paired_t(df, "a", "b"))["statistic"] is None
    assert one(statistics.wilcoxon(df, "a", "b")) == {"w_plus": 0.0, "w_minus": 0.0, "rank_biserial": None}


def test_friedman_of_tied_blocks(spark):
    df = spark.createDataFrame([(b, t, 1.0) for b in range(3) for t in range(3)] + [(9, 1, None)], "block int, treatment int, v double")
    assert one(statistics.friedman(df, "block", "treatment", "v"))["statistic"] is None


@pytest.mark.parametrize("names", [("r", "c"), ("o", "n"), ("i", "j"), ("x", "g"), ("j", "i")])
def test_contingency_columns_of_any_name(spark, names):
    rows = [("u", "x"), ("u", "y"), ("v", "x"), ("v", "x"), ("v", None)]
    got = one(statistics.chi_square(spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string"), *names))
    assert got["df"] == 1 and got["statistic"] == pytest.approx(4 / 3)
    same = spark.createDataFrame([("u", "x"), ("u", "x")], f"{names[0]} string, {names[1]} string")
    assert one(statistics.chi_square(same, *names))["cramers_v"] is None


def test_two_samples_of_any_name(spark):
    for v, g in (("n", "value"), ("rank", "c"), ("ra", "na"), ("g", "x")):
        df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, "b")], f"{v} double, {g} string")
        assert one(statistics.mann_whitney(df, v, g, "a", "b"))["u"] == 0.0
        assert one(statistics.kruskal_wallis(df, v, g))["df"] == 1


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval", "ratio"])
def test_alpha_masks_missing_ratings(spark, level):
    with_null = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0), (1, None), (2, 2.0), (2, 3.0)], "item int, v double")
    without = with_null.dropna()
    assert one(judges.krippendorff_alpha(with_null, "item", "v", level)) == one(judges.krippendorff_alpha(without, "item", "v", level))
    if level == "nominal":
        assert one(judges.krippendorff_alpha(with_null, "item", "v"))["alpha"] == pytest.approx(0.4)
    flat = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0)], "c int, v double")
    assert one(judges.krippendorff_alpha(flat, "c", "v", level))["alpha"] is None


def test_kappa_without_a_value(spark):
    for rows in ([], [(0, "a"), (0, "a")], [(0, "a"), (1, "b")]):
        assert one(judges.fleiss_kappa(spark.createDataFrame(rows, "c int, e string"), "c", "e"))["kappa"] is None
