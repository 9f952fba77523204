"""Columns of any name, and nulls that are equal to each other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import groups, judges, text


def test_equal_calls_score_one_with_nulls(spark):
    calls = spark.createDataFrame([(1, "a", None), (1, "a", "{}"), (2, None, "x"), (None, "b", None)], "task long, tool string, args string")
    assert groups.tool_arguments(calls, calls, "task", "tool", "args").first()[0] == 1.0
    assert groups.tool_selection(calls, calls, "task", "tool").first()[0] == 1.0
    fewer = calls.filter("args is null")
    assert groups.tool_arguments(calls, fewer, "task", "tool", "args").first()[0] == 0.5
    assert groups.tool_selection(calls, fewer, "task", "tool").first()[0] == pytest.approx(1 / 3)
    assert groups.tool_arguments(calls.limit(0), calls, "task", "tool", "args").first()[0] is None


@pytest.mark.parametrize("key", ["g", "r", "hit", "x"])
def test_overlap_with_any_key(spark, key):
    df = spark.createDataFrame([(1, "a b c", "a b d")], f"{key} long, left string, right string")
    got = text.overlap_scores(df, key, text.tokens(F.col("left")), text.tokens(F.col("right"))).first()
    assert got[key] == 1 and got["f1"] == pytest.approx(2 / 3)


def test_bleu_of_columns_named_like_its_sums(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on a mat")], "hit1 string, total1 string")
    assert text.bleu(df, "hit1", "total1").first()[0] == text.bleu(df.toDF("reference", "prediction")).first()[0] > 0


def test_votes_with_any_name(spark):
    df = spark.createDataFrame([(1, "a", 0, "a"), (1, "b", 1, "a"), (1, "a", 2, "a")], "c long, p string, i long, r string")
    assert judges.majority_vote(df, "c", "p", "i", "r").first()[0] == 1.0
    assert judges.sample_agreement(df, "c", "p").first()["modal_share"] == pytest.approx(2 / 3)


def test_subsequences_equal_the_whole_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        got = text._lcs_places(a, b)
        assert len(got) == best[-1][-1] and got == sorted(got)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in got)


def test_summaries_of_lines_take_the_union():
    """Each reference line gathers what any predicted line has of it."""
    got = text.rouge_lsum("w1 w2 w3 w4 w5\nx y", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")
    assert got[1] == pytest.approx(4 / 7) and got[0] == pytest.approx(4 / 10)
