"""Agent trajectories, event logs and code: windows over ordered calls, and syntax checks by row."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.operators.text import lcs
from lodestone.plans.patterns import dealt, group_percentiles, ratio, successor


def repeated_calls(df: DataFrame, task: str, order: str, call: str, *, loop: int = 3) -> DataFrame:
    """(unnecessary_rate, loop_rate): share of calls made before in the same task, share of tasks with ``loop`` equal calls in a row."""
    n = F.row_number().over(Window.partitionBy(task).orderBy(order))
    m = F.row_number().over(Window.partitionBy(task, call).orderBy(order))
    d = df.select(task, call, m.alias("m"), (n - m).alias("island"))
    runs = d.groupBy(task, call, "island").agg(F.count("*").alias("run"), F.sum((F.col("m") > 1).cast("int")).alias("again"))
    t = runs.groupBy(task).agg(F.max("run").alias("run"), F.sum("again").alias("again"), F.sum("run").alias("n"))
    return t.agg((F.sum("again") / F.sum("n")).alias("unnecessary_rate"), F.avg((F.col("run") >= loop).cast("double")).alias("loop_rate"))


def failure_recovery(df: DataFrame, task: str, order: str, tool: str, ok: str) -> DataFrame:
    """Share of failed calls after which the same tool succeeds in the same task."""
    w = Window.partitionBy(task, tool).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    d = df.select((F.col(ok) == 0).alias("failed"), F.coalesce(F.max(ok).over(w), F.lit(0)).alias("later"))
    return d.filter("failed").agg(F.avg(F.col("later").cast("double")).alias("recovery_rate"))


def invalid_tools(df: DataFrame, tool: str, catalogue: list[str]) -> DataFrame:
    """Share of calls of tools that the catalogue lacks."""
    return df.agg(F.avg((~F.col(tool).isin(catalogue)).cast("double")).alias("invalid_tool_rate"))


def energy(df: DataFrame, time: str, watts: str) -> DataFrame:
    """Joules by the trapezoid rule over one series of samples, in order of time; samples of one time are averaged. The series is
    dealt to ranges of time, each of which looks at the first sample of the next."""
    samples = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("t")).agg(F.avg(watts).alias("p"))
    d = successor(dealt(samples, ["t"]), "t", ["t", "p"])
    return d.agg(F.sum((F.col("next_t") - F.col("t")) * (F.col("p") + F.col("next_p")) / 2).alias("joules"))


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, mean, sd, min, max, p50, p90, p95, p99) with exact linear percentiles, found by ranges of values; sd of one row is 0."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    shares = group_percentiles(df, F.col(value), {f"p{q}": q / 100 for q in (50, 90, 95, 99)}, by)
    if not by:
        return plain.crossJoin(shares)  # a row each
    same = [plain[c].eqNullSafe(shares[c]) for c in by]
    return plain.join(shares, same, "left").select(*(plain[c] for c in plain.columns), "p50", "p90", "p95", "p99")


def accuracy_grid(df: DataFrame, correct: str, length: str, depth: str) -> DataFrame:
    """(length, depth, accuracy) of each cell and both margins (null for all)."""
    return df.cube(length, depth).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"))


def valid_python(column: Column) -> Column:
    """Whether each text compiles; it is never run."""

    @pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        def ok(t: str | None) -> bool:
            try:
                compile(t or "", "<code>", "exec")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        return s.map(ok)

    return check(column)


def pass_at_k(df: DataFrame, n: str, c: str, k: int) -> DataFrame:
    """Mean over problems of 1 - prod (1 - k / i), i from n - c + 1 to n; 1 where fewer than k samples fail."""
    product = F.aggregate(F.sequence(F.col(n) - F.col(c) + 1, F.col(n)), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return df.agg(F.avg(F.when(F.col(n) - F.col(c) < k, 1.0).when(F.col(c) == 0, 0.0).otherwise(1 - product)).alias("pass_at_k"))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp)


def cyclomatic(code: str) -> int:
    """1 and one for each branch and further boolean operand."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(ast.parse(code)))


def plan_adherence(df: DataFrame, plan: str, executed: str) -> DataFrame:
    """(precision, recall, f1, exact_match), means over tasks: the longest common subsequence of planned and executed steps
    (arrays of strings) over the steps of either. A task without executed steps has precision 1 if it planned none, else 0."""

    @pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    d = df.select(F.coalesce(F.col(plan), F.array().cast("array<string>")).alias("p"), F.coalesce(F.col(executed), F.array().cast("array<string>")).alias("e"))
    d = d.select("p", "e", common("p", "e").alias("n"))
    d = d.select((F.col("p") == F.col("e")).cast("double").alias("same"), F.when(F.size("e") > 0, F.col("n") / F.size("e")).otherwise((F.size("p") == 0).cast("double")).alias("a"), F.when(F.size("p") > 0, F.col("n") / F.size("p")).otherwise(1.0).alias("b"))
    return d.agg(F.avg("a").alias("precision"), F.avg("b").alias("recall"), F.avg(ratio(2 * F.col("a") * F.col("b"), F.col("a") + F.col("b"))).alias("f1"), F.avg("same").alias("exact_match"))
