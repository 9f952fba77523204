"""Metrics over groups of answers: by language, template, length, position, source or claim. Groups are reduced to counts first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.classification import class_scores
from lodestone.plans.durable import written
from lodestone.plans.patterns import binned, group_percentiles, ranks, ratio


def plain(answer: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(answer), r"\s+", " "))


def agreement(df: DataFrame, question: str, answer: str) -> DataFrame:
    """(consistency, pairwise_agreement) over questions of two answers or more, across languages, documents, paraphrases or
    repeated runs: the share on which all agree, and the mean share of agreeing pairs, from counts of equal plain answers."""
    c = df.select(F.col(question).alias("q"), plain(F.col(answer).cast("string")).alias("a")).groupBy("q", "a").agg(F.count("*").alias("c"))
    q = c.groupBy("q").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).filter("n > 1")
    return q.agg(F.avg((F.col("same") == F.col("n") * (F.col("n") - 1)).cast("double")).alias("consistency"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("pairwise_agreement"))


def language_identification(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(accuracy, macro_f1); labels are all that occur as truth or prediction."""
    s = class_scores(df, truth, pred)
    return s.agg(ratio(F.sum("tp"), F.sum("support"), None).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def parity(df: DataFrame, group: str, score: str) -> DataFrame:
    """(parity, max_gap, sd, worst): least over greatest mean score of a group, 0 at least; null if no mean is positive."""
    m = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.avg(score).alias("m"))
    s = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.stddev_samp("m").alias("sd"), F.min(F.struct("m", "g")).alias("w"))
    return s.select(F.when(F.col("hi") > 0, ratio(F.greatest(F.lit(0.0), "lo"), F.col("hi"), None)).alias("parity"), (F.col("hi") - F.col("lo")).alias("max_gap"), "sd", F.col("w.g").alias("worst"))


def prompt_sensitivity(df: DataFrame, template: str, example: str, score: str) -> DataFrame:
    """(spread, sd, worst, best, mean, example_disagreement_rate) of mean scores by template."""
    t = df.groupBy(F.col(template).alias("t")).agg(F.avg(score).alias("m")).agg((F.max("m") - F.min("m")).alias("spread"), F.stddev_samp("m").alias("sd"), F.min("m").alias("worst"), F.max("m").alias("best"), F.avg("m").alias("mean"))
    e = df.groupBy(F.col(example).alias("e")).agg((F.max(score) != F.min(score)).cast("double").alias("d")).agg(F.avg("d").alias("example_disagreement_rate"))
    return t.crossJoin(e)


def truncation_sensitivity(df: DataFrame, correct: str, length: str) -> DataFrame:
    """(slope, drop_shortest_to_longest): least-squares slope of accuracy by length on log2(length), a point for each distinct
    length; null for fewer than two."""
    a = df.groupBy(F.col(length).cast("double").alias("n")).agg(F.avg(correct).alias("y")).withColumn("x", F.log2("n"))
    s = a.agg(F.regr_slope("y", "x").alias("slope"), F.min_by("y", "n").alias("first"), F.max_by("y", "n").alias("last"))
    return s.select("slope", (F.col("first") - F.col("last")).alias("drop_shortest_to_longest"))


def accuracy_by_length(df: DataFrame, correct: str, length: str, *, threshold: float = 0.85) -> DataFrame:
    """(accuracy, effective_length, passing_lengths): the longest length up to which each length's accuracy is at least
    ``threshold`` (null if the first is not), and the number of lengths that pass."""
    a = df.groupBy(F.col(length).cast("double").alias("len")).agg(F.sum(F.col(correct).cast("double")).alias("c"), F.count("*").alias("n"))
    a = a.withColumn("ok", F.col("c") / F.col("n") >= threshold)
    fails = a.agg(F.min(F.when(~F.col("ok"), F.col("len"))).alias("fails"))
    return a.crossJoin(F.broadcast(fails)).agg((F.sum("c") / F.sum("n")).alias("accuracy"), F.max(F.when(F.col("fails").isNull() | (F.col("len") < F.col("fails")), F.col("len"))).alias("effective_length"), F.count_if("ok").alias("passing_lengths"))


def position_accuracy(df: DataFrame, correct: str, position: str, *, bins: int = 5) -> DataFrame:
    """(spread, accuracy): best less worst accuracy of the bins of the relative position that have rows."""
    b = binned(df.select(F.col(correct).cast("double").alias("c"), F.col(position).cast("double").alias("p")), "p", bins).groupBy("bin").agg(F.avg("c").alias("m"), F.sum("c").alias("c"), F.count("*").alias("n"))
    return b.agg((F.max("m") - F.min("m")).alias("spread"), (F.sum("c") / F.sum("n")).alias("accuracy"))


def failure_attribution(df: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """(stage, share, n) of each of ``stages`` among failures; null, empty, none and success are no failures, and a stage that is
    not named raises when the share is computed."""
    s = F.lower(F.trim(F.col(stage)))
    failed = df.select(s.alias("stage")).filter("stage is not null and stage not in ('none', 'success', '')")
    checked = failed.select(F.when(F.col("stage").isin(stages), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("unknown stage "), "stage"))).alias("stage"))
    c = checked.groupBy("stage").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(x,) for x in stages], "stage string")
    every = names.join(c, "stage", "left").na.fill(0, ["n"])
    return every.select("stage", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(1))), None).alias("share"), "n")  # a row a stage


def knowledge_consistency(facts: DataFrame, output: str, fact: str, known: DataFrame, known_fact: str) -> DataFrame:
    """(micro, macro): share of extracted facts that the knowledge base holds, over all facts and as the mean over outputs."""
    base = known.select(F.col(known_fact).alias("fact"), F.lit(1).alias("hit")).distinct()
    j = facts.select(F.col(output).alias("o"), F.col(fact).alias("fact")).join(base, "fact", "left").groupBy("o").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    return j.agg((F.sum("h") / F.sum("n")).alias("micro"), F.avg(F.col("h") / F.col("n")).alias("macro"))


def context_recall(df: DataFrame, query: str, supported: str) -> DataFrame:
    """(context_recall, pooled): mean over queries of the share of reference claims that the context supports, and the share of
    all claims; rows are claims, so a query without any has no value."""
    q = df.groupBy(F.col(query).alias("q")).agg(F.sum(F.col(supported).cast("double")).alias("h"), F.count(supported).alias("n")).filter("n > 0")
    return q.agg(F.avg(F.col("h") / F.col("n")).alias("context_recall"), (F.sum("h") / F.sum("n")).alias("pooled"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles, by row."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null where one is zero."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), None)


def embedding_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean cosine of two vectors of each row: prediction and reference, or question and one regenerated question a row."""
    return df.agg(F.avg(cosine(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"))).alias("embedding_similarity"))


def answer_relevance(df: DataFrame, answer: str, question: str, generated: str) -> DataFrame:
    """Mean over answers of the mean cosine of the question and each question regenerated from the answer (a row each)."""
    c = df.groupBy(F.col(answer).alias("a")).agg(F.avg(cosine(F.col(question).cast("array<double>"), F.col(generated).cast("array<double>"))).alias("c"))
    return c.agg(F.avg("c").alias("answer_relevance"))


def state_tracking(df: DataFrame, turn: str, slot: str, expected: str, predicted: str) -> DataFrame:
    """(joint_goal_accuracy, slot_accuracy); a row for each slot of a turn in either state, null where a state lacks it."""
    t = df.groupBy(F.col(turn).alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col(expected) == F.col(predicted)).alias("ok"))
    return t.agg(F.avg((F.col("n") == F.col("ok")).cast("double")).alias("joint_goal_accuracy"), (F.sum("ok") / F.sum("n")).alias("slot_accuracy"))


def resource_utilization(df: DataFrame, series: str, value: str) -> DataFrame:
    """(series, peak, mean, p95) of readings; the percentile is found by ranges of values."""
    own = df.select(F.col(series).alias("series"), F.col(value).alias("value"))
    plain = own.groupBy("series").agg(F.max("value").cast("double").alias("peak"), F.avg("value").alias("mean"))
    shares = group_percentiles(own, F.col("value"), {"p95": 0.95}, ["series"])
    return plain.join(shares, plain["series"].eqNullSafe(shares["series"])).select(plain["series"], "peak", "mean", "p95")


def judge_agreement(df: DataFrame, judge: str, human: str) -> DataFrame:
    """(pearson, spearman, raw_agreement, cohen_kappa, quadratic_kappa, n) of a judge's and human scores, over the rows that have
    both. Equal pairs are counted first; ranks of equal scores are their mean; the quadratic kappa weighs by squared
    differences of the scores themselves."""
    known = df.select(F.col(judge).cast("double").alias("x"), F.col(human).cast("double").alias("y")).dropna()
    pairs = written(known.groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    placed = lambda c: ranks(known.select(c), c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    sides = {c: written(placed(c), "ranks") for c in "xy"}
    both = pairs.join(sides["x"], "x").join(sides["y"], "y")

    def correlation(a: str, b: str) -> Column:
        w, u, v = F.col("n"), F.col(a), F.col(b)
        n, mu, mv = F.sum(w), F.sum(w * u), F.sum(w * v)
        return ratio(n * F.sum(w * u * v) - mu * mv, F.sqrt((n * F.sum(w * u * u) - mu * mu) * (n * F.sum(w * v * v) - mv * mv)), None)

    n, w = F.sum("n"), F.col("n")
    same = F.sum(F.when(F.col("x") == F.col("y"), w).otherwise(0))
    apart = ratio(F.sum(w * F.pow(F.col("x") - F.col("y"), 2.0)), n, None)
    chance = F.sum(w * F.pow("x", 2.0)) / n + F.sum(w * F.pow("y", 2.0)) / n - 2 * (F.sum(w * F.col("x")) / n) * (F.sum(w * F.col("y")) / n)
    told = both.agg(correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"), ratio(same, n, None).alias("raw_agreement"), F.when(n > 0, 1 - ratio(apart, chance, None)).alias("quadratic_kappa"), F.coalesce(n, F.lit(0)).alias("n"))
    meet = sides["x"].join(sides["y"].withColumnRenamed("y", "x"), "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("__chance"))
    by_chance = ratio(F.col("__chance").cast("double"), F.pow("n", 2.0), None)
    kappa = ratio(F.col("raw_agreement") - by_chance, 1 - by_chance, None)
    return told.crossJoin(meet).select("pearson", "spearman", "raw_agreement", kappa.alias("cohen_kappa"), "quadratic_kappa", "n")  # a row each


def _call_counts(expected: DataFrame, predicted: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(columns, e, p): how often each combination is expected and predicted; nulls are values like others."""
    side = lambda d, e, p: d.select(*(F.col(c).alias(n) for n, c in columns.items()), F.lit(e).alias("e"), F.lit(p).alias("p"))
    return side(expected, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*columns).agg(F.sum("e").alias("e"), F.sum("p").alias("p"))


def tool_selection(expected: DataFrame, predicted: DataFrame, task: str, tool: str) -> DataFrame:
    """Share of tasks whose predicted tools are the expected ones, as multisets; a task may lack either. A null tool equals
    another one of the same task."""
    t = _call_counts(expected, predicted, {"task": task, "tool": tool}).groupBy("task").agg(F.min((F.col("e") == F.col("p")).cast("int")).alias("ok"))
    return t.agg(F.avg(F.col("ok").cast("double")).alias("tool_selection_accuracy"))


def tool_arguments(expected: DataFrame, predicted: DataFrame, task: str, tool: str, arguments: str) -> DataFrame:
    """Share of expected calls met by a predicted call of equal tool and arguments, each used once; calls without arguments (null)
    are equal in them. Arguments compare as the columns' own values: parse JSON texts first."""
    j = _call_counts(expected, predicted, {"task": task, "tool": tool, "args": arguments})
    return j.agg(F.try_divide(F.sum(F.least("e", "p")), F.sum("e")).alias("tool_argument_accuracy"))
