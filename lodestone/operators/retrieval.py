"""Retrieval metrics over a run (query, doc, rank) and judgements (query, doc, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_scores(run: DataFrame, qrels: DataFrame, *, k: int = 10) -> DataFrame:
    """(query, precision, recall, hit_rate, mrr, average_precision, ndcg) at ``k`` of every judged query.

    Grades over 0 are relevant. A query without results scores 0; one without relevant documents is left out, as recall has
    no value there. Ranks start at 1 and are distinct in a query.
    """
    relevant = qrels.filter("grade > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc"))
    ideal = relevant.withColumn("i", ideal_rank).groupBy("query").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal"))
    hits = run.filter(F.col("rank") <= k).join(relevant, ["query", "doc"])
    seen = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    got = hits.withColumn("seen", seen).groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("gain"))
    j = ideal.join(got, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query", zero(F.col("hits") / k).alias("precision"), zero(F.col("hits") / F.col("n_relevant")).alias("recall"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("ap") / F.col("n_relevant")).alias("average_precision"), zero(F.col("gain") / F.col("ideal")).alias("ndcg"))


def context_precision(df: DataFrame, key: str, rank: str, flag: str) -> DataFrame:
    """(key, context_precision, context_relevance): mean precision at the relevant chunks, and the share of relevant chunks."""
    w = Window.partitionBy(key).orderBy(rank)
    d = df.select(key, F.col(flag).alias("f"), F.row_number().over(w).alias("i"), F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("h"))
    return d.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("f") == 1, F.col("h") / F.col("i"))) / F.when(F.sum("f") > 0, F.sum("f")), F.lit(0.0)).alias("context_precision"), F.avg(F.col("f").cast("double")).alias("context_relevance"))
