"""Judges and agreement: ratings tables reduced to counts; small fixpoints run on the driver over m x m tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.durable import written
from lodestone.plans.patterns import ratio, running


def krippendorff_alpha(df: DataFrame, item: str, value: str, level: str = "nominal") -> DataFrame:
    """Alpha for nominal, ordinal, interval or ratio values; null ratings are missing and items with one rating do not pair.
    It is null where all paired ratings are one value. Nominal and interval pairs are counted from values; ordinal and ratio
    ones from the pairs of values that meet in an item, a row for each, never from pairs of ratings."""
    if level not in ("nominal", "ordinal", "interval", "ratio"):
        raise ValueError(f"unknown level {level}")
    known = df.select(F.col(item).alias("item"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = known.groupBy("item", "v").agg(F.count("*").cast("double").alias("c"))
    n_item = counts.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("q"), F.sum(F.col("c") * F.col("c")).alias("cc")).filter("m > 1")
    paired = counts.join(n_item.select("item", "m"), "item")
    pooled = paired.groupBy("v").agg(F.sum("c").alias("c"))
    if level in ("ordinal", "ratio"):
        if level == "ratio":
            far = lambda x, y: F.pow(ratio(x - y, x + y), F.lit(2.0))
            places = pooled.withColumn("x", F.col("v"))
        else:  # the distance of two mid-ranks of the pooled ratings
            far = lambda x, y: F.pow(x - y, F.lit(2.0))
            places = running(pooled, "v", ("c",), descending=False).select("v", "c", (F.col("cum_c") - F.col("c") / 2).alias("x"))
        own = paired.join(places.select("v", "x"), "v").select("item", "m", "c", "x")
        met = own.join(own.select("item", F.col("c").alias("c2"), F.col("x").alias("x2")), "item")
        observed = met.agg(F.sum(F.col("c") * F.col("c2") * far(F.col("x"), F.col("x2")) / (F.col("m") - 1)).alias("o")).crossJoin(n_item.agg(F.sum("m").alias("n")))
        values = places.select("c", "x")
        expected = values.crossJoin(values.select(F.col("c").alias("c2"), F.col("x").alias("x2"))).agg(F.sum(F.col("c") * F.col("c2") * far(F.col("x"), F.col("x2"))).alias("e"))  # distinct values of a rating scale
    elif level == "interval":
        observed = n_item.agg(F.sum((2 * F.col("m") * F.col("q") - 2 * F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
        expected = pooled.agg((2 * F.sum("c") * F.sum(F.col("c") * F.col("v") * F.col("v")) - 2 * F.pow(F.sum(F.col("c") * F.col("v")), 2.0)).alias("e"))
    else:
        observed = n_item.agg(F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
        expected = pooled.agg((F.pow(F.sum("c"), 2.0) - F.sum(F.col("c") * F.col("c"))).alias("e"))
    return observed.crossJoin(expected).select((1 - ratio((F.col("n") - 1) * F.col("o"), F.col("e"), None)).alias("alpha"))


def fleiss_kappa(df: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' kappa of categories; null ratings are left out, items with one rating do not pair, and it is null where all
    ratings fall in one category."""
    known = df.select(F.col(item).alias("item"), F.col(category).alias("v")).filter("v is not null")
    counts = known.groupBy("item", "v").agg(F.count("*").cast("double").alias("c"))
    items = counts.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("p"))
    observed = items.agg(F.avg(ratio(F.col("p"), F.col("m") * (F.col("m") - 1), None)).alias("o"))
    shares = counts.groupBy("v").agg(F.sum("c").alias("c")).agg(ratio(F.sum(F.col("c") * F.col("c")), F.pow(F.sum("c"), 2.0), None).alias("e"))
    return observed.crossJoin(shares).select(ratio(F.col("o") - F.col("e"), 1 - F.col("e"), None).alias("kappa"))


def win_counts(df: DataFrame, a: str, b: str, outcome: str) -> DataFrame:
    """(a, b, wins, n) with each pair once in either direction; ties are half a win."""
    one = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(outcome).cast("double").alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("w")).alias("w")))
    return both.groupBy("a", "b").agg(F.sum("w").alias("wins"), F.count("*").alias("n"))


def bradley_terry(df: DataFrame, a: str, b: str, outcome: str, *, tolerance: float = 1e-10, rounds: int = 10_000) -> dict[object, float]:
    """Log strengths, mean 0, by minorise-maximise steps over the pair counts (a row for each pair of systems)."""
    rows = win_counts(df, a, b, outcome).collect()
    names = sorted({r["a"] for r in rows})
    wins = {m: sum(r["wins"] for r in rows if r["a"] == m) for m in names}
    games = {m: [(r["b"], r["n"]) for r in rows if r["a"] == m] for m in names}
    if any(w <= 0 or w >= sum(n for _, n in games[m]) for m, w in wins.items()):
        raise ValueError("a system that wins or loses all has no finite strength")
    p = dict.fromkeys(names, 1.0)
    for _ in range(rounds):
        q = {m: wins[m] / sum(n / (p[m] + p[o]) for o, n in games[m]) for m in names}
        mean = math.exp(sum(map(math.log, q.values())) / len(q))
        q = {m: v / mean for m, v in q.items()}
        done = max(abs(math.log(q[m] / p[m])) for m in names) < tolerance
        p = q
        if done:
            break
    return {m: math.log(v) for m, v in p.items()}


#: Added to a double and taken off again, it leaves a multiple of 2^-32.
_SNAP = 1.5 * 2.0**20
#: Games of a run, about.
_RUN = 250_000


def elo(df: DataFrame, order: str, a: str, b: str, outcome: str, *, k: float = 4.0, league: str | None = None, run: int = _RUN) -> DataFrame:
    """(league, system, rating): updates one after the other in the order of ``order`` (nulls last), from 1000, a stream for each league.

    A stream is cut into runs of about ``run`` games, played side by side. A run takes each system's rating from the last run before
    that has it. First all start at 1000; then those whose start was another than the run before ended with are played anew, until
    none is. A game moves ratings by less the higher the better one stands, so starts are forgotten and few rounds do; in any case
    a run is final one round after the one before it. Gains are multiples of 2^-32: sums of ratings are exact, and the result is
    that of one stream whatever the runs.
    """
    keyed = df.select((F.col(league).cast("string") if league else F.lit("all")).alias("league"), F.col(order).alias("o"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(outcome).cast("double").alias("w"))
    by = [F.asc("league"), F.asc_nulls_last("o")]
    parts = max(1, -(-keyed.count() // run))
    # Rows that are equal in ``by`` share a range; its sorted games go out in blocks, which keep their number.
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by, "a", "b", "w").select(F.spark_partition_id().alias("run"), "league", "a", "b", "w")
    games = written(ranged.mapInArrow(_blocks, "league string, run int, block int, a array<string>, b array<string>, w array<double>"), "games")

    def play(blocks: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        r = dict(zip(starts["system"], starts["start"], strict=True))
        used: dict[str, float] = {}
        for row in blocks.sort_values("block").itertuples(index=False):
            for x, y, w in zip(row.a.tolist(), row.b.tolist(), row.w.tolist(), strict=True):
                for s in (x, y):
                    if s not in used:
                        used[s] = r.setdefault(s, 1000.0)
                rx, ry = r[x], r[y]
                gain = k * (w - 1 / (1 + 10 ** ((ry - rx) / 400))) + _SNAP - _SNAP
                r[x], r[y] = rx + gain, ry - gain
        first = blocks.iloc[0]
        return pd.DataFrame({"league": first["league"], "run": first["run"], "system": list(used), "used": list(used.values()), "rating": [r[s] for s in used]})

    played = lambda some, starts: some.groupBy("league", "run").cogroup(starts.groupBy("league", "run")).applyInPandas(play, "league string, run int, system string, used double, rating double")
    before = F.coalesce(F.lag("rating").over(Window.partitionBy("league", "system").orderBy("run")), F.lit(1000.0))
    none = df.sparkSession.createDataFrame([], "league string, run int, system string, start double")
    ends = written(played(games, none), "ends")
    while True:
        starts = ends.select("*", before.alias("start"))
        moved = written(starts.filter("not used <=> start").select("league", "run").distinct(), "moved")
        if moved.isEmpty():
            return ends.groupBy("league", "system").agg(F.max_by("rating", "run").alias("rating"))
        open_ = moved.select(F.col("league").alias("l"), F.col("run").alias("n"))
        here = F.col("league").eqNullSafe(F.col("l")) & (F.col("run") == F.col("n"))
        again = played(games.join(open_, here, "left_semi"), starts.join(open_, here, "left_semi").select("league", "run", "system", "start"))
        ends = written(ends.join(open_, here, "left_anti").unionByName(again), "ends")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Games in order, a row for each stretch of one league in a batch."""
    number = 0
    for batch in batches:
        names = batch.column("league")
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if len(names.unique()) > 1 else [0, len(names)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            lists = [pa.array([batch.column(c).slice(lo, hi - lo).to_pylist()], pa.list_(batch.column(c).type)) for c in ("a", "b", "w")]
            yield pa.RecordBatch.from_arrays([names.slice(lo, 1), batch.column("run").slice(lo, 1), pa.array([number], pa.int32()), *lists], ["league", "run", "block", "a", "b", "w"])
            number += 1


def rater_z_scores(df: DataFrame, rater: str, score: str, system: str) -> DataFrame:
    """(system, z): mean of scores standardised within each rater (a rater without spread gives 0)."""
    w = Window.partitionBy(rater)
    sd = F.stddev_samp(score).over(w)
    z = F.when(sd > 0, (F.col(score) - F.avg(score).over(w)) / F.when(sd > 0, sd)).otherwise(0.0)
    return df.select(system, z.alias("z")).groupBy(system).agg(F.avg("z").alias("z"))


def sample_agreement(df: DataFrame, item: str, answer: str) -> DataFrame:
    """(unanimous, pairwise, modal_share) over items: from counts of equal answers."""
    own = df.select(F.col(item).alias("item"), F.col(answer).alias("answer"))
    c = own.groupBy("item", "answer").agg(F.count("*").alias("c")).groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.max("c").alias("top"), F.count("*").alias("k"))
    return c.agg(F.avg((F.col("k") == 1).cast("double")).alias("unanimous"), F.avg(F.when(F.col("n") > 1, F.col("same") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)))).alias("pairwise"), F.avg(F.col("top") / F.col("n")).alias("modal_share"))


def majority_vote(df: DataFrame, item: str, answer: str, position: str, reference: str) -> DataFrame:
    """Share of items whose most frequent answer (ties: seen first) equals the reference."""
    own = df.select(F.col(item).alias("item"), F.col(answer).alias("answer"), F.col(position).alias("position"), F.col(reference).alias("reference"))
    c = own.groupBy("item", "answer").agg(F.count("*").alias("c"), F.min("position").alias("p"), F.min("reference").alias("r"))
    top = c.withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("c"), "p"))).filter("i = 1")
    return top.agg(F.avg((F.col("answer") == F.col("r")).cast("double")).alias("majority_vote_accuracy"))
