"""Plans that many operators share: confusion cube, curves, ranks, bins, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.durable import written


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores, as of a file of one row group, cut into ranges of stored rows for all
    of them, in the stored order, for stages that cost much more than a shuffle of their rows; one of more partitions is left
    alone. The order of rows is the same either way."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    placed = scan.withColumn("__at", F.monotonically_increasing_id())
    return placed.repartitionByRange(cores, "__at").sortWithinPartitions("__at").drop("__at")


def once(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each computed once a row: a plain projection is copied into every later step that reads it, filters included."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """num / den, or ``zero`` (None: null) where den is 0; ANSI division by zero never happens."""
    return F.when(den == 0, F.lit(zero).cast("double")).otherwise(num / F.when(den != 0, den))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n (null where n is 0)."""
    p = k / F.when(n != 0, n)
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / den, (mid + half) / den


def cube(df: DataFrame, truth: str, pred: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, p, w): summed weight of each pair of true and predicted label; partial sums go through the shuffle only."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.sum(w).alias("w"))


def one_vs_rest(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, fp, fn, tn) of each label that is true or predicted somewhere. ``cells`` has a row for each pair of
    labels at most, so everything from here on is small."""
    keys = list(by)
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0.0))
    sides = cells.select(*keys, F.explode(F.array_distinct(F.array(F.col("t"), F.col("p")))).alias("label"), "t", "p", "w")
    counts = sides.groupBy(*keys, "label").agg(
        hit.alias("tp"),
        F.sum(F.when((F.col("p") == F.col("label")) & (F.col("t") != F.col("label")), F.col("w")).otherwise(0.0)).alias("fp"),
        F.sum(F.when((F.col("t") == F.col("label")) & (F.col("p") != F.col("label")), F.col("w")).otherwise(0.0)).alias("fn"),
    )
    counts = counts.withColumn("tp", F.col("tp"))
    total = cells.groupBy(*keys).agg(F.sum("w").alias("n"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))


def running(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """``df`` (one row for each value of ``order`` and group) with ``cum_<c>`` for each c of ``sums``: the total up to the row.

    With groups a window by group does it. Without, rows are dealt to ranges of ``order``; each range adds the total of the
    ranges before it, of which there are as many as partitions, so no task sees all rows.
    """
    key = F.desc(order) if descending else F.asc(order)
    if by:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.sum(c).over(w).alias(f"cum_{c}") for c in sums))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of ranges are sampled anew by each evaluation, so the dealt rows are written once.
    dealt = written(df.repartitionByRange(parts, key).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    w = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *(F.sum(c).over(w).alias(f"cum_{c}") for c in sums)).join(F.broadcast(offsets), "__range")
    return own.select(*df.columns, *((F.col(f"cum_{c}") + F.col(f"__{c}")).alias(f"cum_{c}") for c in sums))


def thresholds(df: DataFrame, truth: str, score: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg, cum_pos, cum_neg) of each distinct score, from the highest: the steps of ROC and PR curves."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(truth).cast("double")
    grouped = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))
    return running(grouped, "score", ("pos", "neg"), by)


def ranks(df: DataFrame, value: str, group: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, [n_<g>], rank): distinct values with their count and mid-rank; ``group`` is kept as rows."""
    counted = df.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    placed = running(counted, "value", ("n",), by, descending=False).withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2)
    if group is None:
        return placed.drop("cum_n")
    own = df.groupBy(*by, F.col(value).cast("double").alias("value"), group).agg(F.count("*").alias("n_group"))
    return own.join(placed.drop("cum_n"), [*by, "value"])


def reached(score: Column, edges: Sequence[float]) -> Column:
    """The number of ``edges`` (ascending) that ``score`` reaches: a balanced tree of comparisons, which compiles, with as many
    steps as the logarithm of their number; null for a null score."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(score < F.lit(edges[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(score.isNotNull(), between(0, len(edges)))


def binned(df: DataFrame, score: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: the number of inner edges k / bins that the score reaches (edges are the literal quotients)."""
    return df.withColumn("bin", reached(F.col(score), [k / bins for k in range(1, bins)]))


def dealt(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, with the number of each row's range as ``__range``. Bounds are sampled anew by each
    evaluation, so the rows are written once. ``order`` should tell rows apart, or equal ones share a range."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    return written(ranged.withColumn("__range", F.spark_partition_id()), "ranges")


def running_by(ranges: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``dealt`` with, for each sum, ``cum_<name>``: its total over the rows of the same group (``by``, without nulls) up
    to this one in ``order``, and ``all_<name>``: over the whole group.

    A window sees a group's rows of one range only; the totals of ranges, a row for each pair of range and group, give what
    lies before. So a group that holds most rows is as many tasks as it has ranges.
    """
    keys = ["__range", *by]
    totals = ranges.groupBy(*keys).agg(*(F.sum(c).alias(f"__own_{n}") for n, c in sums.items()))
    before, whole = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    edges = [x for n in sums for x in (F.coalesce(F.sum(f"__own_{n}").over(before), F.lit(0)).alias(f"__off_{n}"), F.sum(f"__own_{n}").over(whole).alias(f"all_{n}"))]
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.select("*", *(F.sum(c).over(own).alias(f"__run_{n}") for n, c in sums.items())).join(totals.select(*keys, *edges), keys)
    return summed.select(*ranges.columns, *(x for n in sums for x in ((F.col(f"__run_{n}") + F.col(f"__off_{n}")).alias(f"cum_{n}"), F.col(f"all_{n}"))))


#: Keys that ``split_join`` sends to all tasks, at most.
HEAVY = 100_000


def split_join(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, whose keys are unique and whose ``weight`` is the number of rows of a key, of ``total`` in all.

    Keys of more than a ``HEAVY``-th of the rows are at most ``HEAVY``, as weights add up to the total: these are broadcast, so
    a hot key meets no shuffle. The others are joined by shuffle, and none is large.
    """
    heavy, light = table.filter(F.col(weight) * HEAVY > total), table.filter(~(F.col(weight) * HEAVY > total))
    met = rows.join(F.broadcast(heavy), list(on))
    rest = rows.join(F.broadcast(heavy.select(*on)), list(on), "left_anti").join(light, list(on), how)
    return met.unionByName(rest)


def running_extreme(ranges: DataFrame, order: Sequence[str | Column], values: dict[str, tuple[Column, str, bool]], by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``dealt`` with, for each name (column, "max" or "min", from the end?), the extreme of the column over the rows of the
    group up to this one in ``order``, or from it on. As ``running_by``, with one row for each pair of range and group."""
    keys = ["__range", *by]
    pick = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    totals = ranges.groupBy(*keys).agg(*(pick[k][0](c).alias(f"__own_{n}") for n, (c, k, _) in values.items()))
    whole, own = Window.partitionBy(*by).orderBy("__range"), Window.partitionBy(*keys).orderBy(*order)
    before = lambda w, back: w.rowsBetween(1, Window.unboundedFollowing) if back else w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w, back: w.rowsBetween(0, Window.unboundedFollowing) if back else w.rowsBetween(Window.unboundedPreceding, 0)
    edges = [pick[k][0](f"__own_{n}").over(before(whole, back)).alias(f"__off_{n}") for n, (_, k, back) in values.items()]
    run = ranges.select("*", *(pick[k][0](c).over(upto(own, back)).alias(f"__run_{n}") for n, (c, k, back) in values.items())).join(totals.select(*keys, *edges), keys)
    return run.select(*ranges.columns, *(pick[k][1](f"__run_{n}", f"__off_{n}").alias(n) for n, (_, k, _b) in values.items()))


def successor(ranges: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``dealt`` by ``order``, a column that tells them apart, with ``next_<c>`` for each column: its value in the row that
    follows, null in the last. The last row of a range looks at the first one of the next that has rows."""
    first = ranges.groupBy("__range").agg(F.min(F.struct(*dict.fromkeys([order, *columns]))).alias("__first"))
    after = first.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__after"))  # a row a range
    own = Window.partitionBy("__range").orderBy(order)
    led = ranges.withColumn("__next", F.lead(F.struct(*columns)).over(own)).join(after, "__range")
    value = lambda c: F.when(F.col("__next").isNotNull(), F.col("__next")[c]).otherwise(F.col("__after")[c]).alias(f"next_{c}")
    return led.select(*ranges.columns, *(value(c) for c in columns))


def group_percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, <names>): exact percentiles with linear interpolation, null for a group without values. Values are counted, dealt by
    ranges and numbered, so no buffer holds a group's values."""
    names = [f"__g{i}" for i in range(len(by))]
    own = df.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.to_json(F.struct(F.lit(0).alias("x"), *by)).alias("__by"), value.cast("double").alias("__value"))
    counted = own.filter("__value is not null").groupBy("__by", "__value").agg(F.count("*").alias("__n"))
    placed = running_by(dealt(counted, ["__by", "__value"]), ["__value"], {"n": F.col("__n")}, ["__by"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("cum_n") > rank) & (F.col("cum_n") - F.col("__n") <= rank), F.col("__value")))

    def share(q: float) -> Column:
        place = (F.col("all_n") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    found = placed.groupBy(*(["__by"] if by else [])).agg(*(share(q).alias(n) for n, q in shares.items()))
    if not by:
        return found
    head = own.groupBy("__by").agg(*(F.first(n).alias(n) for n in names))
    joined = head.join(found, "__by", "left")
    return joined.select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), *shares)
