"""Bootstrap intervals, paired bootstrap and comparison of models, for any metric that is an expression of sums.

Each row has a Poisson(1) weight in each replicate, drawn from a hash of its id and the replicate, so the weights of a row are the
same wherever and however often it is read. A task multiplies the weights of a batch with the terms of the metrics and
keeps one vector of replicate sums for each group, which add up like any other partial aggregate: one pass over the
rows, and what is shuffled does not grow with them. The metric's own SQL is then evaluated on the replicate sums.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.catalog import CATALOG, for_spark
from lodestone.operators.exact_tests import accelerated_bounds, delong_test
from lodestone.operators.statistics import adjust_pvalues, mcnemar_p

#: Replicates whose weights are drawn together, and groups whose sums a task holds at a time.
CHUNK, HELD = 64, 64

_CALL = re.compile(r"\b(sum|avg|count|var_pop|min|max|median|quantile|percentile)\(")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * _M1
        x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _poisson_steps() -> np.ndarray:
    share, total, out = math.exp(-1), 0.0, []
    for k in range(20):
        total += share
        out.append(min(int(total * 2.0**64), 2**64 - 1))
        share /= k + 1
    return np.array(out, dtype=np.uint64)


_STEPS = _poisson_steps()


def poisson_weights(rows: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Weights (rows x replicates ``first`` to ``last``) of rows with these 64-bit hashes."""
    with np.errstate(over="ignore"):
        salt = _mixed(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        u = _mixed(rows[:, None] ^ salt[None, :])
    out = np.zeros(u.shape, dtype=np.uint8)
    for step in _STEPS[:8]:
        out += u >= step
    rare = u >= _STEPS[8]
    if rare.any():
        out[rare] = np.searchsorted(_STEPS, u[rare], side="right")
    return out


@dataclass(frozen=True)
class Terms:
    """What the replicate sums hold, and metrics in terms of them: ``sums`` and ``tops`` are SQL of a row's terms (added up; the
    greatest), ``values`` SQL over their columns s0, s1, ..., m0, m1, ... and ``n``, the sum of weights."""

    sums: tuple[str, ...]
    tops: tuple[str, ...]
    values: dict[str, str]


def terms_of(df: DataFrame, metrics: Mapping[str, str]) -> Terms:
    """Splits the aggregates (sum, avg, count(*), var_pop, min, max) of SQL expressions into terms. A quantile is not a function
    of sums, so it is refused."""
    sums: list[str] = []
    tops: list[str] = []
    values: dict[str, str] = {}
    centres: list[tuple[str, str]] = []

    def place(held: list[str], sql: str) -> int:
        if sql not in held:
            held.append(sql)
        return held.index(sql)

    for name, sql in metrics.items():
        out, at = "", 0
        while found := _CALL.search(sql, at):
            depth, end = 1, found.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            kind, inner = found.group(1), sql[found.end() : end - 1].strip()
            some = f"cast({inner} is not null as double)"
            if kind == "sum":
                new = f"s{place(sums, f'cast({inner} as double)')}"
            elif kind == "count" and inner == "*":
                new = "n"
            elif kind == "count":
                new = f"s{place(sums, some)}"
            elif kind == "avg":
                new = f"(s{place(sums, f'cast({inner} as double)')} / nullif(s{place(sums, some)}, 0))"
            elif kind == "var_pop":
                mark = f"__centre{len(centres)}"
                centres.append((mark, inner))
                n = f"nullif(s{place(sums, some)}, 0)"
                one, two = place(sums, f"({inner} - {mark})"), place(sums, f"power({inner} - {mark}, 2)")
                new = f"(s{two} / {n} - power(s{one} / {n}, 2))"
            elif kind in ("min", "max"):
                sign = "-" if kind == "min" else ""
                new = f"({sign}m{place(tops, f'cast({sign}({inner}) as double)')})"
            else:
                raise ValueError(f"{name}: {kind} is not an expression of sums")
            out, at = out + sql[at : found.start()] + new, end
        values[name] = out + sql[at:]
    if centres:
        means = df.agg(*(F.avg(F.expr(inner)).cast("double").alias(mark) for mark, inner in centres)).first()
        for mark, _ in centres:
            sums = [s.replace(mark, f"cast({means[mark] or 0.0!r} as double)") for s in sums]
    return Terms(tuple(sums), tuple(tops), values)


def replicated(df: DataFrame, metrics: Mapping[str, str], ids: Sequence[str], *, by: Sequence[str] = (), strata: str | None = None, replicates: int = 2000, blocks: int = 200, seed: int = 7) -> DataFrame:
    """(by, kind, k, <metric> ...): each metric (name: SQL aggregate) over all rows (kind "whole"), in each replicate, and
    ("without") without each of ``blocks`` blocks of rows, dealt by hash.

    ``ids``: columns that tell rows apart. Weights of a replicate are scaled to the number of rows, in each stratum if ``strata``
    is named. A metric is null where it is not defined. No rows give no groups.
    """
    if replicates < 100 or blocks < 2:
        raise ValueError("at least 100 replicates and 2 blocks are needed")
    terms = terms_of(df, metrics)
    k, m, width = len(terms.sums), len(terms.tops), replicates + blocks + 1
    groups = [f"g{i}" for i in range(len(by) + (strata is not None))]
    keys = [F.col(c).alias(g) for c, g in zip([*by, *([strata] if strata else [])], groups, strict=True)]
    names = [*(f"s{i}" for i in range(k)), *(f"m{i}" for i in range(m))]
    rows = df.select(F.xxhash64(*ids, F.lit(seed)).alias("row"), *keys, *(F.expr(t).cast("double").alias(n) for t, n in zip([*terms.sums, *terms.tops], names, strict=True)))
    kinds = {f.name: f.dataType for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, (sums, tops) in held.items():
                columns = [pa.array([v] * width, type=t) for v, t in zip(group, types, strict=True)]
                tops_ = [pa.array(tops[:, i], mask=np.isneginf(tops[:, i])) for i in range(m)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(width, dtype=np.int32)), pa.array(sums[:, k]), *(pa.array(sums[:, i]) for i in range(k)), *tops_], names=[*groups, "k", "n", *names])
            held.clear()

        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(batch.schema.get_field_index(g)).type for g in groups]
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            plain = batch.select(names).to_pandas().to_numpy(dtype=float) if names else np.zeros((batch.num_rows, 0))
            x = np.column_stack([np.nan_to_num(plain[:, :k], posinf=np.inf, neginf=-np.inf), np.ones(len(hashes))])
            top = np.where(np.isnan(plain[:, k:]), -np.inf, plain[:, k:])
            if groups:
                of = list(zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in groups), strict=True))
                places: dict[tuple, list[int]] = {}
                for i, g in enumerate(of):
                    places.setdefault(g, []).append(i)
                index = {g: np.array(p) for g, p in places.items()}
            else:
                index = {(): np.arange(len(hashes))}
            block = (_mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(blocks)).astype(np.int64)
            for g in index:
                if g not in held:
                    if len(held) >= HELD:
                        yield from flush()
                    held[g] = np.zeros((width, k + 1)), np.full((width, m), -np.inf)
                sums, tops = held[g]
                mine = index[g]
                for first in range(0, replicates, CHUNK):
                    last = min(first + CHUNK, replicates)
                    w = poisson_weights(hashes[mine], first, last, seed)
                    sums[first:last] += w.T.astype(float) @ x[mine]
                    for i in range(m):
                        tops[first:last, i] = np.maximum(tops[first:last, i], np.where(w > 0, top[mine, i][:, None], -np.inf).max(0))
                np.add.at(sums, replicates + block[mine], x[mine])
                sums[-1] += x[mine].sum(0)
                for i in range(m):
                    np.maximum.at(tops[:, i], replicates + block[mine], top[mine, i])
                    tops[-1, i] = max(tops[-1, i], top[mine, i].max())
        yield from flush()

    schema = ", ".join([*(f"{g} {kinds[g].simpleString()}" for g in groups), "k int", "n double", *(f"{n} double" for n in names)])
    own = [f"g{i}" for i in range(len(by))]
    sums_of = [F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(k)))]
    tops_of = [F.max(f"m{i}").alias(f"m{i}") for i in range(m)]
    parts = rows.mapInArrow(run, schema).groupBy(*groups, "k").agg(*sums_of, *tops_of)
    every = Window.partitionBy(*groups)  # a group has a row for each replicate and block
    whole = lambda c: F.max(F.when(F.col("k") == width - 1, F.col(c))).over(every)
    is_copy, is_block = F.col("k") < replicates, (F.col("k") >= replicates) & (F.col("k") < width - 1)
    linear = [c for c in ("n", *(f"s{i}" for i in range(k)))]
    scaled = parts.withColumns({f"all_{c}": whole(c) for c in linear})
    share = F.when(F.col("n") > 0, F.col("all_n") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    before, after = (Window.partitionBy(*groups, is_block).orderBy("k").rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    left = {f"m{i}": F.when(is_block, F.greatest(F.max(f"m{i}").over(before), F.max(f"m{i}").over(after))).otherwise(F.col(f"m{i}")) for i in range(m)}
    tuned = scaled.withColumns({c: F.when(is_copy, F.col(c) * share).when(is_block, F.col(f"all_{c}") - F.col(c)).otherwise(F.col(c)) for c in linear} | left)
    merged = tuned.groupBy(*own, "k").agg(*sums_of, *tops_of)
    kind = F.when(is_copy, "replicate").when(is_block, "without").otherwise("whole")
    valued = merged.select(*own, kind.alias("kind"), "k", *(F.expr(for_spark(v)).cast("double").alias(name) for name, v in terms.values.items()))
    return valued.withColumnsRenamed(dict(zip(own, by, strict=True)))


def bounds(replicates: np.ndarray, estimate: float, without: np.ndarray, level: float, method: str) -> tuple[float, float]:
    """Bounds by "percentile", "basic" or "bca"."""
    tail = (1 - level) / 2
    if method == "bca":
        return accelerated_bounds(replicates, estimate, without, level)
    low, high = (float(q) for q in np.quantile(replicates, [tail, 1 - tail]))
    return (low, high) if method == "percentile" else (2 * estimate - high, 2 * estimate - low)


def _sql(metric: str, params: Mapping[str, object]) -> str:
    return CATALOG[metric].expression(**params) if metric in CATALOG else metric


def _with_weight(df: DataFrame) -> DataFrame:
    return df if "w" in df.columns else df.withColumn("w", F.lit(1.0))


#: The share of replicates without a value beyond which no bounds are given.
MOST_FAILED = 0.1


def bootstrap_intervals(df: DataFrame, metrics: Mapping[str, str] | Sequence[str], ids: Sequence[str], *, by: Sequence[str] = (), strata: str | None = None, replicates: int = 2000, blocks: int = 200, seed: int = 7, level: float = 0.95, method: str = "bca", **params: object) -> DataFrame:
    """(by, metric, estimate, low, high, failed): an interval of each metric in each group.

    ``metrics``: names of the catalogue, or {name: SQL aggregate of sums} over columns of ``df``; a weight ``w`` is 1 where there is
    none. ``failed``: replicates in which the metric is not defined; over a tenth of them, or no estimate, give no bounds.
    Rows with nulls count as SQL aggregates have them.
    """
    if method not in ("bca", "percentile", "basic"):
        raise ValueError("method is bca, percentile or basic")
    chosen = dict(metrics) if isinstance(metrics, Mapping) else {m: _sql(m, params) for m in metrics}
    names = {f"v{i}": sql for i, sql in enumerate(chosen.values())}
    values = replicated(_with_weight(df), names, ids, by=by, strata=strata, replicates=replicates, blocks=blocks, seed=seed)
    groups = [f.name for f in values.schema][: len(by)]

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, v in zip(chosen, names, strict=True):
            estimate = rows.loc[rows["kind"] == "whole", v].iloc[0]
            own, rest = (rows.loc[rows["kind"] == kind, v].to_numpy(dtype=float) for kind in ("replicate", "without"))
            failed = int(np.isnan(own).sum())
            low = high = None
            if failed <= MOST_FAILED * replicates and not np.isnan(estimate):
                low, high = bounds(own[~np.isnan(own)], estimate, rest[~np.isnan(rest)], level, method)
            out.append((*(rows[g].iloc[0] for g in groups), name, None if np.isnan(estimate) else float(estimate), low, high, failed))
        return pd.DataFrame(out, columns=[*groups, "metric", "estimate", "low", "high", "failed"])

    head = "".join(f"`{g}` {values.schema[g].dataType.simpleString()}, " for g in groups)
    grouped = values.groupBy(*groups) if groups else values.groupBy(F.lit(0).alias("one"))
    return grouped.applyInPandas(measure, f"{head}metric string, estimate double, low double, high double, failed long")


def of_model(metric: str, columns: Mapping[str, str], params: Mapping[str, object] | None = None) -> str:
    """The SQL of a catalogue metric with a model's columns in place of the catalogue's."""
    sql = _sql(metric, params or {})
    return re.sub(r"\b\w+\b", lambda word: f"`{columns[word.group()]}`" if word.group() in columns else word.group(), sql) if columns else sql


def macro_f1(truth: str, pred: str, labels: Sequence[object]) -> str:
    """SQL of the mean F1 over these labels, as an expression of sums."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    one = lambda v: f"coalesce(2 * sum(case when `{truth}` = {v} and `{pred}` = {v} then 1.0 else 0.0 end) / nullif(sum(case when `{truth}` = {v} then 1.0 else 0.0 end) + sum(case when `{pred}` = {v} then 1.0 else 0.0 end), 0), 0.0)"
    return f"({' + '.join(one(lit(v)) for v in labels)}) / {float(len(labels))}"


def _paired(values: pd.DataFrame, a: str, b: str, level: float, alternative: str) -> tuple[float, float, float, float]:
    """(difference, low, high, p) of two metrics of the same replicates. p is of the differences moved to 0, never 0 itself."""
    whole = values[values["kind"] == "whole"].iloc[0]
    seen = float(whole[a] - whole[b])
    copies = values[values["kind"] == "replicate"]
    d = (copies[a] - copies[b]).dropna().to_numpy(dtype=float)
    moved = d - seen
    extreme = {"two-sided": np.abs(moved) >= abs(seen), "greater": moved >= seen, "less": moved <= seen}[alternative]
    low, high = np.quantile(d, [(1 - level) / 2, (1 + level) / 2])
    return seen, float(low), float(high), float((1 + extreme.sum()) / (len(d) + 1))


def paired_bootstrap_test(df: DataFrame, a: str, b: str, ids: Sequence[str], *, by: Sequence[str] = (), strata: str | None = None, replicates: int = 2000, seed: int = 7, level: float = 0.95, alternative: str = "two-sided") -> DataFrame:
    """(by, metric_a, metric_b, difference, low, high, p_value) of two SQL aggregates over the same rows (see ``of_model``), which have
    the same weights in each replicate."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative is two-sided, greater or less")
    values = replicated(_with_weight(df), {"va": a, "vb": b}, ids, by=by, strata=strata, replicates=replicates, blocks=2, seed=seed)
    groups = [f.name for f in values.schema][: len(by)]

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows[rows["kind"] == "whole"].iloc[0]
        return pd.DataFrame([(*(rows[g].iloc[0] for g in groups), whole["va"], whole["vb"], *_paired(rows, "va", "vb", level, alternative))], columns=[*groups, "metric_a", "metric_b", "difference", "low", "high", "p_value"])

    head = "".join(f"`{g}` {values.schema[g].dataType.simpleString()}, " for g in groups)
    grouped = values.groupBy(*groups) if groups else values.groupBy(F.lit(0).alias("one"))
    return grouped.applyInPandas(test, f"{head}metric_a double, metric_b double, difference double, low double, high double, p_value double")


def compare_models(df: DataFrame, models: Mapping[str, Mapping[str, str]], metrics: Sequence[str], ids: Sequence[str], *, baseline: str | None = None, strata: str | None = None, replicates: int = 1000, seed: int = 7, level: float = 0.95, correction: str = "holm", alpha: float = 0.05, scores: Mapping[str, str] | None = None, truth: str = "t") -> tuple[DataFrame, DataFrame]:
    """(estimates, tests). ``models``: {model: {catalogue column: own column}}; all have the same rows, and the same weights in each
    replicate. ``estimates``: (metric, model, estimate, low, high). ``tests``: (metric, model_a, model_b, difference, low, high, test,
    p_value, p_adjusted, significant) of every model against ``baseline``, or of all pairs: accuracy by McNemar's test, the ROC
    area of ``scores`` {model: column} by DeLong's, the rest by paired bootstrap; p adjusted within a metric.

    Both results have a row for each metric and model, or pair, so they are put together on the driver.
    """
    if len(models) < 2 or (baseline is not None and baseline not in models):
        raise ValueError("two models at least are compared, of which the baseline is one")
    spark, names, own = df.sparkSession, {}, _with_weight(df)
    for metric in metrics:
        for model, columns in models.items():
            names[f"v{len(names)}"] = metric, model, of_model(metric, columns)
    values = replicated(own, {v: sql for v, (_, _, sql) in names.items()}, ids, strata=strata, replicates=replicates, blocks=2, seed=seed).toPandas()
    if values.empty:
        raise ValueError("no rows")
    at = {(metric, model): v for v, (metric, model, _) in names.items()}
    tail, estimates, tests = (1 - level) / 2, [], []
    for (metric, model), v in at.items():
        copies = values.loc[values["kind"] == "replicate", v].dropna()
        low, high = np.quantile(copies, [tail, 1 - tail]) if len(copies) else (None, None)
        whole = values.loc[values["kind"] == "whole", v].iloc[0]
        estimates.append((metric, model, None if pd.isna(whole) else float(whole), None if low is None else float(low), None if high is None else float(high)))
    order = list(models)
    pairs = [(m, baseline) for m in order if m != baseline] if baseline else [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    for metric in metrics:
        for a, b in pairs:
            difference, low, high, p = _paired(values, at[metric, a], at[metric, b], level, "two-sided")
            test = "paired-bootstrap"
            if metric == "classification.accuracy" and "w" not in df.columns:
                side = {m: f"`{models[m].get('p', 'p')}` = `{models[m].get('t', 't')}`" for m in (a, b)}
                n = df.agg(F.count_if(F.expr(f"({side[a]}) and not ({side[b]})")).alias("b"), F.count_if(F.expr(f"not ({side[a]}) and ({side[b]})")).alias("c")).first()
                test, p = "mcnemar", mcnemar_p(n["b"], n["c"])
            tests.append((metric, a, b, difference, low, high, test, p))
    if scores:
        for a, b in [(a, b) for a, b in pairs if a in scores and b in scores]:
            t = delong_test(df, truth, scores[a], scores[b], level=level)
            tests.append(("roc_auc", a, b, t["difference"], t["low"], t["high"], "delong", t["p_value"]))
    table = spark.createDataFrame(tests, "metric string, model_a string, model_b string, difference double, low double, high double, test string, p_value double").withColumn("pair", F.concat_ws(" - ", "model_a", "model_b"))
    tuned = adjust_pvalues(table.select("metric", "pair", "p_value"), "pair", "p_value", ["metric"]).select("metric", "pair", F.col(correction).alias("p_adjusted"))
    told = table.join(tuned, ["metric", "pair"]).drop("pair").withColumn("significant", F.col("p_adjusted") < alpha)
    return spark.createDataFrame(estimates, "metric string, model string, estimate double, low double, high double"), told
