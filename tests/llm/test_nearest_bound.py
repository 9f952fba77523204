from __future__ import annotations

import collections

import numpy as np
import pytest

from lodestone.llm import nearest


def grouped(noise: float) -> np.ndarray:
    """A hot third of the rows in one tight group, the last of the table; the others in 40 wide ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    wide = centres[np.sort(rng.integers(0, 40, 8000))] + rng.normal(size=(8000, 32))
    x = np.concatenate([wide, rng.normal(size=32) + noise * rng.normal(size=(4000, 32))])
    x[-30:] = x[-31]
    return x


@pytest.mark.parametrize("noise", [0.03, 0.06])
def test_a_hot_group_and_rows_in_its_order_lose_no_neighbour(spark, noise):
    x = grouped(noise)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, every=300, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, len(x), 300):
        s = np.einsum("nd,d->n", x, x[q])
        assert got[q] == [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:20]


def test_the_sample_is_spread_over_the_table(spark):
    df = spark.range(40000).selectExpr("id as vec_id", "array(cast(id as double), 1.0D) as embedding").coalesce(1)
    place = nearest._sample(df, 40000)[:, 0]
    assert 3500 < len(place) < 4700 and all(300 < ((place >= lo) & (place < lo + 5000)).sum() < 750 for lo in range(0, 40000, 5000))


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_results_do_not_depend_on_partitions(spark, parts):
    """Recall is 1 however the rows lie, blocks are small or repeat; a repeated id is one query and one candidate."""
    x = grouped(0.05)[::4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in (0, 0, 300, 5)] + [(7, (x[7] * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, every=300, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, len(x), 300):
        s = np.einsum("nd,d->n", x, x[q])
        s[7] = max(s[7], 3 * s[7])
        assert got[q] == [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:20]
