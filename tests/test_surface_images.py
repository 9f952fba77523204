from __future__ import annotations

from lodestone import queries


def test_masks_come_from_the_table(spark, tmp_path):
    spark.range(1, 61).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.QUERIES["surface_distances"](spark, str(tmp_path)).collect()
    assert {r["image"] for r in got} == set(range(1, 61))
    assert all((r["hausdorff"] == 0) == (r["image"] % 3 == 0) for r in got)
