"""The registered queries that promise an order, at several numbers of partitions."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ordered")
    rng = random.Random(3)
    rows = [(i * 2, " ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 900))), "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_packing_keeps_the_stored_order(spark, folder):
    path, rows = folder
    assert spark.read.parquet(f"{path}/documents.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    pieces = sorted(queries.op4_packing(spark, path).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order = [(r["doc_id"], r["start"]) for r in pieces]
    assert order == sorted(order)
    assert {r["doc_id"] for r in pieces} == {r[0] for r in rows}


def test_documents_are_in_the_stored_order(spark, folder):
    path, rows = folder
    assert [r["doc_id"] for r in queries.documents(spark, path).collect()] == [r[0] for r in rows]
