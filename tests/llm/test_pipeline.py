from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "on", "sh", "an"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [prose(150) for _ in range(30)]
    passage = prose(120)
    rows = list(enumerate(clean))
    rows += [(100, clean[0]), (101, clean[1] + " more"), (102, prose(50) + " " + passage + " " + prose(50)), (103, prose(60) + " " + passage + " " + prose(40)), (104, "12 34 !!"), (105, None), (106, "spam " * 200), (107, "few words")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(30)) <= set(kept["substrings"])
    assert {104, 105} & set(kept["language"]) == set() and {106, 107} & set(kept["quality"]) == set()
    assert {100, 101} & set(kept["near_duplicates"]) == set()
    assert passage not in kept["substrings"][102] and passage not in kept["substrings"][103]
    assert kept["substrings"][5] == clean[5]
    assert docs.filter(F.col("n_chars") != F.length("text")).isEmpty()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["substrings"])
