from __future__ import annotations

from lodestone.llm import chat


def test_repeated_nodes_count_once(spark):
    rows = [(1, 1, None, 0.0, "user", "a"), (1, 2, 1, 0.5, "assistant", "low"), (1, 2, 1, 0.9, "assistant", "high"), (1, 2, 1, 0.9, "assistant", "high"), (1, 3, 2, None, "user", "c"), (1, 3, 2, 0.0, "user", "c")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    paths = chat.root_paths(df).orderBy("place").collect()
    assert [(r["leaf"], r["place"], r["node"]) for r in paths] == [(3, 0, 1), (3, 1, 2), (3, 2, 3)]
    told = chat.format_paths(df).collect()
    assert len(told) == 1 and [t for _, t in chat.parse(told[0]["formatted"])] == ["a", "high", "c"]
    plain = df.dropDuplicates(["tree", "node"])
    assert chat.root_paths(plain, unique=True).count() == 3
