from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators.perturb import typos


def by_hand(text, key, rate, seed):
    ops = []
    for j, c in enumerate(text):
        h = hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()
        hit = c.isalpha() and int(h[:8], 16) < int(rate * 2**32)
        ops.append((int(h[8:16], 16) % 4 if hit else 4, chr(97 + int(h[16:24], 16) % 26)))
    op = lambda j: ops[j][0] if j >= 0 else 4
    out = []
    for j, c in enumerate(text):
        if op(j - 1) == 0 and op(j - 2) != 0:
            continue
        if op(j) == 0 and op(j - 1) != 0 and j + 1 < len(text):
            out.append(text[j + 1] + c)
        else:
            out.append({1: "", 2: c + ops[j][1], 3: ops[j][1]}.get(op(j), c))
    return "".join(out)


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.6, 1.0])
def test_typos_equal_a_loop(spark, rate):
    texts = ["", "a", "héllo wörld 123!", "日本語 text\n", None, "x" * 300, "The quick brown fox " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["n"] for r in df.select("id", typos(F.col("t"), F.col("id"), rate=rate, seed=3).alias("n")).collect()}
    assert got == {i: None if t is None else by_hand(t, i, rate, 3) for i, t in enumerate(texts)}
    if rate == 0:
        assert list(got.values()) == texts


def test_rates_are_shares():
    with pytest.raises(ValueError):
        typos(None, None, rate=1.5)
