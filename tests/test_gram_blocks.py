from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import gram_blocks
from lodestone.operators.gram_blocks import unique
from lodestone.operators.text import cider


@pytest.fixture
def no_rows_of_grams(monkeypatch):
    """Operators that make a row of each n-gram shuffle more than the disk holds."""

    def refused(*_):
        raise AssertionError("a row for each n-gram")

    monkeypatch.setattr(F, "explode", refused)
    monkeypatch.setattr(F, "posexplode", refused)


def slow_cider(pairs):
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    split = {k: [(x or "").lower().split() for x in v] for k, v in pairs.items()}
    out = {}
    for k, (r, p) in split.items():
        if not r and not p:
            continue
        s = 0.0
        for n in range(1, 5):
            known = Counter(g for a, _ in split.values() for g in grams(a, n).keys())
            idf = lambda g: math.log(len(pairs)) - math.log(max(known[g], 1))  # noqa: B023, E731
            a, b = ({g: c * idf(g) for g, c in grams(w, n).items()} for w in (r, p))
            norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            s += sum(min(b.get(g, 0.0), v) * v for g, v in a.items()) / norm if norm > 0 else 0.0
        out[k] = 10 * s / 4 * math.exp(-((len(p) - len(r)) ** 2) / 72)
    return out


def test_cider_makes_no_row_of_each_gram(spark, no_rows_of_grams):
    rng = random.Random(3)
    words = ["a", "B", "c", "d\n", "é", " e\t", "f,"]
    pairs = {i: [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(2)] for i in range(60)}
    pairs |= {60: ["", ""], 61: [None, None], 62: ["a b c d e", None], 63: [" ", "x y z"], 64: list(pairs[0]), 65: [pairs[1][0], pairs[1][0]]}
    df = spark.createDataFrame([(k, *v) for k, v in pairs.items()], "id long, reference string, prediction string").repartition(5)
    got = {r["id"]: r["cider"] for r in cider(df, "id").collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in slow_cider(pairs).items()}
    assert cider(df.limit(0), "id").count() == 0


def test_names_that_share_their_upper_bits():
    x = np.array([7, 5, 6, 5, 7, 1 << 63, 5], dtype=np.uint64)
    some, first, which = unique(x)
    assert some.tolist() == [5, 6, 7, 1 << 63] and first.tolist() == [1, 2, 0, 5] and some[which].tolist() == x.tolist()
    assert [len(v) for v in unique(x[:0])] == [0, 0, 0]


def test_names_of_words_are_those_of_their_bytes():
    words = ["", "a", "b", "ab", "ba", "aa", "aaa", "\x00", "\x00\x00", "é", "é", *map(str, range(50000))]
    names = gram_blocks.word_names(pa.array(words))
    assert len(set(names.tolist())) == len(words)
    assert gram_blocks.word_names(pa.array(["x", *words, "y"])[1:-1]).tolist() == names.tolist()
    assert gram_blocks.word_names(pa.array([], type=pa.string())).tolist() == []
