from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone import queries
from lodestone.operators import text


def rows_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rows_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def searched_shifts(ref, hyp, longest=10, furthest=50):
    """Greedy block shifts without a bound."""
    best, shifts, size = rows_edits(hyp, ref), 0, len(ref)
    while best:
        found = None
        for i in range(len(hyp)):
            for n in range(1, min(longest, len(hyp) - i) + 1):
                block = hyp[i : i + n]
                at = [j for j in range(len(ref) - n + 1) if ref[j : j + n] == block]
                if not at:
                    break
                for j in at:
                    if 0 < abs(i - j) <= furthest and hyp[j : j + n] != block:
                        rest = hyp[:i] + hyp[i + n :]
                        moved = rest[:j] + block + rest[j:]
                        d = rows_edits(moved, ref)
                        if d + 1 < best and (found is None or d < found[0]):
                            found = (d, moved)
        if found is None:
            break
        best, hyp, shifts = found[0], found[1], shifts + 1
    return [best + shifts, size]


def test_recursions_by_brute_force():
    rng = random.Random(4)
    for k in range(150):
        a, b = ([rng.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rng.randint(0, 90 if k % 5 == 0 else 14))] for _ in range(2))
        assert text._edits(a, b) == rows_edits(a, b) and text.lcs(a, b) == rows_lcs(a, b)
        if len(a) < 15:
            assert text.translation_edits(" ".join(b), " ".join(a)) == searched_shifts(b, a)


def test_character_grams_by_counting():
    rng = random.Random(8)
    for letters in ("ab", "abc é", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        for size in (0, 1, 4, 3000):
            r, p = ("".join(rng.choice(letters) for _ in range(size + k)) for k in (0, 2))
            want = []
            for n in range(1, 7):
                a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in ("".join(p.split()), "".join(r.split())))
                want += [sum((a & b).values()), sum(a.values()), sum(b.values())]
            assert text.chrf_statistics(r, p) == want


def test_pairs_hold_every_word_and_scores_see_them(spark, tmp_path):
    rng = random.Random(2)
    words = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(3000)]
    spark.createDataFrame([(1, " \n".join(words)), (2, "a b"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [w for i, w in enumerate(words) if (i + 1) % 5]
    pairs = {r["doc_id"]: (r["reference"].split(), r["prediction"].split()) for r in queries._pairs(spark, str(tmp_path)).collect()}
    assert pairs[1] == (words, kept) and pairs[2] == (["a", "b"], ["a", "b"])
    assert queries.QUERIES["ter"](spark, str(tmp_path)).first()["ter"] == pytest.approx(100 * 600 / 3002)
    for name in ("token_f1", "rouge_1", "rouge_l"):
        got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[1]["recall"] == pytest.approx(2400 / 3000) and got[1]["precision"] == 1.0
    assert len(queries.QUERIES["meteor"](spark, str(tmp_path)).collect()) == 3
