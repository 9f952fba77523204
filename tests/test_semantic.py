"""BERTScore, MAUVE and SPICE against loops."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import mauve as mv
from lodestone.operators import spice as sp
from lodestone.operators import token_matching as tm


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("baseline", [None, 0.2])
def test_bertscore_equals_loops(spark, monkeypatch, baseline):
    monkeypatch.setattr(tm, "TOKENS", 7)
    rng = np.random.default_rng(4)
    refs, preds = ({e: (rng.normal(size=(n, 5)), rng.integers(0, 6, n)) for e, n in enumerate(ns)} for ns in ((3, 40, 1, 9, 2), (5, 30, 2, 8, 0)))
    rows = lambda side: [(e, i, [float(v) for v in x[i]], f"t{k[i]}") for e, (x, k) in side.items() for i in range(len(x))]
    r, p = (spark.createDataFrame([*rows(s), (0, 99, [0.0] * 5, "t0"), (1, 98, None, "t1")], "example long, at long, v array<double>, token string").repartition(3) for s in (refs, preds))
    weighted = [tm.token_weights(r, x) for x in (r, p)]
    df = {k: len({0, 1} | {e for e in refs if k in refs[e][1]}) if k in (0, 1) else sum(k in v[1] for v in refs.values()) for k in range(6)}
    df = {k: sum(k in refs[e][1] or (e, k) in ((0, 0), (1, 1)) for e in refs) for k in range(6)}
    idf = lambda k: np.log((5 + 1) / (df[k] + 1))
    for w, (a, b) in ((False, (r, p)), (True, weighted)):
        want = {}
        for e in refs:
            (x, kx), (y, ky) = refs[e], preds[e]
            if not len(y):
                continue
            sim = unit(x) @ unit(y).T
            wx, wy = (np.array([idf(k) if w else 1.0 for k in ks]) for ks in (kx, ky))
            rescale = lambda v: v if baseline is None else (v - baseline) / (1 - baseline)
            if wx.sum() == 0 or wy.sum() == 0:
                continue
            pr, rc = rescale((sim.max(0) * wy).sum() / wy.sum()), rescale((sim.max(1) * wx).sum() / wx.sum())
            want[e] = (pytest.approx(pr), pytest.approx(rc), pytest.approx(2 * pr * rc / (pr + rc)))
        got = {s["example"]: (s["precision"], s["recall"], s["f1"]) for s in tm.bertscore(a, b, baseline=baseline).collect() if s["f1"] is not None}
        assert got == want
    assert tm.bertscore(r.limit(0), p).isEmpty() and tm.bertscore(r, p.limit(0)).isEmpty()


def frontier(p, q, steps=25, c=5.0):
    """The area by thin vertical strips of the polygon through the points, along both axes."""
    kl = lambda a, b: sum(x * np.log(x / y) for x, y in zip(a, b, strict=True) if x > 0)
    pts = [(0.0, 1.0), (1.0, 0.0)] + [(np.exp(-c * kl(q, m)), np.exp(-c * kl(p, m))) for s in np.linspace(1e-6, 1 - 1e-6, steps) for m in [s * p + (1 - s) * q]]
    out = 0.0
    for flip in (1, -1):
        line = sorted((t[::flip] for t in pts), key=lambda t: (t[0], -t[1]))
        out += sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(line)) / 2
    return out


def test_frontier():
    rng = np.random.default_rng(3)
    for _ in range(5):
        p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
        assert mv.mauve_from_histograms(p, q) == pytest.approx(frontier(p, q))
        assert mv.mauve_from_histograms(p, p) == pytest.approx(1.0, abs=1e-6)
    apart = mv.mauve_from_histograms(np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    assert 0 < apart < 0.01


def test_mauve_of_clusters(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(6, 8)) * 5
    rows = []
    for i in range(400):
        side = "h" if i % 2 else "m"
        at = rng.integers(0, 6) if side == "h" else rng.integers(0, 4)
        rows.append((i, side, (middle[at] + rng.normal(size=8) * 0.05).tolist()))
    hist = {s: np.bincount([int(((middle / np.linalg.norm(middle, axis=1, keepdims=True) - np.array(v) / np.linalg.norm(v)) ** 2).sum(1).argmin()) for _, t, v in rows if t == s], minlength=6) for s in "hm"}
    odd = [(900, "h", None), (901, "h", [0.0] * 8), (902, "other", [1.0] * 8), (903, "m", [1.0])]
    df = spark.createDataFrame(rows + odd, "i long, s string, v array<double>").repartition(4)
    got = mv.mauve(df, "s", "v", "i", reference="h", generated="m", buckets=6, variance=0.999).first()
    p, q = hist["h"] / hist["h"].sum(), hist["m"] / hist["m"].sum()
    assert got["mauve"] == pytest.approx(mv.mauve_from_histograms(p, q)) and (got["n_reference"], got["n_generated"], got["buckets"]) == (200, 200, 6)
    again = mv.mauve(df.repartition(2), "s", "v", "i", reference="h", generated="m", buckets=6, variance=0.999).first()
    assert again["mauve"] == pytest.approx(got["mauve"])
    assert mv.mauve(df, "s", "v", "i", reference="none", generated="m").first()["mauve"] is None


def spice_of(cand, ref, keys):
    own, other = ({tuple(w.strip().lower() for w in t) for t in ts} for ts in (cand, ref))
    exact = own & other
    free, n = sorted(other - exact), len(exact)
    same = lambda a, b: len(a) == len(b) and all(x == y or keys.get(x, set()) & keys.get(y, set()) for x, y in zip(a, b, strict=True))
    for c in sorted(own - exact):
        hit = next((r for r in free if same(c, r)), None)
        if hit:
            free.remove(hit)
            n += 1
    return n, len(own), len(other)


def test_spice_equals_loops(spark):
    rng = random.Random(5)
    words = ["dog", "Hound", "cat ", "red", "pink", "on", "by", "mat", "rug"]
    keys = {"dog": {"k1"}, "hound": {"k1", "k2"}, "cat": {"k2"}, "red": {"k3"}, "pink": {"k3"}, "on": {"k4"}, "by": {"k4"}, "mat": {"k5"}, "rug": {"k5"}}
    make = lambda: [tuple(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 9))]
    scenes = {i: (make(), make()) for i in range(25)}
    sides = [spark.createDataFrame([(i, list(t)) for i, s in scenes.items() for t in s[k]], "image long, words array<string>") for k in (0, 1)]
    table = spark.createDataFrame([(w, k) for w, ks in keys.items() for k in ks], "word string, key string")
    for synonyms, known in ((None, {}), (table, keys)):
        got = {r["image"]: r for r in sp.spice_scores(*sides, synonyms).collect()}
        totals = {k: np.zeros(3) for k in (1, 2, 3)}
        for i, (c, r) in scenes.items():
            n, nc, nr = spice_of(c, r, known)
            if nc + nr:
                assert (got[i]["precision"], got[i]["recall"], got[i]["spice"]) == (pytest.approx(n / nc if nc else 0), pytest.approx(n / nr if nr else 0), pytest.approx(2 * n / (nc + nr)))
            for k in (1, 2, 3):
                totals[k] += spice_of([t for t in c if len(t) == k], [t for t in r if len(t) == k], known)
        one = sp.spice(*sides, synonyms).first()
        for k, name in ((1, "object"), (2, "attribute"), (3, "relation")):
            assert one[name] == pytest.approx(2 * totals[k][0] / (totals[k][1] + totals[k][2]))
    assert sp.spice_scores(sides[0].limit(0), sides[1].limit(0), table).isEmpty()


def test_scenes_in_rows_equal_loops(spark):
    rng = random.Random(7)
    words = ["dog", "Hound", " cat", "red\x01", "red", "", "on", "by"]
    keys = {"dog": {"k1"}, "hound": {"k1"}, "on": {"k4"}, "by": {"k4"}}
    make = lambda: [tuple(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))]
    rows = [(i // 2, make(), make()) for i in range(30)]  # two rows an image
    df = spark.createDataFrame(rows, "image long, own array<array<string>>, other array<array<string>>")
    table = spark.createDataFrame([(w, k) for w, ks in keys.items() for k in ks], "word string, key string")
    good = lambda ts: [t for t in ts if 1 <= len(t) <= 3 and all(w.strip() for w in t)]
    for synonyms, known in ((None, {}), (table, keys)):
        want = {}
        for i in {r[0] for r in rows}:
            own, other = (good([t for r in rows if r[0] == i for t in r[k]]) for k in (1, 2))
            n, c, r = spice_of(own, other, known)
            want[i] = 2 * n / (c + r)
        assert {r["image"]: r["spice"] for r in sp.scene_scores(df, synonyms).collect()} == pytest.approx(want)


def test_scene_words_are_split_once_a_text(spark):
    """Each tuple split its whole text anew: 20,000 words took as many splits of the whole text."""
    from lodestone import queries_semantic

    plan = queries_semantic._scenes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower") == 2 and "slice(split(" not in plan


def _scattered(spark, rng, cut):
    """25 scenes of two rows, and one without a name, as tuples or as texts of tuples."""
    words = ["dog", "hound", "cat", "red", "pink", "on", "by", "τh", "a\x01b"]
    make = lambda: [tuple(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 12))]
    rows = [(None if i == 0 else i // 2, make(), make()) for i in range(50)]
    if not cut:
        return rows, spark.createDataFrame(rows, "image long, own array<array<string>>, other array<array<string>>")
    texts = [(i, *(["|".join(" ".join(t) for t in side), None] for side in sides)) for i, *sides in rows]
    return rows, spark.createDataFrame(texts, "image long, own array<string>, other array<string>")


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("several", [False, True])
def test_blocks_of_scenes_equal_loops(spark, monkeypatch, cut, several):
    from lodestone.operators import scene_blocks

    def by_bars(texts):
        tuples = [[t.split(" ") for t in (x or "").split("|") if t] for x in texts.to_pylist()]
        flat = [t for x in tuples for t in x]
        ends = np.cumsum([0, *map(len, flat)])
        at = np.array([[e + k if k < len(t) else -1 for k in range(3)] for e, t in zip(ends[:-1], flat, strict=True)], dtype=np.int64).reshape(-1, 3)
        return pa.array([w for t in flat for w in t], type=pa.string()), at, np.array([len(x) for x in tuples], dtype=np.int64)

    monkeypatch.setattr(scene_blocks, "BLOCK_TUPLES", 60)
    monkeypatch.setattr(scene_blocks, "_SLICE", 2)
    rows, df = _scattered(spark, random.Random(11), cut)
    keys = {"dog": {"k1"}, "hound": {"k1"}, "red": {"k3"}, "pink": {"k3"}, "τh": {"k5"}, "cat": {"k5"}, "on": {"lonely"}}
    if several:
        keys["dog"], keys["red"] = {"k1", "k5"}, {"k3", "k1"}
    table = spark.createDataFrame([(w, k) for w, ks in keys.items() for k in ks] + [(None, "k1"), ("by", None)], "word string, key string")
    want = {}
    for i in {r[0] for r in rows}:
        own, other = ([t for r in rows if r[0] == i for t in r[k]] for k in (1, 2))
        n, c, r = spice_of(own, other, keys)
        if c + r:
            want[i] = 2 * (0 if i is None else n) / (c + r)
    got = sp.scene_scores(df, table, (by_bars, by_bars) if cut else None)
    assert {r["image"]: r["spice"] for r in got.collect()} == pytest.approx(want)


def test_tuples_are_not_written_or_shuffled(spark, monkeypatch):
    """All tuples of one side only were written as texts, and those with a known word shuffled as rows: over 7 times the input."""
    from lodestone.operators import scene_blocks
    from lodestone.plans import durable

    tables = []
    for module in (sp, scene_blocks):
        monkeypatch.setattr(module, "written", lambda df, name: tables.append(df.schema) or durable.written(df, name))
    df = spark.createDataFrame([(i, [["the", "dog"]], [["te", "dog"], ["cat"]]) for i in range(9)], "image long, own array<array<string>>, other array<array<string>>")
    got = sp.scene_scores(df, spark.createDataFrame([("the", "te"), ("te", "te")], "word string, key string"))
    assert {r["spice"] for r in got.collect()} == {2 / 3}
    assert all("array<array" not in f.dataType.simpleString() and f.name not in ("own", "other", "words") for t in tables for f in t)


def test_windows_of_texts_equal_the_scenes(spark):
    from lodestone import queries_semantic

    rows = queries_semantic._scenes(spark, "/root/testdata/sf0.001").orderBy("image").collect()
    pairs = queries_semantic._pairs(spark, "/root/testdata/sf0.001").selectExpr("doc_id", "lower(prediction) as own", "lower(reference) as other").orderBy("doc_id").collect()
    for side in ("own", "other"):
        words, at, n = queries_semantic._windows(pa.array([*(p[side] for p in pairs), None, ""], type=pa.string()), side == "own")
        words, got = words.to_pylist(), []
        for a, k in zip(np.cumsum(n) - n, n, strict=True):
            got.append([[words[j] for j in t if j >= 0] for t in at[a : a + k].tolist()])
        assert got[: len(rows)] == [r[side] for r in rows] and got[len(rows) :] == [[], [[""]]]
