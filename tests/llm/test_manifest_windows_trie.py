"""Operators 11 to 13 against brute force: odd inputs on the operators, and the registered queries themselves."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, queries
from lodestone.llm.prefix_trie import prefix_trie, turn_digests
from lodestone.llm.repeated_windows import repeated_windows

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests: list[str], arity: int) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree: list[list[str]], i: int, arity: int) -> list[tuple[int, list[str]]]:
    out = []
    for level in tree[:-1]:
        run = level[i - i % arity : i - i % arity + arity]
        out.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        i //= arity
    return out


def manifest_of(rows: list[tuple], arity: int) -> dict[tuple, list]:
    """{(id, leaf): [(subroot, root, proof)]} of rows (group, id, leaf)."""
    groups = collections.defaultdict(list)
    for group, i, leaf in rows:
        groups[group].append((i is not None, i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))], arity) for g in names}
    top = levels([trees[g][-1][0] for g in names], arity)
    out = collections.defaultdict(list)
    for at, g in enumerate(names):
        for i, (_, key, leaf) in enumerate(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))):
            out[key, leaf].append((trees[g][-1][0], top[-1][0], path(trees[g], i, arity) + path(top, at, arity)))
    return out


@pytest.mark.parametrize(("arity", "span", "seed"), [(2, 4, 0), (2, 1 << 14, 1), (3, 9, 2), (5, 5, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, span, seed):
    monkeypatch.setattr(merkle, "SPAN", span)
    rng = random.Random(seed)
    rows = [(rng.choice([None, "", "a", "b", "é", "Z"]) if rng.random() < 0.7 else "hot", rng.choice([None, *range(60)]), H(str(rng.randint(0, 40)))) for _ in range(130)]
    rows += rows[:9]  # repeated rows
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "g string, i long, leaf string, root string, __range string").repartition(3)
    got = collections.defaultdict(list)
    for r in merkle.manifest(df, order="i", group="g", arity=arity).collect():
        assert r["__range"] == "y"
        got[r["i"], r["leaf"]].append((r["subroot"], r["root"], [(s["slot"], s["siblings"]) for s in r["proof"]]))
    want = manifest_of(rows, arity)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_folds_to_its_root_and_tells_tampering(spark):
    df = spark.createDataFrame([(i, H(str(i))) for i in range(37)], "i long, leaf string")
    proven = merkle.manifest(df, order="i", arity=3)
    checked = proven.select("subroot", "root", merkle.folded(F.col("leaf"), F.col("proof")).alias("a"), merkle.folded(F.lit("0"), F.col("proof")).alias("b")).collect()
    assert all(r["a"] == r["root"] == r["subroot"] != r["b"] for r in checked) and len(checked) == 37
    one = merkle.manifest(df.limit(1), order="i").first()
    assert one["root"] == one["leaf"] and one["proof"] == []
    assert merkle.manifest(df.limit(0), order="i").columns == ["i", "leaf", "subroot", "root", "proof"]
    assert merkle.manifest(df.limit(0), order="i").isEmpty()


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs = [(rng.choice([None, i]), rng.choice(["", None, "é" * 5, "t" * 200_000]), rng.choice([None, "en", "fr"]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    leaf = lambda d, n: H(said(d[0]), said(d[3]), said(d[2]), said(n), said(d[1]))
    proofs = manifest_of([(d[2], d[0], leaf(d, d[4])) for d in docs], 2)
    want = []
    for d in docs:
        key = d[0], leaf(d, d[4])
        sub, root, steps = proofs[key].pop(0)
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
        at = leaf(d, d[4] + 1 if hit and d[4] is not None else d[4])
        for slot, others in steps:
            at = H(*others[:slot], at, *others[slot:])
        want.append((d[0], key[1], sub, root, H(*(o for _, s in steps for o in s)), at, at == root))
    got = [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            name = tuple(words[k : k + window])
            if name in seen:
                gone.update(range(k, k + window))
            seen.add(name)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        edges = [k for k in range(len(words) + 1) if (k in gone) != (k - 1 in gone)]
        out.append((i, len(words), len(gone), list(zip(edges[::2], edges[1::2], strict=True)), hashlib.sha256(kept).hexdigest(), kept.decode() if gone else None))
    return out


@pytest.mark.parametrize(("window", "bucket", "slice_bytes"), [(3, 50, 300), (20, 1 << 21, 8 << 20), (1, 40, 1 << 20)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, window, bucket, slice_bytes):
    from lodestone.llm import repeated_windows as module

    monkeypatch.setattr(module, "SLICE", slice_bytes)
    rng = random.Random(window)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [f"{word()} {passage}\n{t}" for t in texts[:12]] + [texts[3]] * 4 + ["", None, " \t\n", "x " * 50, "x " * 50, "A b c " * 30, "\x1c y" * 25]
    rows = [(rng.choice([None, *range(50)]), t) for t in texts]
    rows += rows[:5] * 2 + [(-3, texts[5]), (7, "long " + "word " * 20_000)]
    df = spark.createDataFrame([(*r, b"k", "z") for r in rows], "doc_id long, text string, key binary, row string").repartition(5)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], [(s["begin"], s["end"]) for s in r["spans"]], r["kept_sha256"], r["kept_text"]) for r in repeated_windows(df, window=window, bucket=bucket).collect()]
    assert sorted(got, key=str) == sorted(without_repeats(rows, window), key=str)


def test_repeated_windows_of_nothing(spark):
    assert repeated_windows(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    short = repeated_windows(spark.createDataFrame([(1, None), (1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in short] == [0, 0, 0]


def trie_of(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(m for m in members if len(convs[m]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(o) == len(key) + 1 for o in below), len(leaves), saved, H(ends)))
    return out


def test_prefix_trie_equals_brute_force(spark):
    rng = random.Random(1)
    convs = {c: [(rng.choice("us"), rng.choice(["", "a", "é"])) for _ in range(rng.randint(0, 6))] for c in range(-3, 60)}
    convs |= {100: [("u", str(k)) for k in range(300)], 101: [("u", str(k)) for k in range(299)] + [("u", "other")], 102: convs[5], 103: convs[5]}
    rows = [(c, k, *t, 1) for c, turns in convs.items() for k, t in enumerate(turns)] + [(None, 0, "u", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long").repartition(4)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = prefix_trie(turn_digests(df), ids)
    listed = [tuple(r)[:8] for r in got.collect()]
    assert sorted(listed, key=str) == sorted(trie_of(convs), key=str)
    places = {r["position"]: r for r in got.collect()}
    assert sorted(places) == list(range(len(places))) and places[0]["subtree_end"] == len(places)
    for p, r in places.items():
        inside = [places[q] for q in range(p, r["subtree_end"])]
        assert sum(x["n_children"] == 0 for x in inside) == r["n_leaves"] and all(x["depth"] > r["depth"] for x in inside[1:])


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(turn_digests(none), none).isEmpty()


def test_op13_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        if c % 5 or rng.random() < 0.8:
            rows += [(c, rng.choice([None, k]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "", None])) for k in range(rng.randint(1, 12))]
    rows += rows[:6] + [(None, 1, "user", "x")]  # repeated rows are turns each; rows of no conversation go
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, H(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    convs = {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    got = [tuple(r) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(trie_of(convs), key=str)
