from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import chat, language, near_duplicates, nearest, packing, quality, substrings, token_store
from lodestone.llm.byte_bpe import ByteBPE, encode_and_decode
from lodestone.llm.licenses import TEMPLATES, scan_licenses
from lodestone.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from lodestone.llm.shared import new_path
from lodestone.llm.tokens import WordEncoder, read_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t", "a", "Don't he'LL x's 'they <|endoftext|> ok", "é ≠ ≠ ̸ ½² Σίσυφος İstanbul ß", "日本語 😀!", "aaaa " * 300, "x" * 5000, "\x00\x1f\x85 z", "'s\n's \t's ''s", "1a2 3.4 _b_"]


def corpus(seed: int = 0, n: int = 60) -> list[str]:
    """Texts with exact and near copies, a passage that several share, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéh") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(k))
    passage, out = prose(90), []
    for i in range(n):
        t = prose(rng.randint(5, 200))
        out.append(t if i % 5 else f"{t} {passage} {prose(20)}")
    base = prose(150).split()
    for i in range(8):
        copy = list(base)
        for k in rng.sample(range(len(copy)), i):
            copy[k] = word()
        out.append(" ".join(copy))
    return out + out[:3] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_word_encoder_equals_the_library():
    own, library = WordEncoder(read_vocabulary(WORD_VOCABULARY), cache=50), Tokenizer.from_file(WORD_VOCABULARY)
    texts = corpus()
    for _ in range(2):
        ids, at = own.encode(pa.array(texts), end=2)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], t


def test_byte_bpe_equals_the_library(spark, docs, empty):
    own, library = ByteBPE(read_vocabulary(BYTE_VOCABULARY), cache=50), Tokenizer.from_file(BYTE_VOCABULARY)
    rng = random.Random(2)
    texts = corpus() + ["".join(rng.choice("  \n\t'strevlmd1é½!😀 日") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, at = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in encode_and_decode(docs, BYTE_VOCABULARY).collect()}
    assert all(got[i]["decoded"] == (t or "") for i, t in enumerate(corpus()))
    assert encode_and_decode(empty, BYTE_VOCABULARY).count() == 0


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(4)
    for _ in range(20):
        ends = np.cumsum(rng.integers(1, 9, size=12))
        cost = rng.integers(0, 5, size=12).astype(float)
        cuts = packing.choose_cuts(ends, cost, 16)

        def price(chosen, ends=ends, cost=cost):
            pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
            steps = np.diff([0, *chosen])
            return None if max(steps) > 16 else sum(map(pad, steps.tolist())) + sum(cost[list(ends).index(c)] for c in chosen)

        best = min(p for m in range(1 << 11) if (p := price([e for k, e in enumerate(ends.tolist()) if k == 11 or m >> k & 1])) is not None)
        assert price(cuts.tolist()) == pytest.approx(best)


def test_packing_keeps_every_id(spark, docs, empty):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    rows = packing.pack_documents(docs, WORD_VOCABULARY, window=128, longest_sentence=32).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_window = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in rows:
        assert r["crc"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]][r["start"]] = r
        by_window[r["sequence_id"]][r["offset"]] = r["length"]
    for i, t in enumerate(corpus()):
        parts = [by_doc[i][s] for s in sorted(by_doc[i])]
        ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(p["doc_tokens"] == len(ids) for p in parts)
    for w in by_window.values():
        at = 0
        for o in sorted(w):
            assert o == at
            at += w[o]
        assert at <= 128
    assert packing.pack_documents(empty, WORD_VOCABULARY).count() == 0


def test_store_round_trip(spark, docs, empty):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    path = new_path(spark, "store")
    token_store.write_store(docs, WORD_VOCABULARY, path)
    got = {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}
    start = 0
    for i, t in enumerate(corpus()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)) and got[i]["ids"] == np.array(ids, dtype="<u4").tobytes()
        start += len(ids)
    none = new_path(spark, "store")
    token_store.write_store(empty, WORD_VOCABULARY, none)
    assert token_store.read_store(spark, none).count() == 0


def test_store_notices_a_changed_chunk(spark, docs):
    path = new_path(spark, "store")
    token_store.write_store(docs.limit(5), WORD_VOCABULARY, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    first = chunks.orderBy("chunk").first()["chunk"]
    spoiled = [(bytes(r["chunk"]), bytes(r["ids"])[::-1] if r["chunk"] == first else bytes(r["ids"])) for r in chunks.collect()]
    spark.createDataFrame(spoiled, "chunk binary, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read_store(spark, path).collect()


@pytest.mark.parametrize("change", ["n_tokens", "lost", "twice", "manifest"])
def test_store_notices_changed_recipes(spark, docs, change):
    path = new_path(spark, "store")
    token_store.write_store(docs.limit(6), WORD_VOCABULARY, path)
    name = "manifest" if change == "manifest" else "recipes"
    rows = spark.read.parquet(f"{path}/{name}").collect()
    schema = spark.read.parquet(f"{path}/{name}").schema
    rows = {"n_tokens": lambda: [r.asDict() | {"n_tokens": r["n_tokens"] + 1} for r in rows], "lost": lambda: rows[:-1], "twice": lambda: rows + rows[:1], "manifest": lambda: [r.asDict() | {"root": bytes(16)} if r["shard"] == -1 else r.asDict() for r in rows]}[change]()
    spark.createDataFrame([r if isinstance(r, dict) else r.asDict() for r in rows], schema).write.mode("overwrite").parquet(f"{path}/{name}")
    with pytest.raises(Exception, match="manifest|missing"):
        token_store.read_store(spark, path)


def test_store_keeps_repeated_and_null_ids(spark):
    path = new_path(spark, "store")
    rows = [(None, "b", 1), (3, "a", 2), (3, None, 3), (1, "c c c", 4)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string, shard int"), WORD_VOCABULARY, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read_store(spark, path).collect())
    assert [g[1] for g in got] == [None, 1, 3, 3] and got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_quality_features_by_brute_force(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality.apply_rules(docs).collect()}
    for i, t in enumerate(corpus()):
        words = WORD.findall(t or "")
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(5, 60) if not got[i]["base_failed"])
    assert quality.apply_rules(empty).count() == 0
    assert "row" in quality.apply_rules(docs, carry=True).columns


def test_quality_verdicts_by_brute_force(spark, docs, monkeypatch):
    """``kept`` and ``rejected_by`` against every rule asked on every text alone, in whatever order the cascade asks them."""
    each = lambda f: " ".join(map(f, range(40)))
    texts = corpus() + [each(lambda i: f"WORD{i}"), each(lambda i: f"w{i}!"), each(lambda i: f"#|w{i}"), each(lambda i: f"same\nsame\nu{i} v{i}\n"), each(lambda i: f"a a a u{i}"), each(lambda i: f"{i}" * 40), each(lambda i: f"W{i}!#")]
    own = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    for rules in (quality.RULES, quality.RULES[::-1]):
        monkeypatch.setattr(quality, "measured", lambda docs, given: given)
        got = {r["row"]["n_words"]: r for r in quality.apply_rules(own, rules, carry=True).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            f = quality.Features(pa.array([t], type=pa.string()))
            by = "base" if f.base_failed[0] else next((r.name for r in rules if r.rejects(quality.Features(pa.array([t], type=pa.string())))[0]), None)
            assert (got[i]["rejected_by"], got[i]["kept"]) == (by, by is None)
        assert len({r.name for r in rules} & {g["rejected_by"] for g in got.values()}) >= 5


def test_repeated_windows_by_ranks_agree():
    texts = pa.array(["a b c d e f g h i a b c d e f g h", "x " * 20])
    f = quality.Features(texts)
    codes, first = f.words.codes.astype(np.int64), f.words.first
    doc = np.repeat(np.arange(2), np.diff(first))
    at = np.flatnonzero(doc[: len(codes) - 7] == doc[7:])
    left, right = f._twice_by_ranks(codes, doc, at)
    assert set(left) | set(right) == {0, 9, *range(17, 30)} and f.n_repeat_words.tolist() == [16, 20]


def test_language_on_held_out_rows(spark, empty):
    rng = random.Random(5)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(40))
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["ung", "sch", "ei", "ver"], "cc": ["eau", "oi", "que", "ai"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * 60)] + [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.training_text(docs)
    assert set(samples) == set(kinds) and len(set(map(len, samples.values()))) == 1
    got = {r["doc_id"]: r for r in language.identify(docs, samples).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:180] if zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, {}).filter("lang_pred <> 'und'").isEmpty() and language.training_text(empty.withColumn("lang", F.lit("x"))) == {}


def parsed(sample: bytes, text: bytes) -> int:
    """Phrases of a greedy parse by search in the sample, stretch by stretch."""
    count = 0
    for begin in range(0, len(text), language.STRETCH):
        part, i = text[begin : begin + language.STRETCH], 0
        while i < len(part):
            n = 0
            while i + n < len(part) and part[i : i + n + 1] in sample:
                n += 1
            i, count = i + max(n, 1), count + 1
    return count


def normal(text: str | None) -> bytes:
    return "".join(" " + w for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()).encode()


def test_language_by_brute_force(spark):
    """Every row against plain parses: nulls, odd and very long texts, repeated ids, a column named row."""
    rng = random.Random(6)
    samples = {k: normal("".join(rng.choice(v) for _ in range(900))) for k, v in {"a": "abc de", "b": "bcdef ", "c": "éabß f", "d": "x"}.items()}
    texts = [*ODD, *("".join(rng.choice("abcdefé ß-") for _ in range(rng.randint(0, 900))) for _ in range(40)), "".join(rng.choice("abc d") for _ in range(200_000))]
    docs = spark.createDataFrame([(i % 30 if i != 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    weights = {k: np.log(max(len(v), language.ALLOWANCE_BYTES)) for k, v in samples.items()}
    got = {r["row"]["row"]: r for r in language.identify(docs, samples, carry=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["doc_id"] == (i % 30 if i != 3 else None)
        if not normal(t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["phrases"]) == ("und", 0.0, 0)
            continue
        counts = {k: parsed(v, normal(t)) for k, v in samples.items()}
        best, second = sorted(samples, key=lambda k: (counts[k] * weights[k], k))[:2]
        assert (got[i]["lang_pred"], got[i]["phrases"]) == (best, counts[best])
        assert got[i]["score"] == pytest.approx(1 - counts[best] * weights[best] / (counts[second] * weights[second]))


def test_near_duplicates_by_brute_force(spark, docs, empty):
    sets = {}
    for i, t in enumerate(corpus()):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    got = near_duplicates.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_buckets_of_many_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(12):
        copy = list(base)
        for k in rng.sample(range(120), 4):
            copy[k] = f"v{i}_{k}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = near_duplicates._sketched(df, 4)
    classes = sketched.select(F.col("doc_id").alias("id"), "digest", "n", "regs")
    none = spark.createDataFrame([], "id long, component long")
    links = near_duplicates._apart(near_duplicates._banded(classes, near_duplicates.band_rows(60)), none, classes, df, 4, 60).collect()
    grams = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    similar = lambda a, b, percent: 100 * len(grams[a] & grams[b]) >= percent * len(grams[a] | grams[b])
    part = {i: i for i in grams}
    for r in links:
        assert similar(r["a"], r["b"], 60)
        old, new = part[r["a"]], part[r["b"]]
        part = {i: new if p == old else p for i, p in part.items()}
    assert all(part[i] == part[j] for i in grams for j in range(i) if similar(i, j, 72))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, size=(2, 800), dtype=np.uint64)
    union = np.unique(np.concatenate([a, b]))
    ra, rb, ru = near_duplicates.registers([np.unique(a), np.unique(b), union])
    assert np.array_equal(np.maximum(ra, rb), ru)
    close = np.concatenate([a[:750], b[:50]])
    rows = near_duplicates.registers([a, close, b])
    n = np.array([800.0, 800.0])
    assert near_duplicates.likely(rows[[0, 0]], rows[[1, 2]], n, n, 0.8).tolist() == [True, False]


def test_repeats_by_brute_force(spark, docs, empty):
    length, texts = 60, [(t or "").encode() for t in corpus()]
    count = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, length=length, gram=16, span=8).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r["kept"] == "x"
    assert substrings.remove_repeats(empty).count() == 0


def test_chat_round_trip_and_mask(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b \\", "<s>[INST]", "<<SYS>>x<</SYS>>", "[/INST", "<", "", None, "<r:x>", "é😀"]
    rows = [(c, t, r, hard[(c + t) % len(hard)]) for c in range(10) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "tool"])]
    rows += [(50, 0, None, "hi"), (51, 0, "assistant", "only"), (None, 0, "user", "lost"), (52, 1, "user", "same"), (52, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat.format_paths(chat.conversation_messages(df)).collect()}
    assert set(got) == {*range(10), 50, 51, 52, chat.NO_CONVERSATION}
    for c in range(10):
        said = [(r, t or "") for k, _, r, t in rows if k == c]
        assert list(chat.parse(got[c]["formatted"])) == said
        masked = [chat.unescaped(got[c]["formatted"][s["begin"] : s["end"]]) for s in got[c]["spans"]]
        assert masked == [t for r, t in said if r == "assistant"]
    assert got[52]["n_turns"] == 2


def test_reply_trees_give_the_best_paths(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 4, 9.0), (2, 1, None, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0)], "tree long, node long, parent long, score double")
    paths = collections.defaultdict(list)
    for r in chat.root_paths(nodes.filter("tree < 3")).orderBy("place").collect():
        paths[r["tree"], r["leaf"]].append(r["node"])
    assert paths == {(1, 2): [1, 2], (1, 5): [1, 3, 4, 5], (2, 1): [1]}
    best = chat.root_paths(nodes.filter("tree = 1"), best=1).select("leaf").distinct().collect()
    assert [r["leaf"] for r in best] == [5]
    assert chat.root_paths(nodes.filter("tree = 3")).isEmpty()
    hung = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 1.0), (1, 4, 3, 1.0), (1, 7, None, 0.0), (1, 8, 7, 0.0)], nodes.schema)
    assert [(r["leaf"], r["node"]) for r in chat.root_paths(hung, best=1).orderBy("place").collect()] == [(8, 7), (8, 8)]


def test_best_paths_by_brute_force(spark):
    rng = random.Random(4)
    rows, scores, parents = [], {}, {}
    for tree in range(12):
        for node in range(rng.randint(1, 40)):
            parents[tree, node] = rng.randrange(max(0, node - 3), node) if node and rng.random() < 0.95 else None
            scores[tree, node] = rng.choice([0.0, 1.0, 2.5, -1.0])
            rows.append((tree, node, parents[tree, node], scores[tree, node] if node % 9 else None))
            scores[tree, node] = scores[tree, node] if node % 9 else 0.0
    want = {}
    for tree in range(12):
        mine = [n for t, n in parents if t == tree]
        ranked = []
        for leaf in set(mine) - {parents[tree, n] for n in mine}:
            path = [leaf]
            while (up := parents[tree, path[0]]) is not None:
                path.insert(0, up)
            ranked.append((-sum(scores[tree, n] for n in path) / len(path), leaf, path))
        want |= {(tree, leaf): path for _, leaf, path in sorted(ranked)[:2]}
    got = collections.defaultdict(list)
    for r in chat.root_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), best=2).orderBy("place").collect():
        got[r["tree"], r["leaf"]].append(r["node"])
    assert got == want


@pytest.mark.parametrize("percent", [50, 70])
def test_near_duplicates_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(60)]
        texts.append(" ".join(base))
        texts.append(" ".join(base[:-rng.randint(1, 30)] + [word() for _ in range(rng.randint(0, 6))]))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    want = [100 * len(sets[i] & sets[i + 1]) >= percent * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, percent=percent).collect()}
    assert 5 < sum(want) < 40 and [got[i] == got[i + 1] for i in range(0, 80, 2)] == want
    with pytest.raises(ValueError, match="cannot find"):
        near_duplicates.near_duplicates(df, percent=5)


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    x[100:160] = x[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9020, [1.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, every=500, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    d = x.astype(np.float64)
    for q in range(0, 9000, 500):
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(9000), -s)).tolist() if i != q][:20]
        assert len(got[q]) == 20 and all(s[i] == pytest.approx(v) for i, v in got[q])
        hits += len(set(order) & {i for i, _ in got[q]})
        total += 20
    assert hits / total >= 0.9 and set(got) == set(range(0, 9000, 500))
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_few_vectors_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest.nearest(df).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]


def test_licences_by_brute_force(spark, docs, empty):
    texts, rng = corpus(), random.Random(11)
    planted = {2: "mit", 7: "apache-2.0", 9: "gpl-3.0-header", 11: "cc-by-nc-4.0", 20: "mit-text"}
    rows = [(i, f"{t}\n{TEMPLATES[planted[i]].upper() if i == 7 else TEMPLATES[planted[i]]} {t}" if i in planted else t) for i, t in enumerate(texts)]
    rows += [(400 + i, f"{rng.choice(texts)} {TEMPLATES[n]}") for i, n in enumerate(sorted(TEMPLATES))] + [(None, TEMPLATES["mit"]), (11, rows[11][1]), (500, "word " * 50_000 + TEMPLATES["isc-text"] + " word" * 50_000)]
    words = lambda t: [w for w in ("".join(c for c in x.lower() if c.isascii() and c.isalnum() or not c.isascii()) for x in WORD.findall(t or "")) if w]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    sets = {n: shingles(words(t)) for n, t in TEMPLATES.items()}
    want = collections.Counter()
    for i, t in rows:
        own = shingles(words(t))
        want.update((i, n, round(len(own & s) / len(s), 9)) for n, s in sets.items() if len(own & s) >= 0.8 * len(s))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["template"], round(r["containment"], 9)) for r in found) == want
    for i, n in planted.items():
        before = len(WORD.findall(texts[i]))
        assert next((r["first_word"], r["n_words"]) for r in found if (r["doc_id"], r["template"]) == (i, n)) == (before, len(TEMPLATES[n].split()))
    assert len(sets) == len(TEMPLATES) and all(sets.values())
    assert scan_licenses(empty).count() == 0
