from __future__ import annotations

import random
import zlib

from lodestone.llm import language

KINDS = {"aa": ["the", "ing", "er", "on"], "bb": ["ung", "sch", "ei", "ver"], "cc": ["eau", "oi", "que", "ai"]}


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def prose(rng: random.Random, parts: list[str]) -> str:
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(40))


def test_a_rare_label_shortens_no_other_sample(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, KINDS[k]), k) for i, k in enumerate(list(KINDS) * 60)]
    rare = next(i for i in range(1000, 1100) if not held_out(i))
    docs = spark.createDataFrame([*rows, (rare, "ok", "zz")], "doc_id long, text string, lang string")
    samples = language.training_text(docs)
    assert samples["zz"] == b" ok" and all(len(samples[k]) > 5000 for k in KINDS)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, samples).collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(6)
    parts = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for k in range(80)}
    rows = [(i, prose(rng, parts[k]), k) for i, k in enumerate(list(parts) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.training_text(docs)
    assert set(samples) == set(parts)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, samples).collect()}
    judged = [(i, k) for i, _, k in rows if held_out(i)]
    assert sum(got[i] == k for i, k in judged) >= 0.95 * len(judged)


def test_a_repeated_id_does_not_fill_the_sample(spark):
    rng = random.Random(8)
    one = next(i for i in range(100) if not held_out(i))
    rows = [(one, prose(rng, KINDS["aa"]), "aa") for _ in range(500)] + [(None, "a text without id", "aa"), (one, None, "aa"), (one + 1000, "letters", None)]
    samples = language.training_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(samples) == {"aa"} and len(samples["aa"]) <= language.SAMPLE_ROWS * 700
