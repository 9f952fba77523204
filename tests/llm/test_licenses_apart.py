"""Each licence text names its own licence, and only that."""

from __future__ import annotations

from lodestone.llm.licenses import TEMPLATES, scan_licenses


def test_each_template_alone_is_told_as_itself(spark):
    rows = [(i, f"Some words before. {TEMPLATES[n]} And some words after it.") for i, n in enumerate(TEMPLATES)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), overlapping=False).collect()
    names = list(TEMPLATES)
    told = {}
    for r in got:
        told.setdefault(names[r["doc_id"]], set()).add(r["template"])
    assert told == {n: {n} for n in names}


def test_licences_in_other_places_stay(spark):
    gap = "word " * 300
    both = f"{TEMPLATES['gpl-2.0-header']} {gap} {TEMPLATES['gpl-3.0-header']} {gap} {TEMPLATES['bsd-2-clause-text']} {gap} {TEMPLATES['bsd-3-clause']}"
    got = {r["template"]: r for r in scan_licenses(spark.createDataFrame([(1, both)], "doc_id long, text string"), overlapping=False).collect()}
    assert set(got) == {"gpl-2.0-header", "gpl-3.0-header", "bsd-2-clause-text", "bsd-3-clause"}
    assert all(r["containment"] == 1.0 for r in got.values())
    assert got["bsd-3-clause"]["first_word"] > got["bsd-2-clause-text"]["first_word"] + 200


def test_a_damaged_text_is_told_as_the_nearest(spark):
    words = TEMPLATES["bsd-2-clause-text"].split()
    damaged = " ".join(w if k % 40 else "changed" for k, w in enumerate(words))
    got = {r["template"] for r in scan_licenses(spark.createDataFrame([(1, damaged)], "doc_id long, text string"), overlapping=False).collect()}
    assert got == {"bsd-2-clause-text"}
    assert scan_licenses(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), overlapping=False).isEmpty()
