"""SPICE: the F-score of matched tuples of a caption's scene graph and its references', one to one.

A scene is a row with the tuples of both sides, so equal ones are met inside the row and no tuple is shuffled. The rest match if all
their words do: as equals, or by a key that both have. Only words that share a key with another word can add to what is equal, so
only tuples with such a word are looked at again, named by a key for each place (``scene_blocks``). Where every tuple of an image has
one name, each name matches as many as the smaller side has. Elsewhere each candidate, in the order of tuples, has the first
reference that is still free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scene_blocks import Cut, keyed_counts
from lodestone.plans.durable import written
from lodestone.plans.patterns import once

#: Between words of a tuple's name; U+0001 inside a word becomes ``_ESCAPED``.
_BETWEEN, _ESCAPED = "\x01\x01", "\x01\x02"


def scenes(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """(image, own, other) of rows (image, words) of both sides: the tuples of an image as arrays."""
    side = lambda rows, own, other: rows.select("image", "words").distinct().select("image", own.alias("own"), other.alias("other"))
    both = side(candidates, F.col("words"), F.lit(None)).unionByName(side(references, F.lit(None), F.col("words")))
    return both.groupBy("image").agg(F.collect_list("own").alias("own"), F.collect_list("other").alias("other"))


def _named(tuples: Column) -> Column:
    """Distinct tuples of one to three words, in lower case and trimmed, each as a string of its size and words; others are left out."""
    flat = F.flatten(tuples)
    text = F.array_join(flat, "", "\x01")  # a null word counts as one to be looked at
    odd = F.contains(text, F.lit(" ")) | F.contains(text, F.lit("\x01")) | F.array_contains(flat, "") | F.exists(tuples, lambda t: ~F.size(t).between(1, 3))
    clean = F.transform(tuples, lambda t: F.transform(t, lambda w: F.replace(F.lower(F.trim(w)), F.lit("\x01"), F.lit(_ESCAPED))))
    good = F.filter(clean, lambda t: F.size(t).between(1, 3) & ~F.array_contains(t, ""))  # null with a null word
    name = lambda t: F.concat(F.size(t).cast("string"), F.array_join(t, _BETWEEN))
    # Words are looked at one by one only where the whole scene has some that need it.
    return F.array_distinct(F.when(odd.eqNullSafe(F.lit(False)), F.transform(tuples, lambda t: F.lower(name(t)))).otherwise(F.transform(good, name)))


def _rows(scenes: DataFrame) -> DataFrame:
    """(image, own, other), a row for each image; only images of several rows are shuffled."""
    several = written(scenes.groupBy("image").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("image").alias("i")), "several")
    rows = scenes.select("image", "own", "other")
    if not several.isEmpty():
        same = F.col("image").eqNullSafe(F.col("i"))
        all_ = lambda c: F.flatten(F.collect_list(c)).alias(c)
        rows = rows.join(several, same, "left_anti").unionByName(rows.join(several, same, "left_semi").groupBy("image").agg(all_("own"), all_("other")))
    return rows


def _whole(scenes: DataFrame) -> DataFrame:
    """``_rows`` with named tuples."""
    named = once(_rows(scenes), ["image"], **{c: F.coalesce(_named(F.col(c)), F.array().cast("array<string>")) for c in ("own", "other")})
    return named.filter((F.size("own") > 0) | (F.size("other") > 0))


def _cleaned(tuples: Column) -> Column:
    """Tuples whose words are in lower case and trimmed; words are looked at one by one only where the scene has some that need it."""
    text = F.array_join(F.flatten(tuples), "\n", " ")  # a null word counts as one to be looked at
    plain = ~F.contains(text, F.lit(" ")) & (F.lower(text) == text)
    return F.when(plain.eqNullSafe(F.lit(True)), tuples).otherwise(F.transform(tuples, lambda t: F.transform(t, lambda w: F.lower(F.trim(w)))))


def _counts(scenes: DataFrame, synonyms: DataFrame | None, cuts: tuple[Cut, Cut] | None = None) -> DataFrame:
    """(image, c1, r1, m1 .. c3, r3, m3, c, r, m): tuples of each size of both sides, and matches."""
    if synonyms is not None:
        rows = _rows(scenes) if cuts else _rows(scenes).select("image", *(_cleaned(F.col(c)).alias(c) for c in ("own", "other")))
        return keyed_counts(rows, synonyms, cuts).withColumns({x: F.col(f"{x}1") + F.col(f"{x}2") + F.col(f"{x}3") for x in "crm"})
    named = _whole(scenes)
    both = F.when(F.col("image").isNotNull(), F.array_intersect("own", "other")).otherwise(F.array().cast("array<string>"))
    sides = once(named, ["image"], c=F.col("own"), r=F.col("other"), m=both)
    of = lambda x, k: F.size(F.filter(x, lambda t: F.startswith(t, F.lit(str(k))))).cast("long")
    sized = sides.select("image", *(F.size(x).cast("long").alias(x) for x in "crm"), *(of(x, k).alias(f"{x}{k}") for x in "crm" for k in (1, 2)))
    return sized.select("image", *(c for x in "crm" for c in (f"{x}1", f"{x}2", (F.col(x) - F.col(f"{x}1") - F.col(f"{x}2")).alias(f"{x}3"))), *"crm")


def _scored(n: DataFrame) -> DataFrame:
    share = lambda x: F.coalesce(F.try_divide(F.col("m").cast("double"), F.col(x)), F.lit(0.0))
    return n.withColumns({"precision": share("c"), "recall": share("r"), "spice": 2.0 * F.col("m") / (F.col("c") + F.col("r"))})


def scene_scores(scenes: DataFrame, synonyms: DataFrame | None = None, cuts: tuple[Cut, Cut] | None = None) -> DataFrame:
    """(image, precision, recall, spice) of every image with a tuple on either side.

    ``scenes`` has (image, own, other: arrays of tuples, arrays of one to three strings); rows of one image are one scene. ``synonyms``:
    (word, key); words match that share a key. Repeated tuples count once; 0 where nothing matches or a side is empty. With synonyms,
    ``own`` and ``other`` may also be arrays of texts, of which ``cuts``, one for each side, make tuples inside the tasks; their words
    are taken as they are.
    """
    return _scored(_counts(scenes, synonyms, cuts)).select("image", "precision", "recall", "spice")


def scene_summary(scenes: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One row (spice, precision, recall, object, attribute, relation): means over images, and the F-scores of tuples of one, two and
    three words over all images."""
    total = lambda k, x: F.sum(f"{x}{k}")
    by_size = (F.coalesce(F.try_divide(2.0 * total(k, "m"), total(k, "c") + total(k, "r")), F.lit(0.0)).alias(name) for k, name in ((1, "object"), (2, "attribute"), (3, "relation")))
    return _scored(_counts(scenes, synonyms)).agg(*(F.avg(c).alias(c) for c in ("spice", "precision", "recall")), *by_size)


def spice_scores(candidates: DataFrame, references: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``scene_scores`` of rows (image, words: array of one to three strings) of both sides; the references of an image are one set."""
    return scene_scores(scenes(candidates, references), synonyms)


def spice(candidates: DataFrame, references: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``scene_summary`` of rows (image, words) of both sides."""
    return scene_summary(scenes(candidates, references), synonyms)
