"""Typing errors in texts, the same for the same key and seed wherever they are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typos(text: Column, key: Column, *, rate: float = 0.05, seed: int = 0) -> Column:
    """``text`` in which each letter changes with probability ``rate``: it swaps with the next character, goes, is followed by another
    letter, or becomes one, each as likely. A null text stays null.

    What happens to a letter follows from the MD5 of seed, key and place alone, so rows need no generator and a lost task makes
    the same text again. A letter whose left neighbour swaps does not swap itself; the last character has none to swap with,
    and stays. All of it is JVM expressions.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate is between 0 and 1")
    letters = F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    drawn = F.transform(chars, lambda c, j: F.struct(c.alias("c"), F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), j.cast("string"))).alias("h")))
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    hit = lambda x: x["c"].rlike(r"^\p{L}$") & (part(x["h"], 1) < int(rate * 2**32))
    told = F.transform(drawn, lambda x: F.struct(x["c"].alias("c"), F.when(hit(x), part(x["h"], 9) % 4).otherwise(F.lit(4)).alias("op"), F.element_at(letters, (part(x["h"], 17) % 26 + 1).cast("int")).alias("new")))

    def out(all_: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before, after = F.get(all_, j - 1), F.get(all_, j + 1)
            swaps = (x["op"] == 0) & (F.coalesce(before["op"], F.lit(4)) != 0) & after.isNotNull()
            earlier = F.get(all_, j - 2)
            taken = (F.coalesce(before["op"], F.lit(4)) == 0) & (F.coalesce(earlier["op"], F.lit(4)) != 0)
            return F.when(taken, "").when(swaps, F.concat(after["c"], x["c"])).when(x["op"] == 1, "").when(x["op"] == 2, F.concat(x["c"], x["new"])).when(x["op"] == 3, x["new"]).otherwise(x["c"])

        return F.array_join(F.transform(all_, one), "")

    # the array is bound once by a transform over one element
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(told), out), 1))
