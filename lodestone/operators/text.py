"""Text metrics: n-gram counts by plans where the metric is a sum, scores by row in Arrow batches where it is a recursion."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.gram_blocks import Block, gram_scores, unique


def normalized(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an, the; single blanks."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Array of n-grams, joined by U+0001; none if there are fewer words. Shifted slices are zipped, so ``words`` is computed
    a fixed number of times, not once for each position."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), count), lambda a, b: F.concat(a, F.lit("\x01"), b))
    return out


def overlap(df: DataFrame, key: str, reference: Column, prediction: Column, n: int = 1) -> DataFrame:
    """(key, hits, n_ref, n_pred): clipped matches of the n-grams of two word arrays; both sides are counted in one shuffle."""
    side = lambda words, r, p: F.transform(ngrams(words, n), lambda g: F.struct(g.alias("g"), F.lit(r).alias("r"), F.lit(p).alias("p")))
    both = df.select(F.col(key).alias("__key"), F.explode_outer(F.concat(side(reference, 1, 0), side(prediction, 0, 1))).alias("__x")).select("__key", "__x.*")
    grams = both.groupBy("__key", "g").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    counts = grams.groupBy("__key").agg(F.sum(F.least("r", "p")).alias("hits"), F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"))
    return counts.withColumnRenamed("__key", key)


def overlap_scores(df: DataFrame, key: str, reference: Column, prediction: Column, n: int = 1) -> DataFrame:
    """(key, precision, recall, f1) of n-gram overlap; 0 where a side is empty, 1 where both are."""
    o = overlap(df, key, reference, prediction, n)
    share = lambda den: F.when(F.col(den) == 0, (F.col("n_ref") + F.col("n_pred") == 0).cast("double")).otherwise(F.col("hits") / F.when(F.col(den) != 0, F.col(den)))
    f1 = F.when(F.col("n_ref") + F.col("n_pred") == 0, 1.0).otherwise(2 * F.col("hits") / F.when(F.col("n_ref") + F.col("n_pred") != 0, F.col("n_ref") + F.col("n_pred")))
    return o.select(key, share("n_pred").alias("precision"), share("n_ref").alias("recall"), f1.alias("f1"))


def rouge_words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def distinct_n(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    """Distinct n-grams by all n-grams of all texts."""
    g = df.select(F.explode(ngrams(tokens(F.col(text)), n)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    return g.agg((F.count("*") / F.sum("c")).alias(f"distinct_{n}"))


def exact_match(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((normalized(F.col(reference)) == normalized(F.col(prediction))).cast("double")).alias("exact_match"))


def scored(df: DataFrame, function: Callable[[str, str], Sequence[float]], names: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """``df`` with one double column for each name, in place of one that it has: ``function`` of each row's two texts (null: empty),
    in Arrow batches."""
    kept = [f for f in df.schema if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [function(r or "", p or "") for r, p in zip(b[reference], b[prediction], strict=True)]
            out = b[[f.name for f in kept]].copy()
            for i, n in enumerate(names):
                out[n] = [float(v[i]) for v in values]
            yield out

    return df.mapInPandas(run, schema)


#: The public 13a rules: separate symbols; periods and commas unless between digits; dashes after digits.
_RULES = ((re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))

#: The character references that 13a decodes, in this order.
_REFERENCES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(line: str) -> list[str]:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, sign in _REFERENCES:
        line = line.replace(name, sign)
    line = f" {line} "
    for rule, out in _RULES:
        line = rule.sub(out, line)
    return line.split()


def bleu_statistics(reference: str, prediction: str) -> list[float]:
    """Matches and totals of orders 1 to 4, length of prediction and reference: they add up over a corpus."""
    r, p = tokens_13a(reference), tokens_13a(prediction)
    known: dict[str, int] = {}
    words = np.array([known.setdefault(w, len(known)) for w in (*r, *p)], dtype=np.int64)
    out: list[float] = []
    for hit, a, _ in _gram_counts(words, max(len(known), 1), len(r), len(p), 4):
        out += [hit, a]
    return [*out, len(p), len(r)]


def bleu_from(stats: Sequence[float], effective: bool = False) -> float:
    """0 to 100, exponential smoothing; ``effective``: only orders that have n-grams count."""
    logs, smooth, used = 0.0, 1.0, 0
    for hit, total in zip(stats[0:8:2], stats[1:8:2], strict=True):
        if total == 0:
            break
        used += 1
        if hit == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * total))
        else:
            logs += math.log(hit / total)
    if not used or not effective and used < 4 or stats[8] == 0 or not any(stats[0:8:2]):
        return 0.0
    short = 1.0 if stats[8] >= stats[9] else math.exp(1 - stats[9] / stats[8])
    return 100 * short * math.exp(logs / used)


BLEU_COLUMNS = [f"{k}{n}" for n in range(1, 5) for k in ("hit", "total")] + ["pred_len", "ref_len"]


def bleu(df: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Corpus BLEU: sums of statistics by row, then the formula on one row."""
    sums = scored(df.select(reference, prediction), bleu_statistics, BLEU_COLUMNS, reference, prediction).agg(*(F.sum(c).alias(c) for c in BLEU_COLUMNS))
    formula = F.udf(lambda *s: bleu_from([x or 0.0 for x in s]), "double")  # one row
    return sums.select(formula(*BLEU_COLUMNS).alias("bleu"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Clipped matches of two multisets."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _gram_counts(codes: np.ndarray, base: int, n_r: int, n_p: int, order: int) -> Iterator[tuple[int, int, int]]:
    """(clipped matches, n-grams of the prediction, of the reference) for n from 1 to ``order``; ``codes``, under ``base``: those of
    the reference, then of the prediction. An n-gram is one integer, renumbered before it overflows."""
    grams, span = codes, base
    for n in range(1, order + 1):
        if n > 1:
            if span > (1 << 62) // base:
                some, grams = np.unique(grams, return_inverse=True)
                span = max(len(some), 1)
            grams, span = grams[:-1] * base + codes[n - 1 :], span * base
        a, b = max(n_r - n + 1, 0), max(n_p - n + 1, 0)
        yield _common(grams[:a], grams[n_r : n_r + b]), b, a


def chrf_statistics(reference: str, prediction: str, order: int = 6) -> list[float]:
    """Matches and totals of the character n-grams of whole texts."""
    r, p = ("".join(s.split()) for s in (reference, prediction))
    known, letters = np.unique(np.frombuffer((r + p).encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_inverse=True)
    return [float(x) for counts in _gram_counts(letters.astype(np.int64), max(len(known), 1), len(r), len(p), order) for x in counts]


def chrf_from(stats: Sequence[float], beta: float = 2.0) -> float:
    scores, used = [0.0, 0.0], 0
    for hit, pred, ref in zip(stats[0::3], stats[1::3], stats[2::3], strict=True):
        if pred and ref:
            used += 1
            scores = [scores[0] + hit / pred, scores[1] + hit / ref]
    if not used or not scores[0] + scores[1]:
        return 0.0
    p, r = scores[0] / used, scores[1] / used
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def _places(words: Sequence[str]) -> dict[str, int]:
    """For each word the bits of its places."""
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance; the differences of a row are the bits of two integers, so memory is linear in ``a``."""
    if not a or not b:
        return len(a) + len(b)
    places, last, full, score = _places(a), len(a) - 1, (1 << len(a)) - 1, len(a)
    up, down = full, 0
    for y in b:
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | ((across | up) & full ^ full), up & across
        score += (more >> last & 1) - (less >> last & 1)
        more, less = (more << 1 | 1) & full, less << 1 & full
        same |= down
        up, down = less | ((same | more) & full ^ full), more & same
    return score


def translation_edits(reference: str, prediction: str, longest: int = 10, furthest: int = 50) -> list[float]:
    """(edits with block shifts, reference words): shifts are taken greedily while one lowers the edit distance by more than
    itself costs. No order of the words has fewer edits than the longer side has words without a partner, so the search
    ends where that bound leaves no room; each candidate shift costs an edit distance of the whole texts."""
    ref, hyp, shifts = reference.lower().split(), prediction.lower().split(), 0
    best = _edits(hyp, ref)
    least = max(len(hyp), len(ref)) - sum((Counter(hyp) & Counter(ref)).values())
    while best > least + 1:
        found = None
        places: dict[tuple, list[int]] = {}
        for n in range(1, min(longest, len(ref)) + 1):
            for j in range(len(ref) - n + 1):
                places.setdefault(tuple(ref[j : j + n]), []).append(j)
        for i in range(len(hyp)):
            for n in range(1, min(longest, len(hyp) - i) + 1):
                block = tuple(hyp[i : i + n])
                if block not in places:
                    break
                for j in places[block]:
                    if 0 < abs(i - j) <= furthest and hyp[j : j + n] != list(block):
                        rest = hyp[:i] + hyp[i + n :]
                        moved = rest[:j] + list(block) + rest[j:]
                        d = _edits(moved, ref)
                        if d + 1 < best and (found is None or d < found[0]):
                            found = (d, moved)
        if found is None:
            break
        best, hyp, shifts = found[0], found[1], shifts + 1
    return [best + shifts, len(ref)]


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence; a row is the bits of one integer."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(reference: str, prediction: str) -> list[float]:
    r, p = (re.findall("[a-z0-9]+", s.lower()) for s in (reference, prediction))
    n = lcs(r, p)
    precision, recall = n / len(p) if p else 0.0, n / len(r) if r else 0.0
    return [precision, recall, 2 * precision * recall / (precision + recall) if n else 0.0]


def meteor(reference: str, prediction: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> list[float]:
    """Exact and stem matches (a stem is the word without a common English ending), fragmentation by chunks."""
    stem = lambda w: re.sub(r"(ations?|ingly|edly|ings?|ness|ment|ed|es|ly|s)$", "", w) if len(w) > 5 else w
    r, p = reference.lower().split(), prediction.lower().split()
    pairs: dict[int, int] = {}
    for form in (str, stem):
        free: dict[str, list[int]] = {}
        taken = set(pairs.values())
        for j, w in enumerate(r):
            if j not in taken:
                free.setdefault(form(w), []).append(j)
        for i in range(len(p) - 1, -1, -1):
            if i not in pairs and free.get(form(p[i])):
                pairs[i] = free[form(p[i])].pop()
    m = len(pairs)
    if not m:
        return [0.0]
    order = [pairs[i] for i in sorted(pairs)]
    at = sorted(pairs)
    chunks = 1 + sum(order[k] != order[k - 1] + 1 or at[k] != at[k - 1] + 1 for k in range(1, m))
    precision, recall = m / len(p), m / len(r)
    return [precision * recall / (alpha * precision + (1 - alpha) * recall) * (1 - gamma * (chunks / m) ** beta)]


def cider(df: DataFrame, key: str, reference: str = "reference", prediction: str = "prediction", sigma: float = 6.0) -> DataFrame:
    """(key, cider): tf-idf weighted n-gram cosine of orders 1 to 4 with clipping and a Gaussian length penalty, times 10, of each row
    that has words. Document frequencies are counted over references, by blocks of rows; an n-gram that one reference or none
    has weighs the same, so only others come back. ``key`` tells rows apart."""
    most = math.log(max(df.count(), 1))

    def score(block: Block, known: dict, order: int) -> dict[str, np.ndarray]:
        total = np.zeros(block.n)
        for n, at, _, which in block.levels(known, order):
            weight = np.full(len(block.codes), most)
            if n in known:
                weight[at] -= np.log(np.maximum(known[n][0], 1))[which]
            places = block.places(n)
            _, first, pair = unique(block.text_names(n, places))
            text, weight = block.text[places][first], weight[places][first]
            r, p = (np.bincount(pair, weights=block.side[places] == k, minlength=len(first)) * weight for k in (0, 1))
            add = lambda x: np.bincount(text, weights=x, minlength=block.n)  # noqa: B023, E731
            norm = np.sqrt(add(r * r) * add(p * p))
            total += np.where(norm > 0, add(np.minimum(p, r) * r) / np.where(norm > 0, norm, 1), 0.0)
        return {"s": total, "lr": block.sizes[0], "lp": block.sizes[1]}

    sides = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in (reference, prediction)]
    found = gram_scores(df, key, sides, 4, False, score, "s double, lr long, lp long").filter("lr + lp > 0")
    return found.select(key, (10 * F.col("s") / 4 * F.exp(-F.pow((F.col("lp") - F.col("lr")).cast("double"), 2.0) / (2 * sigma**2))).alias("cider"))


def rouge_lsum(reference: str, prediction: str) -> list[float]:
    """(precision, recall, f1) of summaries of sentences a line: for each reference sentence the union of its longest common
    subsequences with all predicted ones, where no word of either summary counts more often than it occurs."""
    sides = [[w for line in s.split("\n") if (w := re.findall("[a-z0-9]+", line.lower()))] for s in (reference, prediction)]
    (r, p), (left, right) = sides, [Counter(w for line in side for w in line) for side in sides]
    hits = 0
    for line in r:
        places = {i for other in p for i in _lcs_places(line, other)}
        for i in sorted(places):
            if left[line[i]] > 0 and right[line[i]] > 0:
                hits += 1
                left[line[i]] -= 1
                right[line[i]] -= 1
    n, m = sum(map(len, p)), sum(map(len, r))
    precision, recall = hits / n if n else 0.0, hits / m if m else 0.0
    return [precision, recall, 2 * precision * recall / (precision + recall) if hits else 0.0]


def _lcs_places(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """Places of ``a`` in one longest common subsequence with ``b``. The lengths for each beginning of ``a`` are one integer, whose
    zero bits are where they grow along ``b``: a bit for each pair of words."""
    known, full = _places(b), (1 << len(b)) - 1
    rows = [full]
    for x in a:
        hit = rows[-1] & known.get(x, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out[::-1]


_NUMERAL = r"-?[$]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"


def extract_answer(column: Column, style: str = "number") -> Column:
    """The final answer in each text, by JVM expressions: "number" (what stands after the last ####, else the last number,
    without separators), "choice" (the last option letter A to J that stands alone) or "last_line"; null if there is none."""
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    if style == "choice":
        return last(F.regexp_extract_all(column, F.lit(r"(?:^|[^A-Za-z])\(?([A-J])\)?(?=[^A-Za-z]|$)"), 1))
    if style == "last_line":
        return last(F.filter(F.transform(F.split(column, r"\r\n|\r|\n"), F.trim), lambda x: x != ""))
    if style != "number":
        raise ValueError(f"unknown style {style}")
    tail = F.when(column.contains("####"), F.element_at(F.split(column, "####"), -1)).otherwise(column)
    found = F.regexp_extract_all(tail, F.lit(_NUMERAL), 0)
    number = F.when(column.contains("####"), F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(F.nullif(F.trim(tail), F.lit("")))).otherwise(last(found))
    return F.regexp_replace(F.regexp_replace(number, "[$,]", ""), r"\.0+$", "")


def benchmark_accuracy(df: DataFrame, reference: str, output: str, style: str = "number") -> DataFrame:
    """(accuracy, no_answer): share of outputs whose extracted answer is the reference's, and those without any."""
    gold = F.coalesce(extract_answer(F.col(reference), style), F.trim(F.col(reference))) if style == "number" else F.trim(F.col(reference))
    pred = extract_answer(F.col(output), style)
    return df.agg(F.avg(F.coalesce((pred == gold).cast("double"), F.lit(0.0))).alias("accuracy"), F.count_if(pred.isNull()).alias("no_answer"))
