"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.words import carried, per_text, slices, tidied, unpacked

#: The training sample of each language, a bound whatever the corpus: rows, characters of each row, and bytes that its
#: automaton holds.
SAMPLE_ROWS, ROW_CHARS, LANGUAGE_BYTES = 96, 2_000, 60_000
#: The length below which a shorter sample earns no further allowance when phrases are compared.
ALLOWANCE_BYTES = 4_000
#: Bytes that are parsed at a stretch: a phrase ends where a stretch of a text does. Stretches run side by side.
STRETCH = 512
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
UNDETERMINED = "und"


class SuffixAutomaton:
    """The automaton of all substrings of a byte string: ``step[s]`` has the state after each byte that may follow state s."""

    def __init__(self, text: bytes) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = step


class CrossParser:
    """Greedy parses of many texts against the samples of all languages at once.

    The automata are one flat table. A cell, at a state's row and a byte's column, holds four times the next state's row plus
    the phrases that this byte ends: 0 inside a match; 1 where the match ends and a new one begins; 2 where the byte is in no
    match either and is a phrase of its own (1 at the root). A row has a column for each byte of its sample and one for all
    others. It holds rows times columns of 4 bytes: about 10 MB for a language of 30 letters.
    """

    def __init__(self, samples: list[bytes]) -> None:
        self.code = np.zeros((len(samples), 256), dtype=np.int32)
        self.root = np.zeros(len(samples), dtype=np.int32)
        tables, base = [], 0
        for i, text in enumerate(samples):
            step = SuffixAutomaton(text).step
            known = sorted(step[0])
            self.code[i, known] = np.arange(1, len(known) + 1)
            width = len(known) + 1
            self.root[i] = base
            first = np.full(width, base << 2, dtype=np.int64)
            first[1:] = [(base + step[0][c] * width) << 2 for c in known]
            table = np.tile(first + 1, (len(step), 1))
            table[:, 0] = base << 2 | 2
            table[0] = first
            table[0, 0] = base << 2 | 1
            row = np.repeat(np.arange(len(step)), [len(s) for s in step])
            at = np.array([c for s in step for c in s], dtype=np.int64)
            to = np.array([t for s in step for t in s.values()], dtype=np.int64)
            table[row, self.code[i, at]] = (base + to * width) << 2
            tables.append(table.ravel())
            base += table.size
        if base >= 1 << 29:
            raise ValueError("the languages' automata need more than 2 GB")
        self.table = np.concatenate([t.astype(np.int32) for t in tables]) if tables else np.zeros(0, dtype=np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(languages, texts) phrases of the texts ``data[offsets[i]:offsets[i + 1]]``, in stretches of ``STRETCH`` bytes."""
        sizes = np.diff(offsets)
        n = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), n)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        length = np.minimum(sizes[text] - begin, STRETCH)
        order = np.argsort(-length, kind="stable")
        text, length, begin = text[order], length[order], (begin + offsets[:-1][text])[order]
        alive = np.searchsorted(-length, -np.arange(1, STRETCH + 1), side="right")  # stretches that reach a byte
        state = np.repeat(self.root[:, None], len(text), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            k = alive[t]
            c = data[begin[:k] + t]
            for i in range(len(self.root)):
                cell = self.table[state[i, :k] + self.code[i][c]]
                count[i, :k] += cell & 3
                state[i, :k] = cell >> 2
        count += state != self.root[:, None]
        return np.array([np.bincount(text, weights=x, minlength=len(sizes)) for x in count], dtype=np.int64).reshape(len(self.root), len(sizes))


class Letters:
    """Texts as UTF-8 of their letters in lower case, each word after one blank."""

    def __init__(self) -> None:
        self.low = np.zeros(0x110000, dtype=np.uint32)

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            self.low[p] = ord(chr(p).lower()[0]) if chr(p).isalpha() else 0x20

    def normal(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, offsets, letters of each text); a null text has none."""
        some = [t or "" for t in texts]
        points = np.frombuffer((" " + " ".join(some)).encode("utf-32-le", "replace"), dtype="<u4")
        at = np.zeros(len(some) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1, out=at[1:])  # from the blank before it
        low = self.low[points]
        if not low.all():
            self._learn(np.unique(points[low == 0]))
            low = self.low[points]
        letter = low != 0x20
        keep = letter.copy()
        keep[:-1] |= letter[1:]  # a blank stays before a letter alone
        kept = low[keep]
        width = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
        upto = np.zeros(len(kept) + 1, dtype=np.int64)
        np.cumsum(width, out=upto[1:])
        place = np.zeros(len(keep) + 1, dtype=np.int64)
        np.cumsum(keep, out=place[1:])
        data = np.frombuffer(kept.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        return data, upto[place[np.minimum(at, len(keep))]], per_text(letter, np.minimum(at, len(letter)))


def training_text(docs: DataFrame, label: str = "lang") -> dict[str, bytes]:
    """Per language a sample of words of labelled rows, at most ``LANGUAGE_BYTES`` bytes; every language that has letters.

    Rows whose ``crc32(doc_id as text) mod 5`` is 0 are held out; rows without doc_id, label or text are not used. Rows of
    least hash are taken, a top-k for each language before anything is shuffled, of ids first and then of rows, as an id may
    be repeated; the driver gets ``SAMPLE_ROWS`` rows of ``ROW_CHARS`` characters for each language at most. Samples of at
    least half the longest are cut to the shortest of them, so that they compare at equal lengths; a shorter one keeps its own
    length and shortens no other.
    """
    seen = docs.select("doc_id", F.col(label).cast("string").alias("lang"), "text").filter("doc_id is not null and lang is not null and text is not null and crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 <> 0")
    top = Window.partitionBy("lang").orderBy("h", "doc_id")
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    ids = seen.select("lang", "doc_id", hashed.alias("h")).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= SAMPLE_ROWS)
    rows = seen.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", hashed.alias("h"), F.substring("text", 1, ROW_CHARS).alias("text"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= SAMPLE_ROWS).select("lang", "r", "text").collect()
    out: dict[str, list[bytes]] = {}
    letters = Letters()
    for lang, _, text in sorted(map(tuple, rows), key=lambda r: (r[0], r[1])):
        if len(words := letters.normal([text])[0]):
            out.setdefault(lang, []).append(words.tobytes())
    texts = {lang: b"".join(words)[:LANGUAGE_BYTES] for lang, words in out.items()}
    longest = max(map(len, texts.values()), default=0)
    size = min((len(t) for t in texts.values() if 2 * len(t) >= longest), default=0)
    return {lang: t[:size] for lang, t in texts.items()}


def identify(docs: DataFrame, samples: dict[str, bytes], *, carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, phrases) of every whole text; ``samples``: normal text for each language.

    Takes columns ``doc_id`` and ``text``; ``carry`` also passes each whole row on, as the struct ``row``. The letters of a
    text, in lower case and with one blank before each word, are parsed from left to right, across words, into longest
    matches with each language's sample; every ``STRETCH`` bytes a new parse begins. Phrases grow shorter as one by the
    logarithm of the sample's length, so they are counted times that logarithm (of ``ALLOWANCE_BYTES`` at least: a sample of a
    few words must not win by being small). The language with the least count wins (ties: the smaller name); ``score`` is
    the share that it saves against the next one (1 if there is no other), ``phrases`` its own phrases. The automata are
    built once, on the driver, and sent as one table. A text that is null or has no letter is ``und`` with score 0; a null
    ``doc_id`` stays null; repeated rows are judged each; without samples every text is ``und``; an empty table gives no
    rows. A pass without a shuffle.
    """
    names = sorted(samples)
    trained = docs.sparkSession.sparkContext.broadcast(CrossParser([samples[n] for n in names]))
    weights = np.log([max(len(samples[n]), ALLOWANCE_BYTES) for n in names]) if names else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, letters = trained.value, Letters()
        for batch in batches:
            for some in slices(unpacked(batch, carry), limit=SLICE):
                data, offsets, n_letters = letters.normal(some.column(1).to_pylist())
                rows = np.arange(some.num_rows)
                sure = (n_letters > 0) & bool(names)
                if names:
                    phrases = parser.phrases(data, offsets)
                    weighed = phrases * weights[:, None]
                    best = np.argmin(weighed, axis=0)  # names are sorted, so ties go to the smaller one
                    two = np.sort(weighed, axis=0)[:2]
                    score = 1 - two[0] / np.where(two[1] > 0, two[1], 1) if len(names) > 1 else np.ones(len(rows))
                    least = phrases[best, rows]
                else:
                    best, score, least = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows)), np.zeros(len(rows))
                pred = [names[b] if s else UNDETERMINED for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pred, type=pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(np.where(sure, least, 0).astype(np.int64)), *some.columns[2:]], names=["doc_id", "lang_pred", "score", "phrases", *["row"] * carry])

    own, schema = carried(docs, "doc_id long, lang_pred string, score double, phrases long", carry)
    return own.mapInArrow(tidied(run), schema)
