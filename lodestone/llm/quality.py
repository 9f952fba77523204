"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import Words, carried, joined, per_text, slices, tidied, unpacked

#: Words of a window that counts as repeated, and the bound of repeated words and of few words in the base rule.
WINDOW, REPEATED_PERCENT, FEWEST_WORDS = 8, 30, 20
#: Rows, about, of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 400

_SYMBOLS = b"#*$%&|<>"
_REST = bytes(b for b in range(256) if b not in _SYMBOLS)
_FLAG = {name: bytes(1 if b in chars else 0 for b in range(256)) for name, chars in {"symbol": _SYMBOLS, "capital": bytes(range(65, 91)), "letter": bytes([*range(65, 91), *range(97, 123)]), "bang": b"!", "lead": bytes([*range(0x80), *range(0xC0, 256)])}.items()}


class Features:
    """Counts of each text of a column, computed when first asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts

    def of(self, rows: np.ndarray) -> Features:
        """The features of these rows alone: what is known already is taken over, the rest is computed from their texts."""
        part = Features(self.texts.take(pa.array(rows)))
        part.__dict__.update({k: v[rows] for k, v in self.__dict__.items() if isinstance(v, np.ndarray)})
        if "_lines" in self.__dict__:
            part._lines = tuple(v[rows] for v in self._lines)
        return part

    @cached_property
    def words(self) -> Words:
        return Words(self.texts)

    @cached_property
    def _bytes(self) -> tuple[bytes, np.ndarray]:
        known = self.__dict__.get("words")
        return (known.data, known.starts) if known else joined(self.texts)

    def _flagged(self, name: str) -> np.ndarray:
        data, starts = self._bytes
        return per_text(np.frombuffer(data.translate(_FLAG[name]), dtype=np.uint8), starts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that start one, without those of white space."""
        w = self.words
        solid = per_text(w.lengths, w.first)
        follow = np.frombuffer(w.data, dtype=np.int8) < -64  # 0x80 to 0xBF
        return solid - per_text(follow, w.starts)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._flagged("symbol")

    @cached_property
    def capitals(self) -> np.ndarray:
        return self._flagged("capital")

    @cached_property
    def letters(self) -> np.ndarray:
        return self._flagged("letter")

    @cached_property
    def bangs(self) -> np.ndarray:
        return self._flagged("bang")

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        n, dup = [], []
        for t in self.texts.to_pylist():
            lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            n.append(len(lines))
            dup.append(len(lines) - len(set(lines)))
        return np.array(n, dtype=np.int64), np.array(dup, dtype=np.int64)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows that the text has twice or more. Windows of the same 64-bit polynomial are neighbours after one
        sort and are then compared word by word; should two different ones ever share it, ranks by doubling decide."""
        first, n = self.words.first, len(self.words.codes)
        if n < WINDOW:
            return np.zeros(len(first) - 1, dtype=np.int64)
        codes = self.words.codes.astype(np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
        key = np.zeros(n - WINDOW + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
            for k in range(WINDOW):
                key *= np.uint64(0xD6E8FEB86659FD93)
                key += mixed[k : n - WINDOW + 1 + k]
            key = key[at] + doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key)
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        left, right = at[order[same]], at[order[same + 1]]
        if not all(np.array_equal(codes[left + k], codes[right + k]) for k in range(WINDOW)) or not np.array_equal(doc[left], doc[right]):
            left, right = self._twice_by_ranks(codes, doc, at)
        edges = np.zeros(n + 1, dtype=np.int64)
        begins = np.unique(np.concatenate([left, right]))
        edges[begins] += 1
        edges[begins + WINDOW] -= 1
        return per_text(np.cumsum(edges[:-1]) > 0, first)

    @staticmethod
    def _twice_by_ranks(codes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours among equal windows: the pair of names of two windows of 1, 2 and 4 words is renamed by its rank."""
        names, span = codes, 1
        while span < WINDOW:
            names = _ranks(names[:-span] * (int(names.max()) + 1) + names[span:])
            span *= 2
        key = names[at] * (int(doc[-1]) + 1) + doc[at]
        order = np.argsort(key)
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        return at[order[same]], at[order[same + 1]]

    @cached_property
    def n_runs(self) -> np.ndarray:
        """Words equal to the word before."""
        w = self.words
        same = np.zeros(len(w.codes), dtype=np.int64)
        same[1:] = w.codes[1:] == w.codes[:-1]
        heads = w.first[:-1][w.first[:-1] < w.first[1:]]
        same[heads] = 0
        return per_text(same, w.first)

    @cached_property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < FEWEST_WORDS) | (100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words)


def _ranks(values: np.ndarray) -> np.ndarray:
    """For each value its place among the distinct ones."""
    if not len(values):
        return values
    order = np.argsort(values)
    step = np.empty(len(values), dtype=np.int64)
    step[0] = 0
    step[1:] = values[order][1:] != values[order][:-1]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the features of some texts, a flag for each."""

    name: str
    rejects: Callable[[Features], np.ndarray]


#: A document that fails any of them is rejected, whatever the order in which they are asked.
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > 25 * f.n_words),
    Rule("duplicate_lines", lambda f: (100 * f.n_dup_lines > 50 * f.n_lines) & (f.n_dup_lines > 2)),
    Rule("shouting", lambda f: (100 * f.capitals > 50 * f.letters) & (f.letters >= 40)),
    Rule("exclamations", lambda f: 100 * f.bangs > 25 * f.n_words),
    Rule("word_runs", lambda f: 100 * f.n_runs > 30 * f.n_words),
    Rule("word_length", lambda f: (f.word_chars > 25 * f.n_words) | (f.word_chars < 2 * f.n_words)),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in order of rejected documents per second, from a sample of about ``rows`` rows of the whole table. Executors
    time each rule on fresh features; the driver only gets a row for each rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                spent, found = [], []
                for rule in rules:
                    features = Features(some.column(0))
                    began = time.perf_counter()
                    found.append(int(np.count_nonzero(rule.rejects(features))))
                    spent.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(found)], names=["rule", "seconds", "rejected"])

    sample = docs.select("text").sample(min(1.0, rows / max(docs.count(), 1)), seed=11)
    figures = {r[0]: (r[1], r[2]) for r in sample.mapInArrow(tidied(run), "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()}
    gain = {name: rejected / max(seconds, 1e-9) for name, (seconds, rejected) in figures.items()}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept) of each row.

    Takes columns ``doc_id`` and ``text``; ``carry`` also passes each whole row on, as the struct ``row``. The base rule comes first; of its survivors each rule sees only
    what the rules before it have let through, always, in the order of rejections per cost on a sample. The order decides the cost
    and ``rejected_by`` (the first rule that rejects), never ``kept``. A null or empty text has no words and fails the
    base rule; a null ``doc_id`` stays null; repeated rows are judged each; an empty table gives no rows.
    """
    ordered = measured(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(unpacked(batch, carry)):
                f = Features(some.column(1))
                by = np.full(some.num_rows, None, dtype=object)
                by[f.base_failed] = "base"
                longs = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]  # of every row, as they are returned
                alive = np.flatnonzero(~f.base_failed)
                left = f.of(alive)
                for rule in ordered:
                    hit = rule.rejects(left)
                    if hit.any():
                        by[alive[hit]] = rule.name
                        alive, left = alive[~hit], left.of(np.flatnonzero(~hit))
                    if not len(alive):
                        break
                longs = [pa.array(x.astype(np.int64)) for x in longs]
                rejected = pa.array(by.tolist(), type=pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), *longs, pa.array(f.base_failed), rejected, rejected.is_null(), *some.columns[2:]], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, rejected_by string, kept boolean"
    names = [f.split()[0] for f in schema.split(", ")] + ["row"] * carry
    own, schema = carried(docs, schema, carry)
    return own.mapInArrow(tidied(run), schema)
