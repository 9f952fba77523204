"""Exact ids of a word-end BPE file of the ``tokenizers`` library, part by part with bounded caches.

Such a file lower-cases, drops white space and never joins text across it, so the ids of a text are those of its parts:
runs of letters, single digits, runs of marks, and the contractions ``'s 't 're 've 'm 'll 'd``. Words of ASCII and the
letters of Latin-1 are cut into parts here, by array operations on a whole slice of texts; any other word, and any word
with ``<|`` (it may be a special token), is given to the library whole. Each distinct part of a slice is looked up once,
and the library encodes those that the worker has not met before, many in one call.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from lodestone.llm.words import BLANKS, gather, joined, pieces

#: Longer parts are not kept in a cache, so that its memory is bounded.
KEPT_BYTES = 64

_BLANK, _LETTER, _DIGIT, _MARK, _LEAD, _HIGH = range(6)


def _kind(b: int) -> int:
    if b in BLANKS:
        return _BLANK
    if b >= 0x80:
        return _LEAD if b == 0xC3 else _HIGH
    if chr(b).isalpha():
        return _LETTER
    if chr(b).isdigit():
        return _DIGIT
    return _MARK if 0x21 <= b <= 0x7E else _HIGH


_KINDS = bytes(map(_kind, range(256)))
_MARKS = bytes(range(0x21, 0x7F))
_ODD = re.compile("[^!-~À-ÖØ-öø-ÿ]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_vocabulary(path: str) -> str:
    """The tokenizer file's content, read once on the driver (a few MB, whatever the corpus) and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def parts(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(starts, ends, text) of the parts of ``data``, which ends with a blank; ``text`` has them lower-cased, without blanks."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = np.frombuffer(data.translate(_KINDS), dtype=np.uint8).copy()
    low = np.frombuffer(data.translate(_LOWER), dtype=np.uint8).copy()
    lead = np.flatnonzero(kind == _LEAD)  # U+00C0 to U+00FF
    second = raw[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    good = lead[letter]
    kind[good] = kind[good + 1] = _LETTER
    kind[lead[~letter]] = _HIGH
    upper = good[raw[good + 1] < 0x9F] + 1
    low[upper] += 32
    change = np.diff(kind, prepend=np.uint8(_BLANK)) != 0
    begins = change | (kind == _DIGIT)
    begins &= kind != _BLANK
    for p in np.flatnonzero((raw[:-1] == 0x27) & begins[:-1] & (kind[1:] == _LETTER)).tolist():
        after = bytes(low[p + 1 : p + 3])
        n = 2 if after[:1] in b"stmd" else 3 if after in (b"re", b"ve", b"ll") else 0
        if n:
            begins[p + 1] = False
            if kind[p + n] == _LETTER:
                begins[p + n] = True
    special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if b"<|" in data else np.zeros(0, dtype=np.int64)
    odd = np.concatenate([np.flatnonzero(kind == _HIGH), special])
    solid = kind != _BLANK
    if len(odd):
        edges = np.flatnonzero(np.diff(solid.view(np.uint8), prepend=np.uint8(0)))
        heads, tails = edges[0::2], edges[1::2]
        for w in np.unique(np.searchsorted(heads, odd, side="right") - 1).tolist():
            a, b = heads[w], tails[w]
            begins[a] = True
            begins[a + 1 : b] = False
            low[a:b] = raw[a:b]
    starts = np.flatnonzero(begins)
    text = low.tobytes().translate(None, BLANKS)
    last = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1  # ends of words
    ends = np.append(starts[1:], 0)
    k = np.searchsorted(starts, last) - 1
    ends[k] = last
    return starts, ends, text


class WordEncoder:
    """Encodes texts; ``cache``: parts whose ids are kept, a full cache is emptied."""

    def __init__(self, vocabulary: str, cache: int = 1 << 19) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = Tokenizer.from_str(vocabulary)  # for parts, which are normalised and cut already
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cap = cache
        self.known: dict[bytes, bytes] = {}
        model = json.loads(vocabulary)["model"]
        suffix = model.get("end_of_word_suffix") or "</w>"
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        self.stops = np.zeros(size, dtype=bool)
        for token, i in model["vocab"].items():
            self.ends[i] = token.endswith(suffix)
            self.stops[i] = token.endswith(suffix) and token[: -len(suffix)].rstrip("\"')").endswith((".", "!", "?"))

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        whole = {p: None for p in missing if b"<|" in p or (_ODD.search(p.decode()) if not p.isascii() else p.translate(None, _MARKS))}
        plain = [p for p in missing if p not in whole]
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):
                raise ValueError("the tokenizer cuts a part again; it is not of the kind that this encoder takes")
            data, cuts = ids.tobytes(), cuts.tolist()
            found.update(zip(some, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        whole = list(whole)
        for k in range(0, len(whole), 256):
            some = whole[k : k + 256]
            for w, e in zip(some, self.library.encode_batch([x.decode() for x in some], add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, dtype="<u4").tobytes()
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each followed by the id ``end`` if given; a null text is empty."""
        data, at_text = joined(texts)
        starts, ends, text = parts(data) if data else (np.zeros(0, np.int64), np.zeros(0, np.int64), b"")
        first = np.searchsorted(starts, at_text)
        coded = pieces(text, np.cumsum(ends - starts))
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, distinct))
        missing = [p for p, x in zip(distinct, ids, strict=True) if x is None]
        if missing:
            found = self._learn(missing)
            ids = [found[p] if x is None else x for p, x in zip(distinct, ids, strict=True)]
            if len(self.known) + len(found) > self.cap:
                self.known.clear()
            if len(found) <= self.cap:
                self.known.update((p, x) for p, x in found.items() if len(p) <= KEPT_BYTES)
        codes = coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4, out=at[1:])
        if end is not None:  # one more part at the end of each text
            flat, at = np.append(flat, np.uint32(end)), np.append(at, at[-1] + 1)
            codes = np.insert(codes, first[1:], len(ids))
            first = first + np.arange(len(first))
        counts = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(np.diff(at)[codes], out=counts[1:])
        return gather(flat, at, codes), counts[first]
