"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can be the last of its encoding. A token that ends a prefix is that one if
the last token of what stands before it may stand to its left, that is, if encoding the two tokens' bytes gives back these
two. The suffix automaton of the vocabulary, built once on the driver, gives for each byte the longest string that ends
there and is part of a token; the tokens that end there are on its suffix links, the longest first. The test of a pair undoes the later merge
of the two sides step by step and looks for a merge across the border that would have come first. Back-pointers from the
whole piece then give the ids. Pieces are those of the usual byte-level pattern, cut by array operations on code points.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.tokens import KEPT_BYTES, read_vocabulary
from lodestone.llm.words import as_list, gather, pieces, slices, tidied

_LETTER, _DIGIT, _MARK, _BLANK, _STOP = 1, 2, 3, 4, 5
_STOP_POINT = b"\xff\xff\xff\xff"


def _byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in such files: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


class TokenSuffixes:
    """The suffix automaton of all tokens, as arrays: transitions sorted by state and byte, suffix links, longest lengths; for
    each state ``near``, the first state with tokens on its links, itself included. ``tokens``: the (length, id) of a state's
    tokens, longest first, ``up``: the next state with tokens above it. A few ten MB for 50,000 tokens."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, place = [-1], [0], {}
        for i, token in sorted(tokens.items()):
            last = 0
            for c in token:
                q = step[last].get(c)
                if q is not None and length[last] + 1 == length[q]:
                    last = q
                    continue
                new = len(step)
                if q is not None:  # the string is there, within a longer one's state
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[last] + 1)
                    p = last
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = new
                        p = link[p]
                    link[q] = last = new
                    continue
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
        for i, token in tokens.items():  # states are final now
            state = 0
            for c in token:
                state = step[state][c]
            place.setdefault(state, []).append((len(token), i))
        self.tokens = {k: sorted(v, reverse=True) for k, v in place.items()}
        near = [0] * len(step)
        for k in sorted(range(1, len(step)), key=length.__getitem__):
            near[k] = k if k in self.tokens else near[link[k]]
        self.up = {k: near[link[k]] for k in self.tokens}
        key = np.repeat(np.arange(len(step), dtype=np.int64) * 256, [len(x) for x in step]) + np.array([c for x in step for c in x])
        order = np.argsort(key)
        self.key, self.next = key[order], np.array([t for x in step for t in x.values()], dtype=np.int32)[order]
        self.link, self.length, self.near = (np.array(x, dtype=np.int32) for x in (link, length, near))

    def ends(self, pieces: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        """(states, lengths, offsets): after each byte of each piece the first state with tokens on the links of the longest
        match, and that match's length. Pieces are read side by side, a byte of each at a time."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        offsets = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        order = np.argsort(-sizes, kind="stable")
        begin, falling = offsets[:-1][order], -sizes[order]
        out, match = np.zeros(len(data), dtype=np.int32), np.zeros(len(data), dtype=np.int32)
        state, held = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int32)
        for t in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(falling, -t))  # pieces longer than t
            c, s, n = data[begin[:k] + t], state[:k], held[:k]
            at = np.minimum(np.searchsorted(self.key, s * 256 + c), len(self.key) - 1)
            bad = np.flatnonzero(self.key[at] != s * 256 + c)
            while len(bad):
                stuck = bad[s[bad] == 0]  # a byte that no token has
                n[stuck] = -1
                bad = bad[s[bad] != 0]
                s[bad] = self.link[s[bad]]
                n[bad] = self.length[s[bad]]
                want = s[bad] * 256 + c[bad]
                at[bad] = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                bad = bad[self.key[at[bad]] != want]
            n += 1
            s[:] = np.where(n > 0, self.next[at], 0)
            out[begin[:k] + t], match[begin[:k] + t] = self.near[s], n
        return out.tolist(), match.tolist(), offsets.tolist()


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file of the ``tokenizers`` library. ``cache``: pieces whose ids are kept;
    ``suffixes``: the automaton, if it is built already."""

    def __init__(self, vocabulary: str, cache: int = 3 << 17, suffixes: TokenSuffixes | None = None) -> None:
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        chars = _byte_of_char()
        as_bytes = lambda s: bytes(map(chars.__getitem__, s))
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items() if t not in self.special}
        size = max([*self.bytes_of, *self.special.values()]) + 1
        self.left, self.right, self.rank = [0] * size, [0] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(file["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[i] >= 0:
                raise ValueError("two merges make the same token")
            self.left[i], self.right[i], self.rank[i], self.merge[a, b] = a, b, r, r
        # Only tokens whose own bytes encode to them can be in an encoding.
        self.suffixes = suffixes or TokenSuffixes({i: t for i, t in self.bytes_of.items() if len(t) == 1 or self._whole(i)})
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.size = size
        self.cap = cache
        self.known: dict[bytes, bytes] = {b"": b""}
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.ask = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str

    def _whole(self, i: int) -> bool:
        """Whether a token's own bytes encode to it: its parts do and nothing across them would be merged before."""
        return self._fit(self.left[i], self.right[i], self.rank[i])

    def _fit(self, a: int, b: int, limit: float = float("inf")) -> bool:
        rank, merge = self.rank, self.merge
        while True:
            r = merge.get((a, b))
            if r is not None and r < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]  # at equal rank, what stands further left is merged first
            else:
                return True

    def _encode(self, some: list[bytes]) -> Iterator[list[int]]:
        """The ids of each piece: for each prefix the one token that can be its last, then back-pointers from the whole."""
        states, lengths, offsets = self.suffixes.ends(some)
        tokens, up, fits, size = self.suffixes.tokens, self.suffixes.up, self.fits, self.size
        for begin, stop in zip(offsets, offsets[1:], strict=False):
            last, n = [-1] * (stop - begin + 1), stop - begin
            for end in range(1, n + 1):
                state, longest = states[begin + end - 1], lengths[begin + end - 1]
                while state and last[end] < 0:
                    for length, token in tokens[state]:
                        if length > longest:
                            continue
                        before = last[end - length]
                        if length == end:
                            last[end] = token
                        elif before >= 0:
                            key = before * size + token
                            fit = fits.get(key)
                            if fit is None:
                                fits[key] = fit = self._fit(before, token)
                            if fit:
                                last[end] = token
                        if last[end] >= 0:
                            break
                    state = up[state]
            ids = []
            while n:
                token = last[n]
                ids.append(token)
                n -= len(self.bytes_of[token])
            ids.reverse()
            yield ids
            if len(fits) > 1 << 18:
                fits.clear()

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Letter, number, mark or white space, as the library's own pattern has it."""
        for p in points.tolist():
            c = chr(p)
            alone = [k for k, s in ((_LETTER, "a"), (_DIGIT, "1"), (_MARK, "!")) if len(self.ask(s + c)) == 1]
            self.kinds[p] = alone[0] if alone else _BLANK

    def _cut(self, segments: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(pieces of all segments; one empty piece ends each), places of these empty pieces."""
        points = np.frombuffer(b"".join(s.encode("utf-32-le") + _STOP_POINT for s in segments), dtype="<u4")
        stop = points == 0xFFFFFFFF
        plain = np.where(stop, 0, points)
        kind = self.kinds[plain]
        if not kind.all():
            self._learn_kinds(np.unique(plain[kind == 0]))
            kind = self.kinds[plain]
        kind[stop] = _STOP
        begins = np.diff(kind, prepend=np.uint8(0)) != 0
        begins |= stop
        solid = kind < _BLANK
        turn = np.flatnonzero((kind[:-1] == _BLANK) & solid[1:])  # last white space before something else
        begins[turn] = True
        begins[turn[points[turn] == 0x20] + 1] = False  # a blank goes with what follows
        mark = np.flatnonzero((points[:-1] == 0x27) & begins[:-1] & (kind[1:] == _LETTER))
        if len(mark):
            one = points[mark + 1]
            two = points[np.minimum(mark + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            hit = mark[short | long]
            after = hit + np.where(short, 2, 3)[short | long]
            begins[hit + 1] = False
            begins[after[kind[after] == _LETTER]] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[stop] = 0
        upto = np.cumsum(width)
        starts = np.flatnonzero(begins)
        ends = np.append(upto[starts[1:] - 1], upto[-1])
        return pieces("".join(segments).encode(), ends), np.flatnonzero(stop[starts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; a null text is empty. A special token's string becomes its id."""
        segments: list[str] = []
        after: list[int] = []  # id after each segment, -1 at a text's end
        for t in texts.to_pylist():
            cut = 0
            for found in self.split.finditer(t or "") if self.split else ():
                segments.append(t[cut : found.start()])
                after.append(self.special[found[0]])
                cut = found.end()
            segments.append((t or "")[cut:])
            after.append(-1)
        if not segments:
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        coded, stops = self._cut(segments)
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, distinct))
        missing = [p for p, x in zip(distinct, ids, strict=True) if x is None]
        if missing:
            found_ids = {p: np.array(x, dtype="<u4").tobytes() for p, x in zip(missing, self._encode(missing), strict=True)}
            ids = [found_ids[p] if x is None else x for p, x in zip(distinct, ids, strict=True)]
            if len(self.known) + len(found_ids) > self.cap:
                self.known = {b"": b""}
            if len(found_ids) < self.cap:
                self.known.update((p, x) for p, x in found_ids.items() if len(p) <= KEPT_BYTES)
        kinds = sorted(set(after) - {-1})
        flat = np.concatenate([np.frombuffer(b"".join(ids), dtype="<u4"), np.array(kinds, dtype="<u4")])
        sizes = np.concatenate([np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4, np.ones(len(kinds), dtype=np.int64)])
        at = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=at[1:])
        codes = coded.indices.to_numpy().copy()
        after_ids = np.array(after)
        for k, i in enumerate(kinds):
            codes[stops[after_ids == i]] = len(ids) + k
        counts = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(sizes[codes], out=counts[1:])
        return gather(flat, at, codes), np.concatenate([[0], counts[stops[after_ids == -1] + 1]])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every whole text, equal to the library's ``encode`` (no special tokens added)
    and ``decode`` (none skipped).

    Takes columns ``doc_id`` and ``text``; others are not read. A null or empty text has no ids and decodes to the empty
    text; a null ``doc_id`` stays null; repeated rows are encoded each; an empty table gives no rows. A pass over the rows
    without a shuffle; memory is a slice of text and bounded caches, and one text longer than a slice.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, ByteBPE(vocabulary).suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(sent.value[0], suffixes=sent.value[1])
        for batch in batches:
            for some in slices(batch, limit=4 << 20):
                ids, at = bpe.encode(some.column(1))
                ends = at.tolist()
                every = ids.tolist()
                decoded = [bpe.decode(every[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([some.column(0), as_list(ids.astype(np.int32), at, pa.int32()), pa.array(decoded, type=pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded string")
