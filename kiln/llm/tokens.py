"""Token ids by the ``tokenizers`` library, with a memo of word pieces in each Python worker.

Texts are cut on their bytes where the tokenizer itself always cuts: at a single space or line feed between
words, and before the ASCII punctuation that ends a word after a letter or digit.  The ids of a piece do not
depend on its neighbours, so the library sees each piece once and a block of texts is put together from the
memo's arrays.  Where such a cut could change the ids (other white space for a tokenizer that keeps it), and for
tokenizers of any other build, the library gets the whole text.  Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from kiln.llm import words as W

#: Pieces that a worker keeps at most; a full memo is emptied.
MEMO = 600_000
#: Bytes of text that are cut together.
BLOCK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~_ALNUM


def file_of(name: str) -> str:
    """A path as it is, or the place of one of the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(spec: dict) -> str:
    """How a text may be cut: 'prefix' (a piece keeps its leading space), 'drop' (white space is dropped), or ''."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("truncation") or spec["model"].get("dropout"):
        return ""
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "prefix"
    inner = pre.get("pretokenizers", [])
    drops = len(inner) == 2 and inner[0].get("type") == "Split" and inner[0].get("behavior") == "Removed" and inner[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in str(inner[0]["pattern"].get("Regex"))
    plain = len(inner) == 2 and inner[1].get("type") == "ByteLevel" and not inner[1].get("use_regex") and not inner[1].get("add_prefix_space")
    if drops and plain and norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "drop"
    return ""


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter or digit ends before each position: ASCII, or Latin of two bytes (U+00C0 to U+024F)."""
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    latin = (two >= 0xC3) & (two <= 0xC9) & (one >= 0x80) & (one < 0xC0) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)))
    return _ALNUM[one] | latin


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII's usual six."""
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3) | (data == 0xC2) | (data >= 0x1C) & (data <= 0x1F))
    pad = np.append(data, np.zeros(2, np.uint8))
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    return at[
        (a < 0x20)
        | (a == 0xC2) & ((b == 0xA0) | (b == 0x85))
        | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    ]


class _Memo:
    """Hash to ids, as sorted arrays; a small one takes what is new and is merged now and then."""

    def __init__(self, kind):
        self.kind = kind
        self.ids, self.used = np.zeros(1 << 20, kind), 0
        self.parts = [self._none(), self._none()]

    @staticmethod
    def _none():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids start, and how many they are; -1 if unknown."""
        start, n = np.full(len(key), -1), np.zeros(len(key), np.int32)
        for keys, starts, counts in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                start[hit], n[hit] = starts[at[hit]], counts[at[hit]]
        return start, n

    def add(self, key: np.ndarray, lists: list[list[int]]) -> None:
        """``key`` ascending and new."""
        n = np.fromiter(map(len, lists), np.int32, len(lists))
        total = int(n.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.kind)])
        self.ids[self.used : self.used + total] = np.fromiter((x for y in lists for x in y), self.kind, total)
        new = key, self.used + np.cumsum(n, dtype=np.int64) - n, n
        self.used += total
        self.parts[1] = self._merged(self.parts[1], new)
        if len(self.parts[1][0]) * 4 > len(self.parts[0][0]):
            self.parts = [self._merged(*self.parts), self._none()]

    @staticmethod
    def _merged(a, b):
        key = np.concatenate([a[0], b[0]])
        order = np.argsort(key, kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def __len__(self):
        return sum(len(x[0]) for x in self.parts)


class Encoder:
    """Strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.cut = _cut(json.load(f))
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.n_ids = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.n_ids <= 65536 else "<u4")
        self.memo = _Memo(self.kind)
        # lower-case ASCII letters are one word of the model as they are, unless an added token is made of such letters
        added = self.lib.get_added_tokens_decoder().values()
        self.letters = self.cut == "drop" and all(t.special or not t.content.isalpha() for t in added)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """The ids of each piece.  Where a piece is a word that neither normalizer nor pre-tokenizer would change or cut,
        the library's model gets it without these steps."""
        if not self.letters:
            return self._lists(texts)
        word = self.lib.model.tokenize
        out = [[t.id for t in word(x)] if x.isascii() and x.isalpha() and x.islower() else None for x in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._lists([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def blocks(self, column, end_id: int):
        """(first row, end row, ids, the rows' offsets there) of runs of rows of a string column; each row's ids
        are followed by ``end_id``, null is empty."""
        for lo, hi, data, offsets in W.blocks(column, BLOCK_BYTES):
            ids, n = self._block(data, offsets) if self.cut else self._whole(data, offsets, np.arange(hi - lo))
            at = np.concatenate([[0], np.cumsum(n + 1)])
            out = np.empty(at[-1], self.kind)
            ends = np.zeros(at[-1], bool)
            ends[at[1:] - 1] = True
            out[ends], out[~ends] = end_id, ids
            yield lo, hi, out, at

    def _whole(self, data, offsets, rows) -> tuple[np.ndarray, np.ndarray]:
        lists = self._lists([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows])
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for y in lists for x in y), self.kind, int(n.sum())), n

    def _block(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        n_rows = len(offsets) - 1
        if self.cut == "drop":
            data = _LOWER[data]
        start, end, row = W.spans(data, offsets)
        head = np.zeros(len(start), np.uint64)  # 0: begins a text, 1: after a space, 2: after a line feed
        odd = np.zeros(0, np.int64)
        if self.cut == "prefix":
            first = np.diff(row, prepend=-1) != 0
            before = data[np.maximum(start - 1, 0)]
            head = np.where(first, 0, np.where(before == 10, 2, 1)).astype(np.uint64)
            gap = start - np.where(first, offsets[row], np.concatenate([[0], end[:-1]]) if len(end) else end)
            bad = np.where(first, gap > 0, (gap != 1) | ((before != 32) & (before != 10)))
            last = np.ones(len(row), bool)
            last[:-1] = row[1:] != row[:-1]
            trail = last & (end != offsets[row + 1])
            blank = np.flatnonzero((np.bincount(row, minlength=n_rows) == 0) & (np.diff(offsets) > 0))
            odd = np.unique(np.concatenate([row[bad], row[trail], blank, np.searchsorted(offsets, _odd_space(data), "right") - 1]))
            if len(odd):
                on = ~np.isin(row, odd)
                start, end, row, head = start[on], end[on], row[on], head[on]
        # the punctuation at a word's end
        solid = np.flatnonzero(~_PUNCT[data])
        stem = np.zeros(len(end), np.int64)
        if len(solid) and len(end):
            at = np.searchsorted(solid, end) - 1
            stem = np.where(at >= 0, solid[np.maximum(at, 0)] + 1, 0)
        two = (stem > start) & (stem < end)
        two[two] = _after_letter(data, stem[two])
        n = 1 + two
        place = np.cumsum(n) - n
        lo, hi, kind = (np.zeros(int(n.sum()), t) for t in (np.int64, np.int64, np.uint64))
        lo[place], hi[place], kind[place] = start, np.where(two, stem, end), head
        tail = place[two] + 1
        lo[tail], hi[tail] = stem[two], end[two]
        key = W.mix(W.hashes(data, lo, hi) + kind, 9)
        own, where, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.memo) + len(own) > MEMO:
            self.memo = _Memo(self.kind)
        at, count = self.memo.get(own)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, leads = data.tobytes(), ("", " ", "\n")
            unit = where[new]
            self.memo.add(own[new], self._pieces([leads[k] + raw[a:b].decode() for a, b, k in zip(lo[unit].tolist(), hi[unit].tolist(), kind[unit].tolist(), strict=True)]))
            at, count = self.memo.get(own)
        at, count = at[which], count[which].astype(np.int64)
        total = int(count.sum())
        ids = self.memo.ids[np.repeat(at - np.cumsum(count) + count, count) + np.arange(total)]
        per_row = np.bincount(np.repeat(row, n), count, n_rows).astype(np.int64)
        if not len(odd):
            return ids, per_row
        extra, n_extra = self._whole(data, offsets, odd.tolist())
        pieces, extras = np.split(ids, np.cumsum(per_row)[:-1]), iter(np.split(extra, np.cumsum(n_extra)[:-1]))
        for r in odd.tolist():
            pieces[r] = next(extras)
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, n_rows)


def binaries(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The rows' ids as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(file_of(name))
