"""Token ids of whole texts, with each different word encoded once per worker.

The vocabulary ``word_bpe_49k`` drops white space and never joins characters
across it, nor across a change between an ASCII letter and an ASCII digit or
symbol (the apostrophe apart, which starts contractions). So the ids of a text
are the ids of its pieces one after another, and pieces repeat a lot.
``tests/llm/test_tokens.py`` holds this against the tokenizer on whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from . import words as W

#: Different pieces remembered by one Python worker, about 50 MB; beyond it they are forgotten and encoded again.
REMEMBERED = 1_500_000
#: Size of the table that finds a remembered piece by its hash, 16 MB; a piece that loses its slot is encoded again.
SLOT_BITS = 22

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not _LETTER[b] and b != 39]] = True
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has. Null has none."""
        # a special token's text is matched before anything is cut
        special = [i for i, t in enumerate(texts) if t and b"<|" in t]
        plain = [None if t and b"<|" in t else t for t in texts] if special else texts
        ids, counts = self._pieces(plain)
        if special:
            own = self.whole([texts[i].decode() for i in special])
            at = np.concatenate(([0], np.cumsum(counts)))
            parts = np.split(ids, at[1:-1])
            for i, x in zip(special, own, strict=True):
                parts[i], counts[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(parts)
        return ids, counts

    def _pieces(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        w = W.split(texts, fold=True)
        data = np.frombuffer(w.data, np.uint8)
        letter, mark = _LETTER[data], _MARK[data]
        cut = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        inner = np.flatnonzero(cut) + 1
        start, end = np.sort(np.concatenate((w.start, inner))), np.sort(np.concatenate((w.end, inner)))
        pieces = W.Words(w.data, start, end, np.searchsorted(start, w.at), w.at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashed = W.hashes(pieces)
        at = self._find(hashed)
        if (at < 0).any() and len(self.keys) > REMEMBERED:
            self.forget()
            at[:] = -1
        left = np.flatnonzero(at < 0)
        if len(left):
            different, where, back = np.unique(hashed[left], return_index=True, return_inverse=True)
            spans = zip(start[left[where]].tolist(), end[left[where]].tolist(), strict=True)
            at[left] = self._learn(different, [w.data[a:b].decode() for a, b in spans])[back]
        many = self.count[at]
        ids = self.flat[W.spread(self.begin[at], many)]
        ends = np.concatenate(([0], np.cumsum(many)))[pieces.first]
        return ids, np.diff(ends)

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """Where each piece is remembered, or -1; a piece may sit in either of two slots."""
        out = np.full(len(hashed), -1, np.int64)
        if len(self.keys):
            for shift in (0, SLOT_BITS):
                at = self.slot[self._slots(hashed, shift)]
                hit = (at >= 0) & (self.keys[at] == hashed)
                out[hit] = at[hit]
        return out

    @staticmethod
    def _slots(hashed: np.ndarray, shift: int) -> np.ndarray:
        return ((hashed >> np.uint64(shift)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def _learn(self, hashed: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encode new pieces. Letters-only ones go joined by spaces, as each ends in one word-end token."""
        plain = np.fromiter((t.isalpha() for t in texts), bool, len(texts))
        joined, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        lines = [" ".join(texts[i] for i in joined[k : k + 512]) for k in range(0, len(joined), 512)]
        ids = [np.array(x, np.uint32) for x in self.whole(lines)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        count = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(count) != len(joined):
            joined, other = joined[:0], np.arange(len(texts))
            flat, count = flat[:0], count[:0]
        single = self.whole([texts[i] for i in other])
        count = np.concatenate((count, np.fromiter(map(len, single), np.int64, len(single))))
        flat = np.concatenate((flat, np.fromiter((i for x in single for i in x), np.uint32)))
        order = np.concatenate((joined, other))
        at = np.empty(len(texts), np.int64)
        at[order] = len(self.keys) + np.arange(len(texts))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))
        self.keys = np.concatenate((self.keys, hashed[order]))
        first, second = self._slots(hashed, 0), self._slots(hashed, SLOT_BITS)
        full = self.slot[first] >= 0
        self.slot[second[full]] = at[full]
        self.slot[first[~full]] = at[~full]
        return at
