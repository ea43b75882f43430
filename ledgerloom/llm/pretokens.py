"""Byte-level BPE ids of whole texts, through the distinct pretokens of a batch.

The vocabulary's pattern splits a text into pretokens, and BPE works on each of them alone. The
split is made on arrays of code points, pretokens are hashed, and only the distinct ones of a batch
that a worker has not seen are given to the tokenizer; all others are array lookups.

Pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. In words: runs of
letters, of digits, of other signs, each with one space before it if there is one; a run of white
space ends one character before a text that follows; and a lone apostrophe after no space takes
``s t m d re ve ll``. Texts that hold the special token's string are given to the tokenizer whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from . import textkernel as k

SPECIAL = "<|endoftext|>"
LETTER, DIGIT, WHITE, OTHER = 1, 2, 3, 4
U = np.uint64
#: Distinct pretokens that a worker remembers before it starts anew.
MEMORY = 2_000_000
_RNG = np.random.Generator(np.random.PCG64(99))
_VALUE = _RNG.integers(0, 1 << 63, 65536, dtype=np.uint64)
_P = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for first in range(0, 0x110000, 0x800):  # in small blocks, as all characters as strings take 90 MB
        if 0xD800 <= first < 0xE000:
            continue  # surrogates
        text = "".join(map(chr, range(first, first + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[first + m.start() : first + m.end()] = kind
    return out


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def splits(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pretokens begin, in code points; ``off`` has the texts' places."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    new[first] = True
    last = np.zeros(n, bool)
    last[off[1:][off[:-1] < off[1:]] - 1] = True
    begin = new.copy()
    white = kind == WHITE
    # the last of a run of white space, with text behind it
    edge = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    space = cp[edge] == 32
    begin[edge] = True  # the run before it ends here, if it is longer
    begin[edge[space] + 1] = False  # a space goes with what follows
    # contractions: a run that is one apostrophe, without a space before it, and letters behind
    at = np.flatnonzero((cp == 39) & begin & (kind == OTHER))
    at = at[at + 1 < n]
    at = at[new[at + 1] & (kind[at + 1] == LETTER) & ~last[at]]
    if len(at):
        c1 = cp[at + 1]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        more = (at + 2 < n) & ~last[at + 1]
        c2 = np.where(more, cp[np.minimum(at + 2, n - 1)], 0)
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        took = np.where(one, 1, np.where(two, 2, 0))
        for size in (1, 2):
            a = at[took == size]
            begin[a + 1] = False
            rest = a + 1 + size
            ok = (rest < n) & ~last[np.minimum(rest - 1, n - 1)]
            begin[rest[ok]] |= kind[rest[ok]] == LETTER
    return np.flatnonzero(begin)


def hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(cp)
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            p = np.full(n + 65536, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    total = np.zeros(n + 1, np.uint64)
    value = _VALUE[cp & 0xFFFF]
    if (high := cp > 0xFFFF).any():
        value[high] ^= k.mix(cp[high].astype(np.uint64) + U(1))
    value *= _POWERS[0][:n]
    np.cumsum(value, out=total[1:])
    return k.mix((total[end] - total[start]) * _POWERS[1][start])


class Memory:
    """Ids of parts by the parts' 64-bit keys; bounded, as it starts anew beyond ``limit`` keys."""

    def __init__(self, limit: int = MEMORY):
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, h: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts with keys ``h`` one after the other, and the n + 1 places of the parts.

        ``learn(firsts)`` gives ids and sizes of the parts at these places of ``h``.
        """
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at] != keys
        if new.any():
            if len(self.keys) + new.sum() > self.limit:
                self._forget()
                new[:] = True
            ids, size = learn(first[new])
            slots = len(self.begin) - 1 + np.arange(len(size))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.slots = np.insert(self.keys, at, keys[new]), np.insert(self.slots, at, slots)
        slot = self.slots[np.searchsorted(self.keys, keys)][back] if len(keys) else np.zeros(0, np.int64)
        size = self.begin[slot + 1] - self.begin[slot]
        to = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.arange(to[-1]) + np.repeat(self.begin[slot] - to[:-1], size)], to


class Encoder:
    """Ids of texts by the tokenizer file at ``path``; one for each worker."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges in a form that encodes one pretoken at a time: a merge's rank is its id
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in s): i for s, i in self.tokenizer.get_vocab(False).items() if s != SPECIAL}
        self.one = tiktoken.Encoding("pretokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.memory = Memory()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the n + 1 places of the texts among them."""
        special = [i for i, t in enumerate(texts) if SPECIAL in t]
        plain = ["" if SPECIAL in t else t for t in texts] if special else texts
        off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))))
        whole = "".join(plain)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = splits(cp, off)
        end = np.append(start[1:], len(cp))
        h = hashes(cp, start, end) if len(start) else np.zeros(0, np.uint64)

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = [self.one._encode_single_piece(whole[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size

        ids, to = self.memory.find(h, learn)
        place = to[np.searchsorted(start, off)]
        if special:
            parts = np.split(ids, place[1:-1])
            for i in special:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
            ids, place = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, place


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
