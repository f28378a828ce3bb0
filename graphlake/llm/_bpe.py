"""Word-wise encoding with a lower-casing BPE of word ends: each distinct word goes through the tokenizer once.

The tokenizer's own rules are: normalise (NFC, white space, lower case), split by a pattern into words, map
bytes, merge within words. Merges never cross words and every word's last id is that of a token with the end
mark, so a text's ids are its words' ids in order. Words are found with array operations over code points;
texts for which that isn't certain to equal the tokenizer's own rules are given to it whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from graphlake.llm._arrow import HELD
from graphlake.llm._text import mix64

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
SLOTS = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, lower case, whether the text must go to the tokenizer whole; hash values."""
    global _tables
    if _tables is None:
        n = 0x3000  # beyond it (ideographs and rarer signs) the tokenizer itself decides
        kind, lower, odd = np.zeros(n + 1, np.uint8), np.arange(n + 1, dtype=np.uint32), np.zeros(n + 1, bool)
        for c in range(n):
            ch = chr(c)
            cat = unicodedata.category(ch)
            kind[c] = LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else SPACE if ch.isspace() and not 0x1C <= c <= 0x1F else OTHER
            low = ch.lower()
            # code points that NFC may change or join, that lower-case to several or beyond the tables, or that versions may class otherwise
            if len(low) != 1 or ord(low) >= n or cat in ("Cn", "Cs", "Co") or unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch or 0x1100 <= c < 0x1200 or 0x1C <= c <= 0x1F or c in (0x85, 0x180E, 0x200B, 0xFEFF, 0x3A3):
                odd[c] = True
            else:
                lower[c] = ord(low)
        odd[n] = True
        _tables = kind, lower, odd, mix64(np.arange(1, n + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _tables


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if visible Latin-1, else the next from U+0100 on.
    The blank, which parts words here and is in none, stays."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in visible or (c := next(hidden)) and b == 32 else chr(c) for b in range(256)}


class WordEncoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        words_only = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
        self.merge = Tokenizer.from_str(json.dumps(words_only))
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        mark = spec["model"]["end_of_word_suffix"]
        self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.keys = np.zeros(SLOTS, np.uint64)  # an open-addressing table: hash -> number of the word
        self.number = np.zeros(SLOTS, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.filled = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the first free one on its way."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            key = self.keys[slot[todo]]
            todo = todo[(key != h[todo]) & (key != 0)]
        return slot

    def _learn(self, hashes: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add words that aren't known yet; the hashes are distinct."""
        size = ends - starts + 1  # with a blank after each
        after = np.cumsum(size)
        joined = np.full(after[-1], 32, np.uint32)
        inside = np.ones(after[-1], bool)
        inside[after - 1] = False
        joined[inside] = cps[np.repeat(starts - (after - size), size)[inside] + np.flatnonzero(inside)]
        words = joined.tobytes().decode("utf-32-le").split(" ")[:-1]
        mapped = [" ".join(words[i : i + 256]).encode().decode("latin1").translate(self.letters) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, self.ids.dtype) for e in self.merge.encode_batch_fast(mapped, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("a word's last id isn't that of a word end")
        first = np.concatenate([[0], last[:-1] + 1])
        numbers = np.arange(self.known, self.known + len(words))
        for name, new, at in (("start", first + self.filled, self.known), ("length", last - first + 1, self.known), ("ids", ids, self.filled)):
            held = getattr(self, name)
            if at + len(new) > len(held):
                held = np.concatenate([held, np.zeros(max(len(held), len(new)), held.dtype)])
                setattr(self, name, held)
            held[at : at + len(new)] = new
        self.known += len(words)
        self.filled += len(ids)
        todo = np.arange(len(hashes))
        while len(todo):  # of several for one free slot the last one gets it
            slot = self._slots(hashes[todo])
            self.keys[slot] = hashes[todo]
            got = self.keys[slot] == hashes[todo]
            self.number[slot[got]] = numbers[todo[got]]
            todo = todo[~got]

    def _certain(self, text: str, cps: np.ndarray, odd: np.ndarray) -> bool:
        return len(cps) <= 2 * REMEMBERED and not odd[cps].any() and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        kind, lower, odd, values = _code_points()
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        cut = [np.minimum(c, len(kind) - 1) for c in raw]
        sure = [self._certain(t, c, odd) for t, c in zip(texts, cut)]
        chosen = [c for c, ok in zip(cut, sure) if ok]
        pieces = iter(self._encode_sure(chosen) if chosen else [])
        return [next(pieces) if ok else np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, sure)]

    def _encode_sure(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        kind, lower, _, values = _code_points()
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        cps = lower[np.concatenate(parts)] if bounds[-1] else np.zeros(0, np.uint32)
        n = len(cps)
        k = np.zeros(n + 1, np.uint8)
        k[:n] = kind[cps]
        new = np.empty(n + 1, bool)  # a word or a run of white space starts here
        new[0] = True
        new[1:] = k[1:] != k[:-1]
        new[:n] |= k[:n] == NUMBER
        new[bounds] = True
        # contractions: at the start of a run of other signs, an apostrophe takes the letters after it
        quote = np.flatnonzero((cps == 39) & new[:n])
        if len(quote):
            end = bounds[np.searchsorted(bounds, quote, "right")]  # of the text
            def at(d):
                return np.where(quote + d < end, cps[np.minimum(quote + d, n - 1)], 0)
            one, two = at(1), at(2)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                double |= (one == ord(a)) & (two == ord(b))
            for found, width in ((quote[single], 2), (quote[double & ~single], 3)):
                new[found + 1] = False
                new[np.minimum(found + width, n)] = True
        edges = np.flatnonzero(new)
        word = k[edges[:-1]] != SPACE
        starts, ends = edges[:-1][word], edges[1:][word]
        up, down = _pows(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        v = values[cps]
        v *= up[:n]
        np.cumsum(v, out=sums[1:])
        h = mix64((sums[ends] - sums[starts]) * down[starts])
        at = self._find(h, cps, starts, ends)
        length, first = self.length[at].astype(np.int64), self.start[at]
        out_at = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(first - out_at[:-1], length) + np.arange(out_at[-1])].astype(np.uint32)
        words = np.searchsorted(starts, bounds)
        return [flat[out_at[a] : out_at[b]] for a, b in zip(words[:-1], words[1:])]

    def _find(self, h: np.ndarray, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, after learning the new ones."""
        slot = self._slots(h)
        missing = np.flatnonzero(self.keys[slot] != h)
        if not len(missing):
            return self.number[slot]
        fresh, one = np.unique(h[missing], return_index=True)
        if self.known + len(fresh) > REMEMBERED and self.known:
            self._forget()
            return self._find(h, cps, starts, ends)
        at = missing[one]
        self._learn(fresh, cps, starts[at], ends[at])
        slot[missing] = self._slots(h[missing])
        return self.number[slot]


_power_cache: tuple[np.ndarray, np.ndarray] | None = None


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power_cache
    if _power_cache is None or len(_power_cache[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _power_cache = np.cumprod(up), np.cumprod(down)
    return _power_cache


_encoders: dict[str, WordEncoder] = {}
HELD["words"] = _encoders.clear


def encoder(path: str) -> WordEncoder:
    """One encoder a process, so that its words last over tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
