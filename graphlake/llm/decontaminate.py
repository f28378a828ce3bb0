"""Benchmark decontamination: an FM-index per shard of the corpus, searched backwards for the items' phrases.

A task reads documents, maps words to the numbers of the items' words and keeps the runs of such words that
are long enough to hold a phrase (an occurrence can't contain any other word). When a shard is full it is
indexed, all phrases are searched at once, the occurrences are located and merged into spans. Nothing is
shuffled and the corpus is read once.

Phrases come in blocks of a bounded number of windows, dealt by Spark; a task has one block at a time and
searches each shard for one after another. An item longer than a part is cut into overlapping parts, whose windows
together are the item's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._scratch import materialize, release
from graphlake.llm._text import NOT_ALNUM, string_slices, word_bounds, word_hashes
from graphlake.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words that are indexed together.
SHARD = 500_000
#: Documents whose results a task gathers at most before it indexes a shard that isn't full.
SHARD_ROWS = 20_000
#: Windows of a block of phrases, about, and of a part of an item at most.
BLOCK_WINDOWS, PART_WINDOWS = 500_000, 4096
#: Slots of the filter that knows the words of all blocks, by hash.
SLOTS = 1 << 22
_FOLD = {c: c + 32 for c in range(65, 91)}


class Phrases:
    """The windows of a block of items' parts, in symbols."""

    def __init__(self, parts: list[tuple[str, str]], width: int):
        vocabulary: dict[str, int] = {}
        numbers: dict[str, int] = {}
        windows, owners = [], []
        for item, text in parts:
            words = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall(text.translate(_FOLD))], np.int32)
            if not len(words):
                continue
            if len(words) < width:  # right-aligned
                words = np.concatenate([np.zeros(width - len(words), np.int32), words])
            own = np.lib.stride_tricks.sliding_window_view(words, width)
            windows.append(own)
            owners.append(np.full(len(own), numbers.setdefault(item, len(numbers)), np.int64))
        self.items = list(numbers)
        self.symbols = len(vocabulary) + 1
        every = np.concatenate(windows) if windows else np.zeros((0, width), np.int32)
        self.phrases, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1).astype(np.int64)
        owned = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], 1), axis=0) if windows else np.zeros((0, 2), np.int64)
        self.owner = owned[:, 1].astype(np.int32)  # of phrase p: from first_owner[p] to the next one's
        self.first_owner = np.searchsorted(owned[:, 0], np.arange(len(self.phrases) + 1))
        self.least = int(self.lengths.min()) if len(self.phrases) else 0
        # the words' hashes, as those of the documents' words
        joined = "\n".join(vocabulary).encode()
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_ALNUM)
        h = word_hashes(data, starts, ends)
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], (order + 1).astype(np.int64)

    def owners(self, phrase: int) -> list[int]:
        return self.owner[self.first_owner[phrase] : self.first_owner[phrase + 1]].tolist()

    def symbols_of(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words of no item."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], 0)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Known:
    """What a task has of all blocks: the filter of their words, the shortest phrase and the blocks' broadcasts."""

    maybe: np.ndarray
    least: int
    blocks: list

    def phrases(self) -> Iterator[Phrases]:
        """One block after another; a worker lets go of each before the next, unless it is the only one."""
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > 1:
                b.__dict__.pop("_value", None)


SPAN = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("from_char", pa.int64()), ("to_char", pa.int64())]))
RESULT = "id long, n_words long, spans array<struct<from_word:long,to_word:long,from_char:long,to_char:long>>, items array<string>"


def merge_spans(spans: list[tuple[int, int, int, int]]) -> list[dict]:
    """Overlapping or touching spans (words from and to, characters from and to) as one."""
    out: list[list[int]] = []
    for w0, w1, c0, c1 in sorted(spans):
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1][1], out[-1][3] = w1, c1
        else:
            out.append([w0, w1, c0, c1])
    return [dict(zip(("from_word", "to_word", "from_char", "to_char"), x)) for x in out]


def _runs(on: np.ndarray, breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions in runs of ``on`` of at least so many, and where a run ends. breaks: no run crosses these."""
    change = np.empty(len(on) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = on[1:] != on[:-1]
    change[breaks] = True
    edges = np.flatnonzero(change)
    length = np.diff(edges)
    good = on[edges[:-1]] & (length >= least) if len(on) else np.zeros(0, bool)
    lo, n = edges[:-1][good], length[good]
    total = np.cumsum(n)
    index = np.repeat(lo - (total - n), n) + np.arange(total[-1] if len(total) else 0)
    last = np.zeros(len(index), bool)
    last[total - 1] = True
    return index, last


class _Shard:
    """The runs of one shard and the documents they are from."""

    def __init__(self, known: Known):
        self.known = known
        self.ids: list = []
        self.n_words: list[np.ndarray] = []
        self.kept: list[tuple[np.ndarray, ...]] = []  # hash, document, word, first and last character, run's end
        self.size = self.rows = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, at = word_bounds(data, offsets, NOT_ALNUM)
        known = self.known
        if known.least and len(starts):
            h = word_hashes(data, starts, ends)
            index, last = _runs(known.maybe[_slots(h)], at, known.least)
            if len(index):
                doc = np.searchsorted(at, index, "right") - 1
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[doc]]
                self.kept.append((h[index], doc + self.rows, index - at[doc], chars[starts[index]] - base, chars[ends[index]] - base, last))
                self.size += len(index)
        self.ids.append(ids)
        self.n_words.append(np.diff(at))
        self.rows += len(offsets) - 1

    def solve(self) -> pa.RecordBatch:
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.kept:
            h, doc, word, lo_char, hi_char, last = (np.concatenate(c) for c in zip(*self.kept))
            breaks = np.flatnonzero(last) + 1
            for known in self.known.phrases():
                symbol = known.symbols_of(h)
                index, ends = _runs(symbol > 0, breaks, known.least)
                if not len(index):
                    continue
                place = np.arange(len(index)) + np.cumsum(ends) - ends  # a 0 after each run
                text = np.zeros(len(index) + int(ends.sum()), np.int64)
                text[place] = symbol[index]
                back = np.zeros(len(text), np.int64)
                back[place] = index
                fm = FMIndex(text, known.symbols)
                lo, hi = fm.search(known.phrases, known.lengths)
                found = np.flatnonzero(hi > lo)
                if not len(found):
                    continue
                n = (hi - lo)[found]
                total = np.cumsum(n)
                rows = np.repeat(lo[found] - (total - n), n) + np.arange(total[-1])
                phrase = np.repeat(found, n)
                begin = back[fm.locate(rows)]
                end = begin + known.lengths[phrase] - 1
                for d, p in np.unique(np.stack([doc[begin], phrase], 1), axis=0).tolist():
                    items.setdefault(d, set()).update(known.items[i] for i in known.owners(p))
                for d, *span in np.unique(np.stack([doc[begin], word[begin], word[end] + 1, lo_char[begin], hi_char[end]], 1), axis=0).tolist():
                    spans.setdefault(d, []).append(tuple(span))
        ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in self.ids])
        cols = [ids, pa.array(np.concatenate(self.n_words)), pa.array([merge_spans(spans.get(d, [])) for d in range(self.rows)], SPAN), pa.array([sorted(items.get(d, ())) for d in range(self.rows)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "spans", "items"])


def _finder(maybe_b, least: int, blocks: list):
    def run(batches):
        known = Known(maybe_b.value, least, blocks)
        shard = _Shard(known)
        for batch in batches:
            for lo, hi, data, offsets in string_slices(batch.column(1)):
                shard.add(batch.column(0).slice(lo, hi - lo), data, offsets)
                if shard.size >= SHARD or shard.rows >= SHARD_ROWS:
                    yield shard.solve()
                    shard = _Shard(known)
        if shard.rows:
            yield shard.solve()

    return run


def _parter(width: int, windows: int):
    """(item, text) -> (item, words of a part, its windows)"""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.translate(_FOLD))
                for lo in range(0, max(1, len(words) - width + 1) if words else 0, windows):
                    part = words[lo : lo + windows + width - 1]
                    rows.append((item, " ".join(part), max(1, len(part) - width + 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["i", "t", "n"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """-> (id_col, n_words, spans, items), one row per document.

    Words are those of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. A window is ``width``
    consecutive words of an item; an item of fewer, but not none, is one window. spans: the words, and the
    characters, that occurrences cover, merged; items: the ids of the items with a window that occurs, as
    sorted strings. ``block_windows`` bounds what the driver and a task hold of the items.

    Defined cases: a null or empty text has no words and no spans; a null or wordless item has no windows; a
    null item id is the empty string; items of one id count once; a null document id and repeated rows keep a
    row each; texts and items of any length count whole; empty tables give empty results or none found; other
    columns are not read.
    """
    spark = docs.sparkSession
    given = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    parts = materialize(map_batches(given, _parter(width, min(PART_WINDOWS, block_windows)), "i string, t string, n long").dropDuplicates(), "phrases")
    blocks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_windows))
    maybe, least, held = np.zeros(SLOTS, bool), 0, []
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).select("i", "t").collect()
        phrases = Phrases([(r.i, r.t) for r in rows], width)
        if phrases.least:
            maybe[_slots(phrases.hashes)] = True
            least = min(least or width, phrases.least)
            held.append(spark.sparkContext.broadcast(phrases))
    release(parts)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_batches(src, _finder(spark.sparkContext.broadcast(maybe), least, held), RESULT)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def words_hit(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to_word"] - s["from_word"])


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the spans' characters."""
    start = F.lit(0).cast("long")
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("kept"), start.alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(text, (a["at"] + 1).cast("int"), (s["from_char"] - a["at"]).cast("int"))).alias("kept"), s["to_char"].alias("at")),
    )
    return F.concat(done["kept"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
