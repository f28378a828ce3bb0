"""Packing by Karmarkar-Karp multiway differencing: near-equal windows of at most a capacity.

A document's ids are cut into whole windows; what remains of it is an item. A task gathers items by blocks,
sorts out each block alone and keeps only lengths and checksums, so that there is no shuffle, no state
beyond a block, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._bpe import encoder

#: Items that are partitioned together.
BLOCK = 512
#: Code points that are encoded together.
SLICE = 150_000


def differencing(sizes: list[int], ways: int) -> tuple[list[list[int]], int]:
    """Karmarkar-Karp: ``ways`` groups of near-equal sums, and the largest sum.

    Every item begins as a partial partition of its own. The two of the largest spread are merged, the
    largest groups of one with the smallest of the other, until one is left.
    """
    if not sizes:
        return [[] for _ in range(ways)], 0
    left: list[int] = []
    right: list[int] = []  # merged groups, as a binary forest: node len(sizes) + i is left[i] and right[i]
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heap[0]
        sums, nodes, other = s1 + s2[::-1], n1.copy(), n2[::-1]
        only = nodes < 0
        nodes[only] = other[only]
        both = np.flatnonzero(~only & (other >= 0))
        if len(both):
            at = len(sizes) + len(left)
            left += n1[both].tolist()
            right += other[both].tolist()
            nodes[both] = np.arange(at, at + len(both))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), count, sums, nodes))
        count += 1
    _, _, sums, nodes = heap[0]
    groups = []
    for node in nodes.tolist():
        items, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < len(sizes):
                items.append(x)
            else:
                stack += [left[x - len(sizes)], right[x - len(sizes)]]
        groups.append(sorted(items))
    return groups, int(sums[0])


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity``; the number of windows rises until the largest fits."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups, most = differencing(sizes, ways)
        if most <= capacity:
            return [g for g in groups if g]
        ways += max(1, ways * (most - capacity) // (4 * capacity))


def _packer(path: str, capacity: int, end_id: int):
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "crc", "tokens", "sequence", "offset"))])

    def run(batches):
        encode = encoder(path).encode
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence = part << 36
        held: list[tuple] = []
        rows: list[tuple] = []

        def settle():
            nonlocal sequence
            for group in pack_sizes([h[2] for h in held], capacity):
                at = 0
                for i in group:
                    rows.append((*held[i], sequence, at))
                    at += held[i][2]
                sequence += 1
            held.clear()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
            rows.clear()
            return batch

        def take(ids: list, texts: list[str]):
            nonlocal sequence
            for doc, own in zip(ids, encode(texts)):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                whole = len(own) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(own[start : start + capacity].tobytes()), len(own), sequence, 0))
                    sequence += 1
                if whole < len(own):
                    held.append((doc, whole, len(own) - whole, zlib.crc32(own[whole:].tobytes()), len(own)))
                if len(held) >= BLOCK:
                    settle()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo, size = 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size >= SLICE or i + 1 == len(texts):
                    take(ids.slice(lo, i + 1 - lo).to_pylist(), [t or "" for t in texts.slice(lo, i + 1 - lo).to_pylist()])
                    lo, size = i + 1, 0
                    if len(rows) >= 8192:
                        yield flush()
        settle()
        if rows:
            yield flush()

    return run, "id long, start long, length long, crc long, tokens long, sequence long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """-> (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    A document's ids are the tokenizer's without special ones, and then ``end_id``. Each id lies in exactly
    one piece; a sequence holds at most ``capacity`` ids, its pieces' offsets are gapless from 0. Sequence
    ids are distinct; the upper bits name the task.

    Defined cases: a null or empty text has the end id alone; a null id keeps its row's pieces; repeated rows
    are packed once each; texts of any length are encoded whole and cut at multiples of the capacity; an
    empty table gives an empty result; other columns are not read.
    """
    run, schema = _packer(tokenizer_path, capacity, end_id)
    out = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema, keeps="words")
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
