"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges.

Law ``bytes``: the shards' sizes are near equal, and equal texts go to one shard. Records are put in the order of
(digest of the text, id, number of the row). A sample of the keys, weighted by size, gives the boundaries of many
fine ranges, more of them the more rows there are; a group of equal texts that is overfull for a range is so
subdivided for the tasks, though not for the shards.

Where a record goes follows from exact sums, never from the sample. Groups of equal texts of at least 1 / LARGE of a
shard are dealt first, the largest to the emptiest shard. The others lie on a line of bytes in key order, cut
where each shard is full; a group goes to the shard that its middle falls into, whole. Only a group of more bytes
than a shard's equal share is cut, at exact places, into whole shares and a rest.

DataFrame functions only. What reaches the driver is bounded by the number of ranges, not by the rows of a key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm._scratch import materialize, release

#: Record overhead in bytes that counts beside the text.
OVERHEAD = 8
#: Groups of equal texts of this part of a shard (1 / LARGE) or more are dealt one by one.
LARGE = 64
#: Ranges a shard at least, rows a range about at most, and the samples that are drawn for each range.
RANGES_PER_SHARD, RANGE_ROWS, SAMPLES_PER_RANGE = 32, 1_000_000, 8


def _order_key(digest: Column, record_id: Column, row: Column) -> Column:
    """A string that sorts as (digest, id, row), null ids first."""
    unsigned = record_id.bitwiseXOR(F.lit(-(1 << 63)))
    own = F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(unsigned), 16, "0")), F.lit("0" * 17))
    return F.concat(digest, own, F.lpad(F.hex(row), 16, "0"))


def _bounds_at_or_below(key: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted ``bounds`` are <= key: a binary search as a fold over its step widths."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>")  # one literal, folded once
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when((pos + step <= len(bounds)) & (F.try_element_at(array, pos + step) <= key), pos + step).otherwise(pos))


def deal(groups: list[tuple[str, int]], total: int, shards: int) -> tuple[dict[str, list[int]], list[int]]:
    """(the shards of each large group's pieces, the places that cut the line of the other groups).

    groups: digest and bytes. A group's pieces are whole shares, then its rest; the line's places are how many
    bytes of the other groups lie before each shard but the first.
    """
    share = max(1, -(-total // shards))
    pieces: dict[str, list[int]] = {}
    free = [(0, s) for s in range(shards)]  # a heap: bytes dealt, shard
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        pieces[h] = []
        while size > 0:
            part = min(size, share)
            held, s = heapq.heappop(free)
            heapq.heappush(free, (held + part, s))
            pieces[h].append(s)
            size -= part
    load = np.zeros(shards)
    for held, s in free:
        load[s] = held
    rest = max(0, total - sum(g[1] for g in groups))
    # the level up to which the rest fills the shards
    heights = np.sort(load)
    most = (rest + np.cumsum(heights)) / np.arange(1, shards + 1)
    level = most[np.flatnonzero(np.append(heights[1:], np.inf) >= most)[0]]
    room = np.maximum(level - load, 0)
    return pieces, [int(x) for x in np.cumsum(room)[:-1]]


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    size is the UTF-8 bytes of the text plus OVERHEAD; shard is from 0 to shards - 1; slot is gapless from 0
    in its shard.

    Defined cases: a null text counts no bytes, has the checksum 0 and is equal to the empty text; rows with
    null ids and repeated rows keep a row each, in the shard of their text; texts of any length count whole, a
    text longer than a shard's share fills a shard of its own beyond it; an empty table gives an empty result;
    other columns are not read.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    meta = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("h"),
    )
    # a row's number is written with it: rows that tie in all else still have an order of their own
    meta = materialize(meta.withColumn("row", F.monotonically_increasing_id()), "shard-keys")
    total, rows = meta.agg(F.sum("size"), F.count("*")).first()
    total, rows = total or 0, rows or 0

    # a record is drawn by its shares of the bytes and of the rows, so that a range is bounded in both
    ranges = max(1, min(shards * RANGES_PER_SHARD, rows // SAMPLES_PER_RANGE), -(-rows // RANGE_ROWS))
    samples = ranges * SAMPLES_PER_RANGE
    weight = (F.col("size") / max(total, 1) + 1 / max(rows, 1)) / 2
    luck = F.pmod(F.xxhash64("h", "id", "row"), F.lit(1 << 52)) / float(1 << 52)
    drawn = meta.where(luck < weight * samples).select(_order_key(F.col("h"), F.col("id"), F.col("row")).alias("key"), F.greatest(weight, F.lit(1 / samples)).alias("weight"), (F.col("size") / F.least(weight * samples, F.lit(1.0))).alias("bytes"))
    drawn = drawn.toArrow().sort_by("key")
    mass = np.cumsum(drawn.column("weight").to_numpy())
    at = np.searchsorted(mass, np.arange(1, ranges) / ranges * mass[-1], "right") if len(mass) else []
    cuts = sorted({drawn.column("key")[int(i)].as_py() for i in at if i < len(mass)})

    # exact bytes, by range, of the groups that may be large and of those that a range's boundary may cut
    met: dict[str, float] = {}
    for key, size in zip(drawn.column("key").to_pylist(), drawn.column("bytes").to_pylist()):
        met[key[:32]] = met.get(key[:32], 0.0) + size
    named = {h for h, size in met.items() if size * shards * LARGE * 2 >= total} | {c[:32] for c in cuts}
    ranged = meta.withColumn("range", _bounds_at_or_below(_order_key(F.col("h"), F.col("id"), F.col("row")), cuts, "string"))
    of = spark.createDataFrame(pa.table({"h": pa.array(sorted(named), pa.string())}))
    found = sorted(map(tuple, ranged.join(F.broadcast(of), "h", "left_semi").groupBy("h", "range").agg(F.sum("size")).collect()))
    sums: dict[str, int] = {}
    before = []  # bytes of the group before those in the range
    for h, _, size in found:
        before.append(sums.get(h, 0))
        sums[h] = sums.get(h, 0) + size
    large = {h: size for h, size in sums.items() if size * shards * LARGE >= total}
    pieces, places = deal(list(large.items()), total, shards)

    parts = pa.table({
        "h": pa.array([f[0] for f in found], pa.string()),
        "range": pa.array([f[1] for f in found], pa.int32()),
        "in_group": pa.array(before, pa.int64()),
        "whole": pa.array([sums[f[0]] for f in found], pa.int64()),
        "pieces": pa.array([pieces.get(f[0]) for f in found], pa.list_(pa.int32())),
    })
    ranged = ranged.join(F.broadcast(spark.createDataFrame(parts)), ["h", "range"], "left")
    on_line = F.when(F.col("pieces").isNull(), F.col("size")).otherwise(0)
    starts, at = [0] * (len(cuts) + 1), 0
    for r, size in sorted(ranged.groupBy("range").agg(F.sum(on_line)).collect()):
        starts[r] = at
        at += size
    starts = [max(starts[: r + 1]) for r in range(len(starts))]  # of a range without rows
    base = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")[F.col("range")]

    order = [F.col("id").asc_nulls_first(), F.col("row")]
    line = Window.partitionBy("range").orderBy("h", *order).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "h")
    placed = ranged.select(
        "*",
        F.sum(on_line).over(line).alias("end"),
        F.sum("size").over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("group_at"),
    )
    placed = placed.select("*", F.min(F.col("end") - F.col("size")).over(group).alias("begin"), F.sum("size").over(group).alias("held"))
    # a group's middle on the line; of one that a range cuts, what lies in other ranges counts as well
    middle = 2 * (base + F.col("begin") - F.coalesce("in_group", F.lit(0))) + F.coalesce("whole", "held")
    share = max(1, -(-total // shards))
    piece = F.least(F.floor((2 * (F.col("in_group") + F.col("group_at")) - F.col("size")) / F.lit(2 * share)).cast("int"), F.size("pieces") - 1)
    shard = F.when(F.col("pieces").isNotNull(), F.col("pieces")[piece]).otherwise(_bounds_at_or_below(middle, [2 * p for p in places], "bigint"))
    placed = placed.select("id", "size", "crc", "range", "h", "row", shard.alias("shard"))
    placed = placed.withColumn("rn", F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", *order)))
    placed = materialize(placed.select("id", "size", "crc", "range", "rn", "shard"), "placed")
    release(meta)

    # a shard's rows are those of its ranges one after another
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    offset, filled = [], {}
    for s, r, n in sorted(map(tuple, counts.collect())):
        offset.append((s, r, filled.get(s, 0) - 1))
        filled[s] = filled.get(s, 0) + n
    offsets = spark.createDataFrame(offset, "shard int, range int, offset long")
    return placed.join(F.broadcast(offsets), ["shard", "range"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rn") + F.col("offset")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
