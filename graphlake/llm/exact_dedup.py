"""Exact dedup by progressive refinement: length, then the hash of a prefix, then the hash of the whole text.

What a step leaves over is a bitmap that every task of the next step has: of lengths one bit each, of (length,
prefix) pairs one bit by hash. So no step brings rows of one length together and no text is shuffled, whatever the
number of groups. Only counts and, of the survivors, whole hashes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm._bitmap import bitmap, maps_for, marked, place
from graphlake.llm._scratch import materialize, release

#: Code points of the prefix whose hash the second step compares.
PREFIX = 64
#: Of the pairs' bitmap the bits for each pair, and the maps at most (64 MB in all).
BITS_A_PAIR, MOST_MAPS = 16, 1 << 14
#: Groups of more rows than this, and than this part of all, are broadcast to their rows: at most so many groups.
HOT_ROWS, HOT_GROUPS = 1000, 10_000


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, tie_col: str | None = None) -> DataFrame:
    """-> (id_col, keep_id, group_size, kept, *carry), one row per input row; with ``tie_col`` that column as well.

    Texts are equal when they are identical without whitespace. Of equal texts the row with the most code
    points in the original stays, then the smallest id. The prefix is compared in rows whose length others share,
    the whole text is hashed in rows that share both (and in the few whose bit another pair has set; beyond 2^25
    pairs, more of these: the bitmap's size is bounded, the result is the same). ``carry``: more columns to return,
    as expressions over ``docs``. ``tie_col``: a column of unique numbers; of rows that tie the one of the least
    number stays, and it alone.

    Defined cases: a null text is an empty one; null ids sort last; without ``tie_col`` rows that tie in
    everything, repeated rows included, share one keep_id, and ``kept`` is true on each row of the group whose id is
    keep_id, so on repeats of it as well; texts count whole; an empty table gives an empty result; other columns are
    not read.
    """
    carry = (carry or {}) | ({tie_col: F.col(tie_col)} if tie_col else {})
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    length, prefix = F.length(norm).cast("long"), F.xxhash64(F.substring(norm, 1, PREFIX))

    first = materialize(docs.select(length.alias("len"), prefix.alias("prefix")), "prefixes")
    lengths = materialize(bitmap(first.groupBy(F.col("len").alias("at")).agg(F.count("*").alias("n")).where("n > 1")), "lengths")
    survivors = marked(first, F.col("len"), lengths).where("__hit")
    pairs = materialize(survivors.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("len", "prefix"), "pairs")
    maps = maps_for(pairs.count(), BITS_A_PAIR, MOST_MAPS)
    suspects = materialize(bitmap(pairs.select(place(maps, "len", "prefix").alias("at"))), "suspects")
    for df in (first, lengths, pairs):
        release(df)

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), length.alias("__len"), prefix.alias("__prefix"), F.length(text).alias("__points"), norm.alias("__norm"), *(c.alias(k) for k, c in carry.items()))
    rows = marked(rows, place(maps, "__len", "__prefix"), suspects)
    hashed = materialize(rows.select("__id", "__points", F.when(F.col("__hit"), F.sha2(F.col("__norm").cast("binary"), 256)).alias("__full"), *carry), "hashed")
    release(suspects)

    tie = F.col(tie_col) if tie_col else F.lit(None).cast("long")
    best = F.min(F.struct(-F.col("__points"), F.col("__id").isNull(), F.col("__id").alias("id"), tie.alias("tie")))
    some = hashed.where("__full is not null")
    groups = materialize(some.groupBy(F.col("__full").alias("__of")).agg(best["id"].alias("__keep"), best["tie"].alias("__tie"), F.count("*").alias("__size")), "groups")
    large = groups.where(F.col("__size") > max(HOT_ROWS, some.count() // HOT_GROUPS))
    same = F.col("__full") == F.col("__of")
    # a large group's rows stay where they are; those of the others meet their group by a shuffle
    out = some.join(F.broadcast(large), same)
    out = out.unionAll(some.join(F.broadcast(large.select("__of")), same, "left_anti").join(groups.join(F.broadcast(large.select("__of")), "__of", "left_anti"), same).select(*out.columns))
    # rows without a hash stand alone; in the join their nulls would meet in one task
    alone = hashed.where("__full is null").select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    kept = F.col("__tie") == F.col(tie_col) if tie_col else F.col("__keep").eqNullSafe(F.col("__id"))
    return alone.unionAll(out.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), kept.alias("kept"), *carry))
