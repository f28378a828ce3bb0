"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._scratch import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; every step keeps the components as they are.

    Large: each node's larger neighbours go to the least of the node and its neighbours. Small: a node and
    its smaller neighbours go to the least of these. The minimum is a partial aggregate and goes back by a
    join that adaptive execution can split, so a hub's neighbours never meet in one task.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), in any direction, repeated or not -> (node, component), component being the
    least node reachable; nodes without an edge (or with one to themselves alone) have no row. Rows with a
    null end are no edges. Each round is written to the shared folder; rounds go on until nothing changes.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    while state[0]:
        nxt = materialize(_star(_star(cur, True), False), "edges")
        new = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        release(cur)
        cur = nxt
        if new == state:
            break
        state = new
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
