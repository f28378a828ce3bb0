"""Line dedup by site-relative frequency: lines on more than a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm._scratch import materialize
from graphlake.llm.url_filter import host_and_path

#: The most boilerplate lines, or sites, that are broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000
#: Pages of a site that one task of such a join takes, about.
SITE_PAGES = 100_000


def _with_site(rows: DataFrame, sites: DataFrame, salt: Column, small: bool, totals: DataFrame | None = None) -> DataFrame:
    """``rows`` (__site) with the columns of their site's row (__of, __parts, ...), null where there is none. Unless
    these are ``small``, a site of several parts is repeated for each, and its rows choose one by ``salt``."""
    if small:
        return rows.join(F.broadcast(sites), F.col("__site").eqNullSafe(F.col("__of")), "left")
    large = (totals or sites).where("__parts > 1").select(F.col("__of").alias("__large"), F.col("__parts").alias("__n"))  # few: each has SITE_PAGES pages
    rows = rows.join(F.broadcast(large), F.col("__site").eqNullSafe(F.col("__large")), "left").withColumn("__salt", F.coalesce(F.pmod(salt, "__n"), F.lit(0).cast("long"))).drop("__large", "__n")
    sites = sites.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    return rows.join(sites, F.col("__site").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")


def drop_boilerplate(
    pages: DataFrame, *, id_col: str = "doc_id", site_col: str = "source", url_col: str | None = None, text_col: str = "text", ratio: tuple[int, int] = (5, 100), least_pages: int = 3
) -> DataFrame:
    """-> (id_col, site, n_lines, n_dropped, clean_text), one row per page. The site is the host of ``url_col``, or
    ``site_col`` where no URL is given.

    Lines are parted by \\n and compared without blanks at their ends; blank lines are never dropped. A line
    is boilerplate on a site if it is on at least ``least_pages`` of its pages and on more than the share
    num/den of them; a page counts once however often it has the line. All its occurrences go.

    Lines are counted by 64-bit hashes with partial aggregates, so a line that a third of all pages have is a
    sum a task. A site's boilerplate is at most the mean number of lines a page divided by the ratio, however
    large the site, and is held as one array a site. Where sites or boilerplate are too many to be broadcast, a
    large site's rows are dealt over tasks by salts, in proportion to its pages.

    Defined cases: a null text has no lines and stays null, an empty one has one blank line; pages of a null
    site form a site of their own; null ids and repeated rows keep a row each and count as pages; lines of
    any length count whole; an empty table gives an empty result; other columns are not read.
    """
    num, den = ratio
    src = pages.select(F.col(id_col).alias("__id"), (F.col(site_col) if url_col is None else host_and_path(F.col(url_col))[0]).alias("__site"), F.col(text_col).alias("__text"))
    lines = F.split("__text", "\n", -1)
    hashes = F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    totals = materialize(src.groupBy(F.col("__site").alias("__of")).agg(F.count("*").alias("pages")).withColumn("__parts", F.ceil(F.col("pages") / SITE_PAGES)), "sites")
    small = totals.count() <= BROADCAST_ROWS
    seen = src.select("__site", F.explode(F.array_compact(F.array_distinct(hashes))).alias("line")).groupBy("__site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    seen = _with_site(seen, totals, F.col("line"), small).where(F.col("n") * den > F.col("pages") * num)
    marks = seen.groupBy(F.col("__site").alias("__of")).agg(F.collect_list("line").alias("marked"), F.first("__parts").alias("__parts"))
    marks = materialize(marks, "boilerplate")
    few = (marks.agg(F.sum(F.size("marked"))).first()[0] or 0) <= BROADCAST_ROWS
    out = _with_site(src, marks, F.xxhash64("__id", "__text"), few, totals)

    # marks that the page has, by hash sets; few of them, mostly. The outer lambda has them found once a page
    marked = F.array_intersect(F.array_compact(hashes), F.coalesce("marked", F.array().cast("array<bigint>")))
    every = F.arrays_zip(lines.alias("text"), hashes.alias("h"))
    keep = F.transform(F.array(marked), lambda own: F.filter(every, lambda x: x["h"].isNull() | ~F.array_contains(own, x["h"])))[0]
    out = out.select("__id", "__site", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("__text").isNotNull(), keep).alias("kept"))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__site").alias("site"),
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        (F.greatest("n_lines", F.lit(0)) - F.coalesce(F.greatest(F.size("kept"), F.lit(0)), F.lit(0))).cast("long").alias("n_dropped"),
        F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("clean_text"),
    )
