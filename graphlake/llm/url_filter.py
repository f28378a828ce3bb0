"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm._scratch import materialize

#: Hex digits of the digest that the join compares first.
SHORT = 8
#: The most rules that are broadcast, as digests, a number and a verdict of WORD bytes at most; beyond it the joins shuffle.
BROADCAST_RULES, WORD = 200_000, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    given = url.isNotNull() & (at > 0)
    return F.when(given, host).otherwise(""), F.when(given, path).otherwise("")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def _confirmed(asked: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """The rows of ``asked`` (digest, ...) with those of ``known`` (full, ...) of the same digest: the join is on its
    first digits, the whole is compared then. What nothing fits goes before anything else is done."""
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    known = known.withColumn("short", F.substring("full", 1, SHORT))
    return asked.join(F.broadcast(known) if small else known, "short").where("digest = full").drop("short", "digest", "full")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages and rules (host, path, verdict) -> (id_col, url_col, host, path, rule, verdict), one row per page.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. Every URL is expanded
    into its host suffixes, as deep as rules have hosts; those that rules have are expanded into the path prefixes
    of the lengths of that host's rules. Both expansions meet the rules on the first SHORT digits of a digest, and
    the whole digest is then compared. The longest rule wins: the longer host and path together, then the longer
    host; of one rule given twice, ``block``. The verdict is the rule's, else ``default``.

    Defined cases: a null URL, or one without ://, has an empty host and path, which a rule of an empty host and
    path alone fits; null ids and repeated rows keep a row each; rules with a null in any column are ignored, an
    empty table of rules leaves the default everywhere; rules may have any number of hosts and path lengths; other
    columns are not read; URLs count whole.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = materialize(rules.select("host", _digest(F.col("host"), F.col("path")).alias("full"), F.size(F.split("host", "[.]")).alias("depth"), F.length("path").alias("len"), "verdict"), "rules")
    n, depth, word = known.agg(F.count("*"), F.max("depth"), F.max(F.octet_length("verdict"))).first()
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), path.alias("path"))
    if not n:
        return out.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # a row's number is written with it, so that a task that runs again finds the same
    out = materialize(out.withColumn("uid", F.monotonically_increasing_id()), "urls")
    small = n <= BROADCAST_RULES and word <= WORD
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda d: F.array_join(F.slice(parts, -d, d), "."))
    asked = out.select("uid", "path", F.explode(suffixes).alias("h")).withColumn("digest", _digest(F.col("h")))
    hosts = known.select(_digest(F.col("host")).alias("full"), "len").distinct()
    asked = _confirmed(asked, hosts, small).where(F.col("len") <= F.length("path")).withColumn("p", F.substring(F.col("path"), F.lit(1), F.col("len"))).drop("path", "len")
    hits = _confirmed(asked.withColumn("digest", _digest(F.col("h"), F.col("p"))), known.select("full", "verdict"), small)
    hit = F.struct((F.length("h") + F.length("p")).alias("l"), F.length("h").alias("lh"), F.concat("h", "p").alias("rule"), "verdict")
    best = hits.groupBy(F.col("uid").alias("of")).agg(F.max(hit).alias("best"))
    judged = out.join(best, F.col("uid") == F.col("of"), "left")
    return judged.select(id_col, url_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
