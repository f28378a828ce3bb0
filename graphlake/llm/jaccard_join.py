"""N-gram Jaccard join: prefixes of token combinations, verified, and the components of the links.

Method. A document's tokens are its distinct k-word shingles. Tokens are ordered by (class, hash); class 1
holds the rare tokens, class 2 those of at least ``frequent`` documents and class 3 those of at least
``very_frequent``. A document indexes single tokens of class 1, pairs of tokens of class 2 and triples of
class 3 out of the shortest prefix that must keep one such combination whole in every partner: a partner
lacks at most ``n - ceil(t n)`` tokens, a class-1 token is lost by one lack, and a bucket of f tokens of
class c keeps a combination until f - (c - 1) of them are lost. Buckets are small groups by hash, so that
the combinations stay about proportional to the prefix. The result does not depend on which tokens are
held to be frequent; that only steers the cost.

Every list of documents that share a combination is then resolved without its square of pairs: each member
is verified against one hub of the list and a neighbour, components are built, and only members of different
components in one list are compared further. Lists with the same members are one. A list that the counts of its
tokens say may be long is dealt over tasks by salts; the parts' components meet by one member each.

Equal sets are one node, named by 64 bits of the set; sets that share these but differ in size or in 64 other bits
are given names of their own. Token sets move for pairs only that sketches, the finer the larger the sets, can't
rule out; they are made again from the texts that a bitmap of the nodes' texts picks, so that no text moves and no
corpus of sets is stored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._bitmap import bitmap, maps_for, marked, place
from graphlake.llm._scratch import materialize, release
from graphlake.llm._text import mix64, shingle_sets, sorted_distinct, string_slices
from graphlake.llm.components import connected_components

#: Tokens that a task counts before it passes its repeated ones on.
SUMMARY_TOKENS = 2_000_000
#: The most tokens that are broadcast; beyond it the bound of "frequent" rises, which costs candidates alone.
BROADCAST_ROWS = 2_000_000
#: Of the bitmap of texts that are read again the bits for each, and the maps at most (64 MB in all).
BITS_A_TEXT, MOST_MAPS = 256, 1 << 14
#: Members of a list that one task orders, about; longer lists are salted.
LIST_ROWS = 200_000
#: Probes and targets of a block of the last comparison, about.
BLOCK_PROBES, BLOCK_ROWS = 256, 1024
#: Tokens beyond which a set has a fine sketch as well.
FINE = 1024

#: Rounds of a hub and a neighbour each, before all that is left is compared.
ROUNDS = 2

_M1, _M2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)


def set_node(tokens: np.ndarray, bits: int = 64) -> int:
    """A fingerprint of a token set; 0 is kept for the empty set."""
    if not len(tokens):
        return 0
    x = np.add.reduce(mix64(tokens * _M1)) ^ np.uint64(len(tokens))
    return int(mix64(np.array([x], np.uint64)).view(np.int64)[0]) >> (64 - bits) or 1


def set_check(tokens: np.ndarray) -> int:
    """Another one, independent of the first."""
    return int(np.add.reduce(mix64(tokens * _M2)).view(np.int64)) if len(tokens) else 0


class Names:
    """The nodes of token sets. ``own``: (node, n, check) -> the name of a set whose node others have too."""

    def __init__(self, bits: int, own: dict[tuple[int, int, int], int]):
        self.bits, self.own, self.shared = bits, own, {k[0] for k in own}

    def of(self, tokens: np.ndarray) -> int:
        node = set_node(tokens, self.bits)
        return self.own[node, len(tokens), set_check(tokens)] if node in self.shared else node


def _profile(k: int, bits: int):
    """(id, h, text) -> a row (0, id, h, node, n, check) a document and rows (1, null, null, token, count, 0) of
    repeated tokens."""
    schema = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("id", "h", "key", "n", "check"))])

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()

        def flush():
            nonlocal held, size
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held, size = [], 0
            seen.clear()
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(x)))
            at, count = at[count > 1], count[count > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(x[at].view(np.int64)), pa.array(count), pa.array(np.zeros(len(at), np.int64))], schema=schema)

        for batch in batches:
            node, n, check = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            row = 0
            for _, _, data, offsets in string_slices(batch.column(2)):
                for tokens in shingle_sets(data, offsets, k):
                    node[row], n[row], check[row] = set_node(tokens, bits), len(tokens), set_check(tokens)
                    if check[row] not in seen:  # copies of one set count once a summary
                        seen.add(int(check[row]))
                        held.append(tokens)
                        size += len(tokens)
                    row += 1
                if size >= SUMMARY_TOKENS:
                    yield flush()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), batch.column(0), batch.column(1), pa.array(node), pa.array(n), pa.array(check)], schema=schema)
        yield flush()

    return run, "kind byte, id long, h long, key long, n long, check long"


def _named(ids: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """ids (id, h, node, n, check) -> (id, h, node, n) with a node of its own for every set, and the names. The sets
    that share 64 bits are a handful in any corpus; each gets a name that 64 bits of a hash of all three give."""
    shared = ids.groupBy("node").agg(F.min(F.struct("n", "check")).alias("lo"), F.max(F.struct("n", "check")).alias("hi")).where("lo <> hi").select("node")
    shared = materialize(shared, "shared")
    if shared.isEmpty():
        return ids.drop("check"), Names(bits, {})
    clash = materialize(ids.join(F.broadcast(shared), "node", "left_semi").select("node", "n", "check").distinct().withColumn("name", F.xxhash64("node", "n", "check")), "clash")
    own = {(r[0], r[1], r[2]): r[3] for r in clash.collect()}
    ids = ids.join(F.broadcast(clash), ["node", "n", "check"], "left").select("id", "h", F.coalesce("name", "node").alias("node"), "n")
    return ids, Names(bits, own)


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _buckets(size_class: int, num: int, den: int) -> tuple[int, int] | None:
    """Buckets of the pairs and of the triples for sets of 2^(size_class-1) tokens or more, so few that a
    document's tokens always suffice for its prefix; None where they can't, and single tokens are indexed."""
    n = 1 << (size_class - 1)
    two, three = max(1, n // 8), max(1, n // 10)
    return (two, three) if _least_overlap(n, num, den) - 1 >= two + 2 * three else None


@cache
def _chosen(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)))


def _combinations(tokens: np.ndarray, counts: np.ndarray, at: np.ndarray, size: int, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the combinations of ``size`` tokens within each bucket, and their least count."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    out = []
    for part, n in zip(np.split(tokens[order], cuts), np.split(counts[order], cuts)):
        if len(part) >= size:
            combos = _chosen(len(part), size)
            h = np.full(len(combos), np.uint64(salt * 4 + size))
            for c in range(size):
                h = mix64(h * _M1 + part[combos[:, c]])
            out.append((h, n[combos].min(axis=1)))
    return out


def _signatures(tokens: np.ndarray, classes: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """``signatures`` and, for each, the least count of its tokens, which bounds its list."""
    n = len(tokens)
    least = _least_overlap(n, num, den)
    need = n - least + 1
    rare = tokens[classes == 1]
    if len(rare) >= need:
        return rare[:need], np.zeros(need, counts.dtype)
    out = [(rare, np.zeros(len(rare), counts.dtype))]
    for size_class in {n.bit_length(), least.bit_length()}:
        if (buckets := _buckets(size_class, num, den)) is None:
            order = np.argsort(classes, kind="stable")[:need]
            out.append((tokens[order], counts[order]))
            continue
        left = need - len(rare)
        for size, count in zip((2, 3), buckets):
            often, times = tokens[classes == size], counts[classes == size]
            if left <= 0 or not len(often):
                continue
            at = (mix64(often ^ _M2) % np.uint64(count)).astype(np.int64)
            order, sizes = np.argsort(at, kind="stable"), np.bincount(at, minlength=count)
            rank = np.empty(len(often), np.int64)
            rank[order] = np.arange(len(often)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gained = np.cumsum(rank >= size - 1)  # a bucket's first size-1 tokens don't make a combination
            end = min(int(np.searchsorted(gained, left)) + 1, len(often))
            out += _combinations(often[:end], times[:end], at[:end], size, size_class)
            left -= int(gained[end - 1])
    sigs, at = np.unique(np.concatenate([s for s, _ in out]), return_index=True)
    return sigs, np.concatenate([c for _, c in out])[at]


def signatures(tokens: np.ndarray, classes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The combinations under which a document is indexed. tokens: sorted hashes; classes: 1, 2 or 3 each.

    Two documents of similarity num/den or more share one. Combinations of frequent tokens belong to a size
    class; a document has those of its own class and of its smallest possible partner's.
    """
    return _signatures(tokens, classes, np.zeros(len(tokens), np.int64), num, den)[0]


def _index(often_b, k: int, num: int, den: int, names: Names, list_rows: int):
    """text -> (sig, salt, node, n), once for equal sets in a task. salt: -1, or the part of a list that may be long."""

    def run(batches):
        often, cls, times = often_b.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(often & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0)):
                sigs, salts, nodes, ns = [], [], [], []
                for tokens in shingle_sets(data, offsets, k):
                    n = len(tokens)
                    node = names.of(tokens)
                    # without an equal set, so few tokens have no partner
                    if node in seen or _least_overlap(n + 1, num, den) > n and _least_overlap(n, num, den) == n:
                        continue
                    seen.add(node)
                    classes, counts = np.ones(n, np.int8), np.zeros(n, np.int64)
                    hit = np.flatnonzero(maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    if len(hit) and len(often):
                        pos = np.minimum(np.searchsorted(often, tokens[hit]), len(often) - 1)
                        same = often[pos] == tokens[hit]
                        classes[hit], counts[hit] = np.where(same, cls[pos], 1), np.where(same, times[pos], 0)
                    s, least = _signatures(tokens, classes, counts, num, den)
                    parts = -(-least // list_rows)
                    own = int(mix64(np.array([node], np.int64).view(np.uint64))[0] >> np.uint64(2))
                    sigs.append(s)
                    salts.append(np.where(parts > 1, own % np.maximum(parts, 1), -1).astype(np.int32))
                    nodes.append(np.full(len(s), node, np.int64))
                    ns.append(np.full(len(s), n, np.int32))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (salts, nodes, ns))], names=["sig", "salt", "node", "n"])

    return run, "sig long, salt int, node long, n int"


def _sketch(tokens: np.ndarray, bits: int = 8) -> bytes:
    """Tokens by bucket, at most 255: the sum of two sketches' minima bounds the intersection from above."""
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _fine_sketch(tokens: np.ndarray) -> bytes | None:
    """A sketch of a large set with few tokens a bucket."""
    return _sketch(tokens, len(tokens).bit_length() - 1) if len(tokens) > FINE else None


def _sets(k: int, whole: bool, names: Names):
    """text -> (node, n, sketch, fine) or, if ``whole``, (node, tokens); once for equal sets in a task."""
    fields = [("node", pa.int64()), ("tokens", pa.binary())] if whole else [("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("fine", pa.binary())]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0)):
                rows = []
                for tokens in shingle_sets(data, offsets, k):
                    if (node := names.of(tokens)) not in seen:
                        seen.add(node)
                        rows.append((node, tokens.tobytes()) if whole else (node, len(tokens), _sketch(tokens), _fine_sketch(tokens)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields])

    return run, "node long, tokens binary" if whole else "node long, n int, sketch binary, fine binary"


def _bytes_matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), 256)


def _may_link(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, num: int, den: int) -> np.ndarray:
    """False where sizes or sketches rule a link out; the arguments broadcast against each other."""
    most = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    full = ((x == 255) & (y == 255)).any(axis=-1)
    most = np.where(full, np.minimum(xn, yn), most)
    return den * most >= num * (xn.astype(np.int64) + yn - most)


def _prune(num: int, den: int):
    """(a, b, an, bn, sketch of a, sketch of b) -> the pairs that sketches don't rule out."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                an, bn = part.column(2).to_numpy(), part.column(3).to_numpy()
                keep = pa.array(_may_link(_bytes_matrix(part.column(4)), _bytes_matrix(part.column(5)), an, bn, num, den))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return run, "a long, b long"


def _prune_finely(num: int, den: int):
    """The same over fine sketches: the larger one is folded to the size of the other."""

    def run(batches):
        for batch in batches:
            an, bn = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (4, 5))
                if (x == 255).any() or (y == 255).any():
                    keep[i] = True
                    continue
                size = min(len(x), len(y))
                x, y = (s.reshape(size, -1).sum(axis=1, dtype=np.int64) for s in (x, y))
                most = int(np.minimum(x, y).sum())
                keep[i] = den * most >= num * (int(an[i]) + int(bn[i]) - most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run, "a long, b long"


def _verify(num: int, den: int):
    """(a, b, tokens of a, tokens of b) -> the pairs with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run, "a long, b long"


def _within_blocks(num: int, den: int):
    """Rows (g, band, block, salt, probe, node, c, n, sketch), sorted by the first five with probes last -> pairs of a
    probe and another row of its block, of different components, that sketches don't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(part: pa.Table):
            probe = part.column("probe").to_numpy()
            node, c, n = (part.column(x).to_numpy() for x in ("node", "c", "n"))
            sketch = _bytes_matrix(part.column("sketch").combine_chunks())
            t = np.flatnonzero(~probe)
            out = []
            for i in np.flatnonzero(probe):
                for lo in range(0, len(t), 2048):
                    at = t[lo : lo + 2048]
                    ok = (c[at] != c[i]) & (num * np.maximum(n[at], n[i]).astype(np.int64) <= den * np.minimum(n[at], n[i]).astype(np.int64))
                    at = at[ok]
                    at = at[_may_link(sketch[at], sketch[i], n[at], n[i], num, den)]
                    out.append(np.stack([np.minimum(node[at], node[i]), np.maximum(node[at], node[i])], 1))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, x])) for x in (0, 1)], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and (keys[0] != last).any():
                yield solve(pa.Table.from_batches(held))
                held = []
            last = keys[-1]
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield solve(pa.Table.from_batches(held))
                    held = []
        if held:
            yield solve(pa.Table.from_batches(held))

    return run, "a long, b long"


def frequent_tokens(profile: DataFrame, frequent: int, very_frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of at least ``frequent`` documents, their class and count, at most BROADCAST_ROWS of them: beyond
    that the bound doubles. Counts are summaries (a task passes on what it saw twice); they cover all rows."""
    counts = materialize(profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent), "tokens")
    try:
        by = dict(counts.groupBy(F.floor(F.log2(F.col("n") / frequent)).cast("int").alias("b")).count().collect())
        low = 0
        while sum(v for b, v in by.items() if b >= low) > BROADCAST_ROWS:
            low += 1
        rows = counts.where(F.col("n") >= frequent * (1 << low)).toArrow()
    finally:
        release(counts)
    tokens, n = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.where(n[order] >= very_frequent, 3, 2).astype(np.int8), n[order].astype(np.int64)


def _fetch_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, k: int, whole: bool, names: Names) -> DataFrame:
    """The sets of the nodes, or their sketches: about one text a node is read again, and none is shuffled."""
    wanted = materialize(nodes.join(reps, "node").select("rep.h", "rep.id"), "wanted")
    maps = maps_for(wanted.count(), BITS_A_TEXT, MOST_MAPS)
    bits = materialize(bitmap(wanted.select(place(maps, "h", "id").alias("at"))), "bits")
    texts = docs.select("text", place(maps, F.xxhash64("text").alias("h"), "id").alias("at")).where("text is not null")
    run, schema = _sets(k, whole, names)
    sets = materialize(map_batches(marked(texts, F.col("at"), bits).where("__hit").select("text"), run, schema), "sets")
    release(wanted)
    # copies that different tasks have read: of their nodes alone one set each is sought
    again = materialize(sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    if again.isEmpty():
        return sets
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    once = sets.join(again, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in sets.columns if c != "node"))
    out = materialize(sets.join(again, "node", "left_anti").unionByName(once), "sets")
    release(sets)
    return out


def _with_sets(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """The pairs with columns of both nodes' sets."""
    of = {x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in cols)) for x in "ab"}
    return pairs.join(of["b"], "b").join(of["a"], "a").select("a", "b", *(f"{x}_{c}" for c in cols for x in "ab"))


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int, names: Names) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _fetch_sets(nodes, reps, docs, k, True, names)
    run, schema = _verify(num, den)
    links = materialize(map_batches(_with_sets(pairs, sets, "tokens"), run, schema), "links")
    release(sets)
    return links


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: tuple[int, int] = (80, 100),
    frequent: int = 32,
    very_frequent: int = 1024,
    list_rows: int = LIST_ROWS,
    node_bits: int = 64,
) -> DataFrame:
    """Components of the documents whose k-word shingle sets have a Jaccard similarity of num/den or more.

    -> (id_col, n_shingles, component_id), one row per input row. component_id is the smallest id reachable
    by links, the row's own included. frequent, very_frequent, list_rows and node_bits steer the cost alone.

    Defined cases: a text that is null, empty or without words has an empty set, links with nothing and is
    its own component; equal sets always link, so repeated rows share a component; a null id keeps its row,
    links like any other and gets the smallest id that is not null of its component (null if there is none);
    other columns, whatever their names, are not read; an empty table gives an empty result. Texts are read
    whole.
    """
    num, den = threshold
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession

    run, schema = _profile(k, node_bits)
    profile = materialize(map_batches(src.select("id", F.xxhash64("text").alias("h"), "text"), run, schema), "profile")
    ids, names = _named(profile.where("kind = 0").select("id", "h", F.col("key").alias("node"), "n", "check"), node_bits)
    often = frequent_tokens(profile, frequent, very_frequent)

    run, schema = _index(spark.sparkContext.broadcast(often), k, num, den, names, list_rows)
    sigs = map_batches(src.select("text").where("text is not null"), run, schema)
    one = Window.partitionBy("sig", "salt")
    w = one.orderBy("n", "node")
    fits = F.expr(f"salt >= 0 or {den}L * before >= {num}L * n or {den}L * n >= {num}L * after")

    def partnered(rows: DataFrame) -> DataFrame:
        """Members with another of suitable size in their list: one next to them in order of size."""
        rows = rows.select("*", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
        return rows.where(fits).select("sig", "salt", "node", "n")

    members = partnered(partnered(sigs).distinct()).select("*", F.count("*").over(one).alias("m"), F.bit_xor(F.xxhash64("node")).over(one).alias("x"))
    lists = materialize(members.select(F.when(F.col("salt") < 0, F.xxhash64("m", "x")).otherwise(F.col("sig")).alias("sig"), "salt", "node", "n").distinct(), "lists")
    reps = materialize(ids.where("n > 0").groupBy("node").agg(F.min(F.struct("h", "id")).alias("rep")), "reps")
    sketches = _fetch_sets(lists.select("node").distinct(), reps, src, k, False, names)

    components, tried = None, None
    for turn in range(ROUNDS + 1):
        at = _open_members(lists, components)
        if at.isEmpty():
            break
        if turn < ROUNDS:
            pairs = _some_pairs(at, turn).where(f"{den}L * least(a_n, b_n) >= {num}L * greatest(a_n, b_n)").select("a", "b").distinct()
            run, schema = _prune(num, den)
            pairs = map_batches(_with_sets(pairs, sketches, "n", "sketch"), run, schema)
        else:
            pairs = _block_pairs(at, sketches, num, den).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "rough")
        pairs = _finely(pairs, sketches, num, den)
        tried = tried.unionAll(pairs) if tried else pairs
        release(at)
        if pairs.isEmpty():
            continue
        found = _linked(pairs, reps, src, k, num, den, names)
        # a component's members are linked already: one edge from each to its least node stands for them
        components = connected_components(found.unionAll(components.select(F.col("node").alias("a"), F.col("component").alias("b"))) if components else found)
        release(found)
    for df in (lists, sketches, reps):
        release(df)
    if components is None:
        components = spark.createDataFrame([], "node long, component long")

    nodes = ids.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    nodes = nodes.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = nodes.join(least, "component").select(F.col("node").alias("of"), "component_id")
    out = ids.join(of_node, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _finely(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that fine sketches don't rule out either, where both sets are large enough to have them."""
    large = sketches.where("fine is not null").select("node", "n", "fine")
    nodes = large.select("node")
    both = pairs.join(nodes.toDF("a"), "a", "left_semi").join(nodes.toDF("b"), "b", "left_semi").select("a", "b")
    run, schema = _prune_finely(num, den)
    kept = map_batches(_with_sets(both, large, "n", "fine"), run, schema)
    out = materialize(pairs.join(both, ["a", "b"], "left_anti").unionAll(kept), "pairs")
    release(pairs)
    return out


def _open_members(lists: DataFrame, components: DataFrame | None) -> DataFrame:
    """The rows (sig, salt, node, n, c) of the lists with several components. c: the component as yet."""
    if components is None:
        return lists.withColumn("c", F.col("node"))  # not a table of its own: nothing to release
    at = lists.join(components, "node", "left").select("sig", "salt", "node", "n", F.coalesce("component", "node").alias("c"))
    several = at.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"))
    several = several.where("lo <> hi and m > 2").select("sig")  # two members of a list have been compared with each other
    return materialize(at.join(several, "sig", "left_semi"), "open")


def _some_pairs(at: DataFrame, turn: int) -> DataFrame:
    """Each member of a list, or of a part of one, with one hub and with its neighbour in an order that a hash of the
    node gives, so that lists with about the same members agree on hubs; of different components only. After the
    first turn, lists in parts also have their components' least nodes compared so, over all parts."""

    def star(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col("node"), F.col("sig") % 4, F.lit(turn)))
        member = F.struct("node", "n", "c")
        rows = rows.select("node", "n", "c", F.first(member).over(w).alias("hub"), F.lag(member).over(w).alias("prev"))
        return rows.select("node", "n", "c", F.explode(F.array("hub", "prev")).alias("o")).where("o.c <> c")

    pairs = star(at, "sig", "salt")
    if turn:
        heads = at.where("salt >= 0").groupBy("sig", "c").agg(F.min(F.struct("node", "n")).alias("head"))
        pairs = pairs.unionAll(star(heads.select("sig", "head.node", "head.n", "c"), "sig"))
    x, y = F.struct("node", "n"), F.struct("o.node", "o.n")
    lo, hi = F.least(x, y), F.greatest(x, y)
    return pairs.select(lo["node"].alias("a"), hi["node"].alias("b"), lo["n"].alias("a_n"), hi["n"].alias("b_n"))


def _block_pairs(at: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Every pair of different components within a list that sizes and sketches don't rule out.

    A list's members outside its largest component are probes against all of it. Lists of one largest
    component are taken together, which drops the repetitions of a node. Where these are more than a block, they are
    parted by bands of size: a probe's links reach into its own and the next ones. What has no probe near it goes;
    the rest is cut into blocks of probes and of targets, so that a task holds a bounded number of sketches whatever
    the component's size.
    """
    def held(df: DataFrame) -> DataFrame:
        """A table by component: broadcast if it may be, or a component's rows would meet."""
        df = materialize(df, "counts")
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    sizes = at.groupBy("sig", "c").agg(F.count("*").alias("m"))
    major = sizes.groupBy("sig").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("g"))
    rows = at.join(major, "sig").select("g", "node", "c").distinct()
    # partners' sizes differ by den / num at most; a little more, so that no rounding parts them by two classes
    band = F.floor(F.log(F.col("n")) / float(np.log(1.01 * den / num)))
    rows = materialize(rows.join(sketches.drop("fine"), "node").withColumn("probe", F.expr("c <> g")), "members")
    large = held(rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS))
    rows = rows.join(large, "g", "left").withColumn("band", F.when(F.col("m").isNotNull(), band))
    reach = F.explode(F.when(F.col("m").isNotNull(), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0).cast("long")))).alias("band")
    own = F.coalesce("band", F.lit(0).cast("long")).alias("band")
    met = rows.select("g", own, F.lit(0).alias("p"), F.lit(1).alias("t")).unionAll(rows.where("probe").select("g", reach, F.lit(1), F.lit(0)))
    counts = met.groupBy("g", "band").agg(F.ceil(F.sum("p") / BLOCK_PROBES).alias("blocks"), F.ceil(F.sum("t") / BLOCK_ROWS).alias("salts"))
    counts = held(counts.where("blocks > 0 and salts > 0"))
    x = F.xxhash64("node")
    probes = rows.where("probe").select("g", "node", "c", "n", "sketch", "probe", reach).join(counts, ["g", "band"])
    probes = probes.select("*", F.pmod(x, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    targets = rows.select("g", "node", "c", "n", "sketch", F.lit(False).alias("probe"), own).join(counts, ["g", "band"])
    targets = targets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(x, "salts").alias("salt"))
    both = probes.unionByName(targets).select("g", "band", "block", "salt", "probe", "node", "c", "n", "sketch")
    run, schema = _within_blocks(num, den)
    return map_batches(both.repartition("g", "band", "block", "salt").sortWithinPartitions("g", "band", "block", "salt", "probe"), run, schema)
