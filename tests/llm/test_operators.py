"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is on for with as by at from this that are was were be an or it not have has had but they you we his her she him our".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def corpus(seed=5, groups=12):
    """Random texts, exact and near copies, a passage that many share, edge cases."""
    rng = random.Random(seed)
    rows, i = [], 0
    passage = text(rng, 60)

    def put(t):
        nonlocal i
        rows.append((i, t))
        i += 1

    for _ in range(groups):
        base = text(rng, rng.choice([3, 7, 30, 120, 300])).split()
        put(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "x" + str(rng.randint(0, 9))
            put(rng.choice([" ", "\n", "  "]).join(copy))
    for _ in range(40):
        put(passage + " " + text(rng, rng.randint(0, 40)))
    for t in (None, "", " \n ", "one", "ONE", "one", "a b c d", "A b\tc d", "é ß 日本", "a b c d e", "a b c d e f", "a b c d e f g"):
        put(t)
    return rows


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("frequent", "very_frequent"), [(32, 1024), (2, 4), (2, 10_000)])
def test_jaccard_join(spark, frequent, very_frequent):
    from graphlake.llm.jaccard_join import near_duplicates

    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), frequent=frequent, very_frequent=very_frequent).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("list_rows", "node_bits"), [(4, 64), (200_000, 4), (8, 5)])
def test_jaccard_join_of_long_lists_and_shared_names(spark, monkeypatch, list_rows, node_bits):
    """Lists dealt over tasks, small blocks and bands of size, and sets whose fingerprints are equal though they aren't."""
    from graphlake.llm import jaccard_join as J
    from graphlake.llm.jaccard_join import near_duplicates

    monkeypatch.setattr(J, "BLOCK_PROBES", 3)
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    rows = corpus(seed=8) + [(3000 + i, t) for i, t in corpus(seed=9, groups=3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows).repartition(3), frequent=2, very_frequent=6, list_rows=list_rows, node_bits=node_bits).collect()}
    assert got == brute_components(rows)


def test_fine_sketches_rule_out_no_link():
    from graphlake.llm import jaccard_join as J

    rng = np.random.default_rng(4)
    run = J._prune_finely(80, 100)[0]
    import pyarrow as pa

    for n, far in ((1100, 0.82), (6000, 0.8), (6000, 0.4)):
        both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        lone = int(len(both) * (1 / far - 1) / 2)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, lone).astype(np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
        row = [[1], [2], [len(x)], [len(y)], [J._fine_sketch(x)], [J._fine_sketch(y)]]
        kept = sum(b.num_rows for b in run([pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=list("abcdef"))]))
        assert kept == (far >= 0.8)


def test_signatures_are_complete():
    """Any two sets of similarity 0.8 share a signature, whichever tokens are frequent."""
    from graphlake.llm.jaccard_join import signatures

    rng = np.random.default_rng(3)
    classes = {}
    for _ in range(1500):
        n = int(rng.integers(4, 90))
        common = rng.integers(0, 1 << 62, n, np.int64).astype(np.uint64)
        extra = int(n / 0.8) - n
        cut = int(rng.integers(0, extra + 1))
        x = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, cut, np.int64).astype(np.uint64)]))
        y = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, extra - cut, np.int64).astype(np.uint64)]))
        if 100 * n < 80 * (len(x) + len(y) - n):
            continue
        share = rng.random(3)
        for t in np.union1d(x, y).tolist():
            classes[t] = int(rng.choice([1, 2, 3], p=share / share.sum()))
        sx, sy = (signatures(s, np.array([classes[t] for t in s.tolist()], np.int8), 80, 100) for s in (x, y))
        assert len(np.intersect1d(sx, sy)), (n, cut)


def test_components_of_a_chain_and_a_star(spark):
    from graphlake.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def check_shards(rows, got, shards):
    """Whole groups of equal texts, near-equal bytes, gapless slots; every row once."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    texts, slots, load = defaultdict(list), defaultdict(list), [0] * shards
    for i, t in rows:
        texts[zlib.crc32((t or "").encode()), size(t)].append(t or "")
    assert all(len(set(g)) == 1 for g in texts.values())  # the checksums tell the texts of these tests apart
    of = defaultdict(set)
    for r in got:
        of[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    share = sum(load) / shards
    whole = [len(g) * k[1] for k, g in texts.items() if len(g) * k[1] <= share]
    for k, g in texts.items():
        if len(g) * k[1] <= share:
            assert len(of[k]) == 1
        elif len(g) > 1:
            assert len(of[k]) <= -(-len(g) * k[1] // int(share)) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, share, max(whole, default=0)


def test_sharding(spark):
    from graphlake.llm.sharding import LARGE, assign_shards

    rng = random.Random(2)
    rows = corpus(groups=60) + [(10_000 + i, "the same text") for i in range(900)] + [(20_000 + i, text(rng, 20)) for i in range(900)]
    got = assign_shards(frame(spark, rows).repartition(3), 24).collect()
    load, share, _ = check_shards(rows, got, 24)
    assert max(load) - min(load) <= 2 * share / LARGE + 8 * 130
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)


def test_sharding_of_hot_rows(spark, monkeypatch):
    """A third of all rows are one row repeated, groups of every size; ranges bounded by rows."""
    from graphlake.llm import sharding

    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rng = random.Random(3)
    rows = [(7, "hot row " * 3)] * 1500 + [(None, None)] * 300 + [(i, text(rng, 1 + i % 40)) for i in range(2000)]
    rows += [(5000 + g * 100 + i, "group %d " % g * 9) for g in range(30) for i in range(rng.randint(2, 60))] + [(9000, "long " * 20_000), (9001, "long " * 20_000)]
    load, share, _ = check_shards(rows, sharding.assign_shards(frame(spark, rows).repartition(5), 6).collect(), 6)
    assert max(load) - min(load) <= 100_008  # one of the two long rows
    assert len(sharding.assign_shards(frame(spark, rows[:1]), 6).collect()) == 1


def test_shares_of_a_line():
    """The dealt groups and the line fill the shards to one level."""
    from graphlake.llm.sharding import deal

    pieces, places = deal([("a", 450), ("b", 90), ("c", 60)], 1000, 5)
    load = [0] * 5
    for h, size in (("a", 450), ("b", 90), ("c", 60)):
        left = size
        for s in pieces[h]:
            load[s] += min(left, 200)
            left -= 200
    for lo, hi, s in zip([0, *places], [*places, 400], range(5)):
        load[s] += hi - lo
    assert len(pieces["a"]) == 3 and len(pieces["b"]) == 1 and all(abs(x - 200) <= 1 for x in load)
    assert deal([], 0, 3) == ({}, [0, 0])


def test_exact_dedup(spark):
    from graphlake.llm.exact_dedup import exact_duplicates

    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("maps", [1 << 14, 1])
def test_exact_dedup_refines(spark, monkeypatch, maps):
    """Rows that share length and prefix with none go without a whole hash; a crowded bitmap changes no result."""
    from graphlake.llm import exact_dedup

    written = {}
    exact_dedup_materialize = exact_dedup.materialize
    keep = lambda df, name: written.setdefault(name, exact_dedup_materialize(df, name))
    rng = random.Random(2)
    rows = corpus() + [(1000 + i, text(rng, 30) + "y" * i) for i in range(300)] + [(2000 + i, f"{i % 2000:05d}") for i in range(6000)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g)
    monkeypatch.setattr(exact_dedup, "materialize", keep)
    monkeypatch.setattr(exact_dedup, "MOST_MAPS", maps)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 2)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(frame(spark, rows)).collect())) == want
    whole = written["hashed"].where("__full is not null").count()
    assert sum(r[2] > 1 for r in want) <= whole <= len(rows) - 200


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_encoder(tokenizer_path, monkeypatch):
    from graphlake.llm import _bpe

    rng = random.Random(1)
    pool = [*"abAB  \n'''stmdrevl019!?*$éÇßİſ́\u0085\u200b日½²—😀Σσς", "'s", "'re", "'ll", " 's ", "don't", "<|endoftext|>"]
    cases = ["", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    encoder = _bpe.WordEncoder(tokenizer_path)
    monkeypatch.setattr(_bpe, "REMEMBERED", 900)  # so that it forgets in between
    got = [ids for lo in range(0, len(cases), 100) for ids in encoder.encode(cases[lo : lo + 100])]
    assert [g.tolist() for g in got] == [encoder.whole.encode(c, add_special_tokens=False).ids for c in cases]


def test_word_encoder_takes_every_letter(tokenizer_path):
    """Each code point that the tables hold, capitals whose lower case lies beyond them among these."""
    from graphlake.llm import _bpe

    encoder = _bpe.WordEncoder(tokenizer_path)
    cases = [f"a {chr(c)}b" for c in range(0x3000)]
    got = encoder.encode(cases)
    assert [g.tolist() for g in got] == [encoder.whole.encode(c, add_special_tokens=False).ids for c in cases]
    assert [g.tolist() for g in encoder.encode(["\u13a0 one", "ab\u13efC"])] == [encoder.whole.encode(c, add_special_tokens=False).ids for c in ("\u13a0 one", "ab\u13efC")]


def test_packing(spark, tokenizer_path):
    from tokenizers import Tokenizer

    from graphlake.llm.packing import pack_documents, pack_sizes

    rng = random.Random(4)
    rows = corpus() + [(5000, text(rng, 4000)), (5001, None)]
    whole = Tokenizer.from_file(tokenizer_path)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(frame(spark, rows).repartition(2), tokenizer_path, capacity=512).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i][at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    sizes = [rng.randint(1, 512) for _ in range(400)]
    groups = pack_sizes(sizes, 512)
    assert sorted(i for g in groups for i in g) == list(range(400)) and max(sum(sizes[i] for i in g) for g in groups) <= 512
    assert len(groups) * 512 < 1.06 * sum(sizes)


def brute_contamination(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[j : j + width])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination(spark, monkeypatch, blocks):
    from graphlake.llm import decontaminate as D

    rng = random.Random(8)
    items = [(i, text(rng, 25)) for i in range(12)] + [(50, "Solo phrase"), (51, None), (52, "--"), (53, text(rng, 10))]
    docs = [(i, text(rng, 200)) for i in range(40)]
    for d in range(0, 40, 3):
        w, item = docs[d][1].split(), rng.choice(items[:12])[1].split()
        at, lo = rng.randrange(200), rng.randrange(len(item) - 9)
        docs[d] = (d, " ".join(w[:at] + [x.upper() + "," for x in item[lo : lo + rng.randint(9, 25)]] + w[at:]))
    docs += [(100, items[0][1]), (101, items[53 - 38][1] + " " + items[0][1] + " é" + items[0][1]), (102, "a SOLO, phrase"), (103, None), (104, ""), (105, "solo"), (106, " ".join([items[1][1]] * 3))]
    monkeypatch.setattr(D, "SHARD", 300)
    items += [(60, text(rng, 90)), (61, items[0][1])]
    docs += [(200, " ".join(items[-2][1].split()[50:75])), (201, items[-2][1])]
    windows = {"block_windows": 40} if blocks > 1 else {}
    found = D.find_contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), **windows)
    got = {r.doc_id: r for r in found.withColumn("n_hit", D.words_hit(found.spans)).collect()}
    assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == brute_contamination(docs, items)
    clean = dict(found.join(frame(spark, docs), "doc_id").select("doc_id", D.remove_spans(F.col("text"), F.col("spans"))).collect())
    assert clean[102] == "a " and clean[103] is None and clean[105] == "solo"


def test_fm_index():
    from graphlake.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)
    for symbols in (2, 5, 40):
        text_ = rng.integers(1, symbols, 700)
        text_[rng.integers(0, 700, 30)] = 0
        text_[-1] = 0
        index = FMIndex(text_, symbols)
        for n in (1, 2, 4):
            phrase = rng.integers(1, symbols, n)
            lo, hi = index.search(phrase[None], np.array([n]))
            want = [i for i in range(700 - n) if (text_[i : i + n] == phrase).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_language_id(spark):
    from graphlake.llm.language_id import fit_languages, identify_languages

    rng = random.Random(3)
    sounds = {"aa": "ka to mi ra su", "bb": "sch ung ein ver zu", "cc": "eau oui tre que les"}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(rng.randint(4, 60))), lang) for i in range(400) for lang in [rng.choice(list(sounds))]]
    rows += [(1000, None, "aa"), (1001, "123 --", None), (1002, "", "bb"), (None, rows[0][1], None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs, fit_languages(docs)).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows[:400])
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held) and not any(got[i].rejected for i, *_ in held)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert got[None].lang_pred == rows[0][2] and all(0 <= r.score <= 1 for r in got.values())
    none = identify_languages(docs, fit_languages(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_rejection(spark):
    """Gibberish and an unlearned language are rejected, though one junk row is labelled; held-out texts stay."""
    from graphlake.llm.language_id import fit_languages, identify_languages, low_quantile

    rng = random.Random(5)
    sounds = {"aa": "ka to mi ra su", "bb": "sch ung ein ver zu", "cc": "eau oui tre que les", "xx": "pl ok nd wy gry"}
    some = lambda lang: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(rng.randint(4, 60)))
    rows = [(i, some(lang), lang) for i in range(2000) for lang in [rng.choice(["aa", "bb", "cc"])]]
    rows += [(3000 + i, "q", "aa") for i in range(6)]
    new = [(5000 + i, some("xx"), None) for i in range(100)] + [(6000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(200)), None) for i in range(100)]
    docs = frame(spark, rows + new, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs, fit_languages(docs)).collect()}
    held = [i for i, *_ in rows[:2000] if got[i].held_out]
    assert all(got[i].rejected for i, *_ in new) and sum(got[i].rejected for i in held) <= 0.01 * len(held)
    x = np.random.default_rng(1).normal(5, 1, 300)
    assert abs(low_quantile(x, 0.001) - low_quantile(np.append(x, -1000.0), 0.001)) < 0.5 and low_quantile(np.arange(10_000.0), 0.001) == 10


def test_quality(spark):
    from graphlake.llm.quality import fit_quality, score_quality

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.25
        t = text(rng, rng.randint(5, 60))
        rows.append((i, re.sub(" ", lambda m: rng.choice([" ", "!!! ", " $$ "]), t) if bad else t))
        labels.append((i, 0 if bad else 1, 0))
    docs, marks = frame(spark, rows + [(900, None), (901, "")]), frame(spark, labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, marks)).collect()}
    held = [(i, q) for i, q, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert fit_quality(docs, marks.where("quality = 1")) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {0.5}


def test_line_dedup(spark):
    from graphlake.llm.line_dedup import drop_boilerplate

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", "x" + str(rng.randint(0, 900)), ""]) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    rows += [(900, "a", None), (901, "a", ""), (902, "solo", "menu")]
    pages, seen = defaultdict(int), defaultdict(set)
    for i, s, t in rows:
        pages[s] += 1
        for line in (t or "").split("\n"):
            seen[s, line.strip(" ")].add(i)
    drop = lambda s, line: line.strip(" ") != "" and len(seen[s, line.strip(" ")]) >= 3 and len(seen[s, line.strip(" ")]) * 100 > 5 * pages[s]
    want = {i: (s, 0 if t is None else len(t.split("\n")), None if t is None else "\n".join(x for x in t.split("\n") if not drop(s, x))) for i, s, t in rows}
    got = drop_boilerplate(frame(spark, rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id: (r.site, r.n_lines, r.clean_text) for r in got} == want and sum(r.n_dropped for r in got) > 0


def test_url_filter(spark):
    from graphlake.llm.url_filter import filter_urls

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/a", "block"), ("example.com", "/de/", "block"), ("example.com", "/de/", "allow"), ("org", "", "block"), (None, "/", "block")]
    urls = ["http://a.example.net/en/x", "HTTP://A.Example.NET/en/ab?q", "https://net/", "https://net", "https://internet/x", "http://x.org#/en/", "http://x.org", "https://example.com/de/#f", "https://example.com/d", None, "", "example.net/en/", "ftp://example.net:80/en/", "a://b://c.net/"]

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    rows = list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])]
    got = filter_urls(frame(spark, rows, "page_id long, url string"), frame(spark, rules, "host string, path string, verdict string")).collect()
    key = lambda r: str(r)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(((i, u, *judge(u)) for i, u in rows), key=key)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    from graphlake.llm.warc import archive_pages

    htmls = ["<p>a</p>", "", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "filedesc://x 0.0.0.0 1 text/plain 3\nabc", "é\n\nß日本\r\n", "x" * 200_000]
    rng = random.Random(1)
    rows = [(i, rng.choice(["http://a/b c", None, "http://é/"]), rng.choice(htmls)) for i in range(60)] + [(1000, "u", "only me"), (None, "u", "no id"), (None, "u", "only me")]
    owner = defaultdict(lambda: -1)
    for i, _, h in rows:
        owner[h or ""] = max(owner[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        own = owner[h or ""]
        revisit = len((h or "").encode()) >= least and own >= 0 and own != i
        want.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", own if revisit else None))
    got = archive_pages(frame(spark, rows, "page_id long, url string, html string"), least_bytes=least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    ids = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to_record in ids for r in got if r.record_type == "revisit")


def test_arc_versions_and_errors():
    import gzip

    from graphlake.llm.warc import ARC_FIELDS, arc_header, arc_record, arc_records, opened, split_http, warc_date, warc_records

    for version in ARC_FIELDS:
        bodies = [("http://a", b"one\ntwo"), ("http://b", b""), ("http://c", bytes(range(256)))]
        whole = b"\n".join([arc_header(version, "n.arc"), *(arc_record(version, "n.arc", u, "text/html", b) for u, b in bodies)]) + b"\n"
        for data in (whole, gzip.compress(whole), b"".join(gzip.compress(whole[i : i + 50]) for i in range(0, len(whole), 50))):
            records = list(arc_records(data))
            assert [(f["URL"], b) for f, b in records[1:]] == bodies
        with pytest.raises((ValueError, EOFError)):
            list(arc_records(gzip.compress(whole)[:-20]))
    assert opened(b"").read() == b"" and split_http(b"HTTP/1.0 200\nA: b\n\nx\r\n\r\ny") == (b"HTTP/1.0 200\nA: b\n\n", b"x\r\n\r\ny") and split_http(b"HTTP/1.0") == (b"HTTP/1.0", b"")
    assert warc_date("20240102") == "2024-01-02T00:00:00Z" and warc_date("-") == "0000-01-01T00:00:00Z"
    for broken in (b"http://a 0 0 t 3\nabc", b"filedesc://x 0.0.0.0 1 text/plain 99\n1 0 x\n", b"filedesc://x 0 1 t 4\n9 0 \n", b"no end"):
        with pytest.raises(ValueError):
            list(arc_records(broken))
    for broken in (b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc_records(broken))


def test_legacy_arc_becomes_warc(spark, tmp_path):
    """Pages that aren't UTF-8, images, bare line ends, other protocols: bytes and digests survive."""
    import gzip

    from graphlake.llm.warc import arc_header, arc_record, convert_arc, read_arc, read_warc, warc_records

    latin, image = "<p>r\u00e9sum\u00e9 \u00df</p>".encode("latin-1"), bytes(range(256)) * 300
    payloads = {
        "http://a/latin": b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + latin,
        "http://b/image": b"HTTP/1.0 200 OK\nContent-Type: image/gif\n\n" + image,
        "http://c/again": b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\n" + latin,
        "dns:d": b"20240101\nd. 1 IN A 1.2.3.4\n",
        "http://e/headless": b"HTTP/1.0 204 No Content\r\n",
    }
    want = {"http://a/latin": latin, "http://b/image": image, "http://c/again": latin, "dns:d": payloads["dns:d"], "http://e/headless": b""}
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(b"\n".join([arc_header("1", "old.arc"), *(arc_record("1", "old.arc", u, "text/html", b) for u, b in payloads.items())]) + b"\n\n")
    (tmp_path / "arc" / "two.arc.gz").write_bytes(b"".join(gzip.compress(x + b"\n") for x in (arc_header("2", "two.arc"), arc_record("2", "two.arc", "http://f/", "image/png", payloads["http://b/image"]))))
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    convert_arc(spark, arc, warc)
    got = {r.uri: r for r in read_warc(spark, warc).collect()}
    want["http://f/"] = image
    digest_of = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert {u: (r.payload_bytes, r.payload_digest) for u, r in got.items()} == {u: (len(b), digest_of(b)) for u, b in want.items()}
    assert {u: r.record_type for u, r in got.items()} == {u: "revisit" if u == "http://a/latin" else "resource" if u == "dns:d" else "response" for u in want}
    assert got["http://a/latin"].refers_to == 5 and got["http://a/latin"].refers_to_record == got["http://c/again"].record_id
    assert {r.uri: bytes(r.payload) for r in read_arc(spark, arc).where("kind <> 'warcinfo'").collect()} == want
    files = [p.read_bytes() for p in (tmp_path / "warc").iterdir() if p.name.startswith("part") and p.stat().st_size]
    blocks = {f.get("warc-target-uri"): b for data in files for f, b in warc_records(data)}
    assert all(blocks[u] == payloads[u] for u in payloads if u != "http://a/latin")


def test_warc_files_are_bounded_and_members_their_records():
    """A file ends at its bytes; each record is one gzip member, also where a record is over 16 MB."""
    import zlib as z

    from graphlake.llm import warc

    rng = np.random.default_rng(3)
    records = [rng.bytes(9 << 20) for _ in range(8)] + [rng.bytes(17 << 20)] + [b"x"]
    files = [b.column(0)[0].as_py() + b"\0" for b in warc._files(iter(records))]
    assert len(files) >= 3 and all(len(f) < warc.FILE_BYTES + (18 << 20) for f in files)
    out = []
    for data in files:
        while data:
            d = z.decompressobj(31)
            out.append(d.decompress(data))
            assert d.eof
            data = d.unused_data
    assert [x for x in out if x] == records
