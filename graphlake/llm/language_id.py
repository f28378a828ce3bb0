"""Language ID: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._ngrams import LETTERS, drawn, held_out, ngram_buckets
from graphlake.llm._scratch import materialize
from graphlake.llm._text import string_slices

SIZES, BITS, DIM = (2, 3, 4), 16, 16
#: The bound of the training sample: rows a language, and in all. Every language is learned until there are more
#: languages than rows in all; then as many of them, by hash.
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 400, 100_000
#: Characters of text that are collected for training at most, over all languages.
MAX_CHARS = 40_000_000
#: Of right answers on the calibration rows, the share that rejection may lose; and its highest threshold.
LOST, HIGHEST = 0.001, 0.5
#: Rows scored for calibration beside the sample, about: a language, and in all.
CALIBRATION_ROWS, CALIBRATION_TOTAL = 5_000, 100_000
#: The right answers that a language's own floor takes at least; how many must lie beyond a quantile that is read
#: off; and how many of the lowest one is extrapolated from.
LEAST_RIGHT, RESOLVED, TAIL = 20, 3, 20
#: The share of a language's texts that an n-gram which none has counts for.
UNSEEN = 1e-4


@dataclass
class LanguageModel:
    """A text's logits are the mean of its n-grams' embeddings times the softmax weights. Where there are fewer
    languages than dimensions, the embeddings are kept as that product."""

    languages: list[str]
    rows: np.ndarray  # by bucket: embeddings, or their products with the weights
    weights: np.ndarray | None  # dimensions x languages, or None where the rows have them in
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray  # by bucket: the log of the largest share of a language's texts that have it
    floors: np.ndarray  # by language: the least typicality, -inf where too few answers were right
    right: np.ndarray  # language, score and typicality of the right answers on the fifth

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text of the slice the logits, and its typicality: the mean of ``seen``; n-grams don't cross texts."""
        columns = [*self.rows.T, self.seen]
        total, count = np.zeros((len(offsets) - 1, len(columns))), np.zeros(len(offsets) - 1)
        for n, buckets in zip(SIZES, ngram_buckets(data, LETTERS, SIZES, BITS)):
            lo = offsets[:-1]
            hi = np.maximum(offsets[1:] - (n - 1), lo)
            lo, hi = np.minimum(lo, len(buckets)), np.minimum(hi, len(buckets))
            count += hi - lo
            for c, column in enumerate(columns):
                sums = np.concatenate([[0.0], np.cumsum(column[buckets], dtype=np.float64)])
                total[:, c] += sums[hi] - sums[lo]
        mean = total / np.maximum(count, 1)[:, None]
        return self.logits(mean[:, :-1]), mean[:, -1]

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)

    def calibrate(self, right: np.ndarray) -> None:
        """Set threshold and floors. right: language, score and typicality of right answers outside the fit."""
        self.threshold = min(HIGHEST, low_quantile(right[:, 1], LOST)) if len(right) else 0.0
        by = [right[right[:, 0] == c, 2] for c in range(len(self.languages))]
        self.floors = np.array([low_quantile(x, LOST) if len(x) >= LEAST_RIGHT else -np.inf for x in by])


def low_quantile(x: np.ndarray, share: float) -> float:
    """The value that ``share`` of the rows lie below. Where fewer than RESOLVED do, the lowest TAIL rows, a tenth at
    most, are taken for an exponential tail and their median for that tail's, so that no single row sets the value."""
    x = np.sort(x)
    if share * len(x) >= RESOLVED:
        return float(x[int(share * len(x))])
    n = min(TAIL, len(x) // 10)
    top = float(x[n])
    return top - float(np.median(top - x[: n + 1])) / np.log(2) * np.log(max(1.0, (n or 1) / len(x) / share))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], *, epochs: int = 4, rate: float = 0.5, seed: int = 0) -> LanguageModel:
    """Fit on the rows given; a fifth of them serve for temperature and rejection only."""
    names = sorted(set(languages))
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in languages])
    docs = []
    for t in texts:
        x = np.concatenate(ngram_buckets(np.frombuffer(t.encode("utf-8", "ignore"), np.uint8), LETTERS, SIZES, BITS))
        ids, n = np.unique(x, return_counts=True)
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    check, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = (rng.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, share = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            rows = emb[ids]
            h = share @ rows
            g = _softmax((h @ out + bias)[None])[0]
            g[y[i]] -= 1
            back = out @ g
            out -= step * np.outer(h, g)
            bias -= step * 0.1 * g
            # the mean's gradient goes to each n-gram in its share, scaled up as fastText's sums are
            emb[ids] = rows - (step * np.minimum(share * 50, 1))[:, None] * back[None]
    seen = np.full(1 << BITS, UNSEEN)
    for c in range(len(names)):
        own, n = fit[y[fit] == c], np.zeros(1 << BITS)
        for i in own:
            n[docs[i][0]] += 1
        seen = np.maximum(seen, n / max(1, len(own)))
    few = len(names) <= DIM
    model = LanguageModel(names, (emb @ out).astype(np.float32) if few else emb, None if few else out, bias, 1.0, 0.0, np.log(seen).astype(np.float32), np.full(len(names), -np.inf), np.zeros((0, 3)))
    if len(check):
        logits = model.logits(np.array([share @ model.rows[ids] for ids, share in (docs[i] for i in check)]))
        scale = np.geomspace(0.05, 5, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in scale]
        model.temperature = float(scale[int(np.argmin(loss))])
        p = model.probabilities(logits)
        typical = np.array([share @ model.seen[ids] for ids, share in (docs[i] for i in check)])
        best = p.argmax(axis=1)
        model.right = np.stack([best, p.max(axis=1), typical], 1)[best == y[check]]
        model.calibrate(model.right)
    return model


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Learn from a bounded sample of rows with a language that aren't held out; None where there are none.

    Defined cases: rows without id, text or language are not learned from; rows of one id and language count once,
    by the least of their texts; languages of any number are learned (SAMPLE_ROWS bounds the rows); other columns,
    whatever their names, are not read; an empty table gives None.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).withColumn("of", F.xxhash64("lang"))
    counts = materialize(known.groupBy("of").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "languages")
    languages, total, chars = counts.agg(F.count("*"), F.sum("n"), F.sum("chars")).first()
    if not languages:
        return None
    if languages > SAMPLE_ROWS:
        counts = counts.where(drawn(F.col("of"), F.lit(SAMPLE_ROWS / languages)))
    each = max(1, min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // languages, max(20, int(MAX_CHARS / max(1.0, chars / total) / languages))))
    aside_each = min(CALIBRATION_ROWS, CALIBRATION_TOTAL // languages)
    # hashes and counts of SAMPLE_ROWS languages at most
    known = known.join(F.broadcast(counts.select("of", "n")), "of")
    rate, more = F.lit(1.5 * each) / F.col("n"), F.lit(float(aside_each)) / F.col("n")
    rows = known.where(drawn(F.col("id"), rate)).groupBy("id", "lang").agg(F.min("text").alias("text"))
    rows = rows.select("text", "lang", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()
    taken: dict[str, int] = {}
    texts, langs = [], []
    for text, lang, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if taken.get(lang, 0) < each:
            taken[lang] = taken.get(lang, 0) + 1
            texts.append(text)
            langs.append(lang)
    if not texts:
        return None
    model = train(texts, langs)
    # the fifth is too small for the quantile: rows next to the sample are scored where they lie
    aside = known.where(drawn(F.col("id"), rate + more) & ~drawn(F.col("id"), rate))
    aside = aside.select(F.xxhash64(F.col("id").cast("string"), "of").alias("row"), "lang", F.col("text").rlike("\\p{L}").alias("lettered"), "text")
    scored = map_batches(aside, _calibrator(docs.sparkSession.sparkContext.broadcast(model)), "row long, best long, score double, typical double")
    scored = scored.groupBy("row").agg(F.min(F.struct("best", "score", "typical")).alias("r")).select("r.*").toArrow()
    model.calibrate(np.concatenate([model.right, np.stack([c.to_numpy().astype(np.float64) for c in scored.columns], 1)]))
    return model


def _calibrator(model_b):
    """(row, language, whether there is a letter, text) -> the right answers' row, language, score and typicality."""

    def run(batches):
        model = model_b.value
        names = np.array(model.languages, object)
        for batch in batches:
            lang, lettered = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for lo, hi, data, offsets in string_slices(batch.column(3)):
                logits, typical = model.measure(data, offsets)
                p = model.probabilities(logits)
                best = p.argmax(axis=1)
                ok = (names[best] == lang[lo:hi]) & lettered[lo:hi].astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(ok)), pa.array(best[ok]), pa.array(p.max(axis=1)[ok]), pa.array(typical[ok])], names=["row", "best", "score", "typical"])

    return run


def _predictor(model_b):
    def run(batches):
        model = model_b.value
        for batch in batches:
            lettered = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            best, score, typical = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in string_slices(batch.column(2)):
                logits, typical[lo:hi] = model.measure(data, offsets)
                p = model.probabilities(logits)
                best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            score[~lettered] = 0.0
            lang = np.array(model.languages, object)[best]
            lang[~lettered] = "und"
            rejected = ~lettered | (score < model.threshold) | (typical < model.floors[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, held_out, lang_pred, score, rejected), one row per document, from its whole text alone.

    rejected: the text has no letter, the calibrated score is below the model's threshold, or the n-grams are
    less typical of learned texts than all but LOST of the right answers for that language. A language with
    fewer than LEAST_RIGHT right answers outside the fit has no such floor.

    Defined cases: a text that is null, empty or without a letter is ``und`` with score 0, rejected; without
    a model (no row to learn from) every text is; a null id keeps its row and counts as held out; repeated
    rows get equal answers; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("lettered"), F.col(text_col).alias("text"))
    if model is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    else:
        out = map_batches(rows, _predictor(docs.sparkSession.sparkContext.broadcast(model)), "id long, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")
