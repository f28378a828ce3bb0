"""Quality classifier: naive Bayes support vectors. Indicators of hashed n-grams, scaled by the classes'
log-count ratios, and a linear hinge-loss model by dual coordinate descent; margins become probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._arrow import map_batches
from graphlake.llm._ngrams import SURFACE, drawn, held_out, ngram_buckets
from graphlake.llm._text import sorted_distinct, string_slices

SIZES, BITS = (1, 2, 3, 4), 18
#: The bound of the training sample: rows a class, and characters in all.
ROWS_PER_CLASS, MAX_CHARS = 1500, 40_000_000


@dataclass
class QualityModel:
    weights: np.ndarray  # by bucket, the log-count ratio included
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def indicators(data: np.ndarray, offsets: np.ndarray):
    """By text of a slice: the distinct buckets of its n-grams."""
    grams = ngram_buckets(data, SURFACE, SIZES, BITS)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield sorted_distinct(np.concatenate([g[lo : max(lo, hi - n + 1)] for n, g in zip(SIZES, grams)]))


def hinge_by_dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: np.ndarray, *, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of c * max(0, 1 - y w.x), one dual variable at a time."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(width), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            ids, v = rows[i]
            gradient = y[i] * float(v @ w[ids]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w[ids] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _sigmoid_fit(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with a small ridge."""
    x = np.stack([m, np.ones_like(m)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def train(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0), *, cost: float = 1.0, folds: int = 4, seed: int = 0) -> QualityModel:
    """Fit on labelled texts (0 or 1). shares: how many rows of the corpus a sampled row of each class stands
    for. Margins for the curve are those of rows outside the fit, by ``folds``."""
    y = np.array(labels)
    docs = []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "ignore"), np.uint8)
        docs.append(next(iter(indicators(data, np.array([0, len(data)])))))

    def fit(rows: np.ndarray) -> tuple[np.ndarray, float]:
        counts = []
        for cls in (1, 0):
            p = np.ones(1 << BITS)
            for i in rows[y[rows] == cls]:
                p[docs[i]] += 1
            counts.append(p / p.sum())
        ratio = np.log(counts[0] / counts[1])
        width = (1 << BITS) + 1
        scaled = []
        for i in rows:
            ids = np.append(docs[i], width - 1)
            v = np.append(ratio[docs[i]], 1.0) / np.sqrt(max(1, len(docs[i])))
            scaled.append((ids, v))
        sign = np.where(y[rows] == 1, 1.0, -1.0)
        half = np.array([(sign == s).sum() for s in (1.0, -1.0)])
        c = cost * np.where(sign == 1.0, len(rows) / max(1, 2 * half[0]), len(rows) / max(1, 2 * half[1]))
        w = hinge_by_dual_descent(scaled, sign, width, c, seed=seed)
        return (w[:-1] * ratio).astype(np.float32), float(w[-1])

    def margin(model: tuple[np.ndarray, float], i: int) -> float:
        return (float(model[0][docs[i]].sum()) + model[1]) / np.sqrt(max(1, len(docs[i])))

    order = np.random.default_rng(seed).permutation(len(docs))
    outside = np.zeros(len(docs))
    for f in range(folds):
        test = order[f::folds]
        model = fit(np.setdiff1d(order, test))
        outside[test] = [margin(model, i) for i in test]
    slope, shift = _sigmoid_fit(outside, y, np.where(y == 1, shares[1], shares[0]) / max(shares))
    weights, bias = fit(np.sort(order))
    return QualityModel(weights, bias, slope, shift)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Learn from a bounded, balanced sample of labelled rows that aren't held out; None without both classes.

    Defined cases: labels other than 0 and 1 and labels without an id are ignored; a document labelled both ways
    isn't learned from, one labelled twice alike counts once; labels without a document, and documents whose text
    is null, are not learned from; of several texts of one id the least counts; other columns, whatever their
    names, are not read; empty tables give None.
    """
    marks = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("of")))
    marks = marks.groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    total = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if len(total) < 2:
        return None
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    mean = texts.agg(F.avg(F.length("text"))).first()[0] or 1.0
    each = max(50, min(ROWS_PER_CLASS, int(MAX_CHARS / mean / 2)))
    rate = F.when(F.col("label") == 1, F.lit(1.5 * each / total[1])).otherwise(F.lit(1.5 * each / total[0]))
    chosen = marks.where(drawn(F.col("of"), rate))
    # one text an id, however often its row is repeated
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("of")).groupBy("of", "label").agg(F.min("text").alias("text"))
    rows = rows.select("text", "label", F.xxhash64(F.col("of").cast("string")).alias("h")).collect()
    texts, ys, taken = [], [], {0: 0, 1: 0}
    for text, label, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if taken[label] < each:
            taken[label] += 1
            texts.append(text)
            ys.append(label)
    if not all(taken.values()):
        return None
    return train(texts, ys, (total[0] / taken[0], total[1] / taken[1]))


def _scorer(model_b):
    def run(batches):
        model = model_b.value
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            row = 0
            for _, _, data, offsets in string_slices(batch.column(1)):
                for ids in indicators(data, offsets):
                    margins[row] = (float(model.weights[ids].sum()) + model.bias) / np.sqrt(max(1, len(ids)))
                    row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(margins))], names=["id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """-> (id_col, held_out, score, predicted), one row per document, from its whole text alone.

    Defined cases: a null text is an empty one, which is scored by the bias; without a model (one class or
    none to learn from) the score is 0.5; a null id keeps its row and counts as held out; repeated rows get
    equal scores; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.select("id", F.lit(0.5).alias("score")) if model is None else map_batches(rows, _scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
