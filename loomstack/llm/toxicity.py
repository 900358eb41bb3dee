"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

An n-gram's ratio compares how many toxic and other labelled texts hold it. The SELECTED n-grams whose ratios
stand out most from their sampling error are features, present or absent, scaled by their ratio; logistic
regression fits their weights. Margins become probabilities by a slope and a level that fit texts left out of the
fit by turns, at the labels' own odds. Scoring looks up every n-gram of a whole text and counts each once.

The model is fitted on a bounded sample: of each label the PER_LABEL labelled ids of the least hashes, each with one
text, of at most TRAIN_CHARS characters; if a label has no text that short, its LONG shortest ones are learned from
whole.
Scoring takes a text longer than a step in parts.

Defined results: a null text is scored as an empty one; with no row of one of the labels to learn from, every
score is the share of label 1 among what was learned (0 if nothing was); repeated rows are scored each; repeated
labels count once; null ids and labels are not learned from; empty tables give no rows; only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.llm.common import STEP_BYTES, steps
from loomstack.llm.langid import drawn
from loomstack.llm.ngrams import by_parts, characters, hashed, row_sums

PER_LABEL, TRAIN_CHARS, LONG = 2000, 8_000, 50
ORDERS, BITS, SELECTED = (3, 4, 5, 6), 20, 1 << 14
THRESHOLD = 0.3
#: Least number of sampling errors by which a feature's ratio differs from zero.
CLEAR = 3.0
#: Least ratio, as a logarithm: what is about as common in both kinds of text says nothing.
STRONG = 1.0
#: Parts of the sample that are left out by turns to calibrate scores, and how firmly calibration stays near none.
FOLDS, NEAR = 3, 1e-3


def present(raw: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram that a row holds, each once, all but letters taken as spaces; only buckets where wanted, if given."""
    points, rows, letter = characters(raw, at)
    points = np.where(letter, points, np.uint32(32))
    found = []
    for n in ORDERS:
        h, _ = hashed(points, rows, n, BITS)
        if wanted is None:
            place = np.flatnonzero(h < 1 << BITS)
        else:
            place = np.flatnonzero(wanted[h])
        owner = np.searchsorted(rows, place, "right") - 1
        found.append(owner.astype(np.int64) << (BITS + 1) | h[place])
    pairs = np.unique(np.concatenate(found))
    return pairs >> (BITS + 1), pairs & ((1 << (BITS + 1)) - 1)


@dataclass
class Model:
    weights: np.ndarray  # float32 of every bucket and one more
    bias: float

    @staticmethod
    def fit(texts: list[str], labels: list[int], odds: float = 1.0, l2: float = 1e-5, rounds: int = 400) -> Model:
        """odds: of label 1 among all labels; the sample's own share of it does not matter."""
        y = np.array(labels, float) * 2 - 1
        weights = np.zeros((1 << BITS) + 1, np.float32)
        if not len(y) or abs(y.sum()) == len(y):
            share = (y > 0).mean() if len(y) else 0.0
            return Model(weights, 40.0 * share - 20 if share in (0, 1) else 0.0)
        data = "".join(texts).encode()
        at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
        row, bucket = [], []
        for low in range(0, len(texts), 64):
            high = min(low + 64, len(texts))
            r, b = present(np.frombuffer(data[at[low] : at[high]], np.uint8), at[low : high + 1] - at[low])
            row.append((r + low).astype(np.int32))
            bucket.append(b.astype(np.int32))
        row, bucket = np.concatenate(row), np.concatenate(bucket)
        own, shift = _fitted(row, bucket, y, l2, rounds)
        slope, level = _calibration(row, bucket, y, odds, l2, rounds)
        weights[: len(own)] = slope * own
        return Model(weights, float(slope * (shift + np.log(odds)) + level))

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        wanted = self.weights != 0
        if len(at) == 2 and len(raw) > STEP_BYTES:
            held = np.zeros(len(wanted), bool)
            for _, h, _ in by_parts(raw, ORDERS, BITS):
                held[h[wanted[h]]] = True
            z = np.array([self.weights[held].sum(dtype=np.float64)]) + self.bias
        else:
            row, bucket = present(raw, at, wanted)
            z = np.bincount(row, self.weights[bucket], len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fitted(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of buckets and the bias, at even odds, from rows of -1 and 1 that hold buckets; row ascends."""
    toxic = y[row] > 0
    p, q = (np.bincount(bucket[k], minlength=1 << BITS) for k in (toxic, ~toxic))
    ratio = np.log((p + 1) / ((y > 0).sum() + 2) * ((y < 0).sum() + 2) / (q + 1))
    clear = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1)) * (np.abs(ratio) >= STRONG)
    chosen = np.argsort(-clear, kind="stable")[:SELECTED]
    chosen = chosen[clear[chosen] >= CLEAR]
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[bucket] >= 0
    row, col = row[keep], column[bucket[keep]]
    value = ratio[chosen][col]
    at = np.searchsorted(row, np.arange(len(y) + 1))
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, b = np.zeros(len(chosen)), 0.0
    ahead, shift, t = w, b, 1.0
    top = (row_sums(value * value, at) * weight).sum()
    step = 1 / (0.25 * (top + 1) + l2)
    for _ in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (row_sums(value * ahead[col], at) + shift), -30, 30))) * weight
        new = ahead - step * (np.bincount(col, value * slope[row], len(w)) + l2 * ahead)
        level = shift - step * slope.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, shift = new + (last - 1) / t * (new - w), level + (last - 1) / t * (level - b)
        w, b = new, level
    weights = np.zeros(1 << BITS)
    weights[chosen] = w * ratio[chosen]
    return weights, b


def _calibration(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, odds: float, l2: float, rounds: int) -> tuple[float, float]:
    """Slope and level that turn margins into log-odds, by logistic regression on margins of texts that their fit left out.

    The FOLDS parts take texts of each label by turns. Few texts move the slope little from 1 and the level from 0; both
    stay there if a label has fewer than two texts a part, or if the margins of texts left out tell nothing.
    """
    part = np.empty(len(y), np.int64)
    for kind in (y > 0, y < 0):
        if kind.sum() < 2 * FOLDS:
            return 1.0, 0.0
        part[kind] = np.arange(kind.sum()) % FOLDS
    z = np.full(len(y), np.log(odds))
    for k in range(FOLDS):
        kept, renamed = part != k, np.cumsum(part != k) - 1
        known = kept[row]
        w, b = _fitted(renamed[row[known]], bucket[known], y[kept], l2, rounds)
        z += np.where(kept, 0.0, np.bincount(row, w[bucket] * ~known, len(y)) + b)
    share = odds / (1 + odds)
    weight = np.where(y > 0, share / (y > 0).sum(), (1 - share) / (y < 0).sum())
    x, start = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        return (weight * np.logaddexp(0, -y * (x @ at))).sum() + NEAR * ((at - start) ** 2).sum()

    now = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ now, -40, 40)))
        slope = x.T @ (weight * (p - (y > 0))) + 2 * NEAR * (now - start)
        move, size = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2 * NEAR * np.eye(2), slope), 1.0
        while size > 1e-6 and loss(now - size * move) > loss(now):
            size /= 2
        now = now - size * move
        if np.abs(size * move).max() < 1e-7:
            break
    return (float(now[0]), float(now[1])) if now[0] > 0 else (1.0, 0.0)


def label_odds(labels: DataFrame, label: str, learnable: Column) -> float:
    """Labels 1 for each label 0 among those to learn from; 1 if either is missing."""
    n = labels.filter(learnable).agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero")).first()
    return n["one"] / n["zero"] if n["one"] and n["zero"] else 1.0


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_label: int, id_col: str, text: str = "text") -> DataFrame:
    """_id, _label and text (of the least hash, where an id has several) of a bounded draw of labels."""
    rows = labels.filter(learnable & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    sample = drawn(rows, "_label", "_id", per_label, 2 * per_label)  # so many rows are broadcast at most
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    return found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))["t"].alias(text))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", id_col: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> Model:
    """A model from the labels of rows where learnable, an expression of id_col, holds."""
    rows = labelled(docs, labels, label, learnable, per_label, id_col, text)
    short = F.coalesce(F.length(text), F.lit(0)) <= TRAIN_CHARS
    got = [(r["_label"], r[text] or "") for r in rows.filter(short).select("_label", text).toLocalIterator()]
    if lacking := {0, 1} - {v for v, _ in got}:
        longer = rows.filter(~short & F.col("_label").isin(*lacking)).orderBy(F.length(text), "_id").limit(LONG)
        got += [(r["_label"], r[text]) for r in longer.select("_label", text).toLocalIterator()]
    got.sort()
    return Model.fit([t for _, t in got], [v for v, _ in got], label_odds(labels, label, learnable))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score, predicted for every row."""
    sent, rows = docs.sparkSession.sparkContext.broadcast(model), docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in steps(batches, text):
            p = sent.value.score(raw, at)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(id_col)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double, predicted int")
