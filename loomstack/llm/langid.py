"""Language ID by error-correcting output codes over character n-grams.

Every language has a codeword; one binary linear classifier of n-gram frequencies predicts each bit. Decoding adds
up, for every language, the logistic losses of the predicted bits against its codeword, weighted by how far each
bit's classifier beats chance, and takes the language of least loss. A text is ambiguous if its two best
languages are close.

The classifiers are fitted on a bounded sample of whole labelled texts, SAMPLE in all, of every language alike and
at most PER_LANGUAGE: those of the least hashes of their ids over the whole table. An id counts once for a language,
with the text of the least hash. Only n-gram counts of these texts reach the driver. A fifth of the sample is not
learned from, but tells how far each bit's classifier beats chance. Prediction reads whole texts and nothing but
texts; a text longer than a step is worked in parts.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text if no labelled row
can be learned from; repeated rows are judged each; null ids, null texts and letterless ones are not learned from; an empty table gives no rows;
only the named columns are read (accepted() passes the others on unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstack.llm.common import STEP_BYTES, steps
from loomstack.llm.ngrams import by_parts, characters, hashed, row_sums

PER_LANGUAGE, SAMPLE = 400, 8192
#: One in FOLD drawn rows of a language is held out to judge the bits.
FOLD = 5
ORDERS, BITS = (1, 2, 3), 12
#: Least lead of the best language's probability over the second's.
LEAD = 0.1
UNKNOWN = "und"


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1: every split of up to five languages, else random splits far apart."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        splits = np.arange(1, 1 << (k - 1))
        return np.where((splits[None, :] >> np.arange(k)[:, None]) & 1, 1.0, -1.0)
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, 6 * int(np.ceil(np.log2(k)))))
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        split = np.abs(code.sum(axis=0)).max() < k
        if split and (best is None or gap > best[0]):
            best = gap, code
    return best[1]


def frequencies(raw: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over orders of each row's mean weight per n-gram, and whether the row has a letter.

    weights: (buckets + 1, outputs), the last row zero.
    """
    points, rows, letter = characters(raw, at)
    points = np.where(letter, points, np.uint32(32))
    out = np.zeros((len(rows) - 1, weights.shape[1]))
    for n in ORDERS:
        h, count = hashed(points, rows, n, BITS)
        out += row_sums(weights[h], rows) / np.maximum(count, 1)[:, None]
    return out, row_sums(letter.astype(np.int64), rows) > 0


def histogram(raw: np.ndarray) -> tuple[np.ndarray, bool]:
    """Sums over orders of the frequencies of one text's n-grams by bucket, and whether it has a letter."""
    found, letters = {n: np.zeros(1 << BITS) for n in ORDERS}, 0
    for n, h, some in by_parts(raw, ORDERS, BITS):
        found[n] += np.bincount(h, minlength=1 << BITS)
        letters += some
    return sum(f / max(f.sum(), 1) for f in found.values()), letters > 0


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of logistic regressions on rows x against columns of -1 and 1 in y, by accelerated gradients."""
    weight = np.full((len(y), 1), 1 / len(y)) if weight is None else weight
    vector = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(12):
        vector = x.T @ (weight[:, 0] * (x @ vector))
        top = np.linalg.norm(vector)
        vector /= top or 1
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    step, t = 1 / (0.25 * top * 1.2 + l2), 1.0
    for _ in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30))) * weight
        new = ahead - step * (x.T @ slope + l2 * ahead)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (last - 1) / t * (new - w)
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets + 1 x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit's classifier

    @staticmethod
    def fit(counts: np.ndarray, labels: list[str], l2: float = 1e-4, rounds: int = 120) -> Model:
        """counts: a histogram for each label, overwritten here."""
        languages = sorted(set(labels))
        code = codewords(len(languages))
        if not code.size:
            return Model(languages, code, np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0), np.zeros(0))
        number = {v: i for i, v in enumerate(languages)}
        own = np.array([number[v] for v in labels])
        order = np.argsort(own, kind="stable")
        nth = np.empty(len(own), np.int64)
        nth[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        judging = nth % FOLD == FOLD - 1
        x, y = counts, code[own].astype(np.float32)
        mean, spread = x[~judging].mean(axis=0), x[~judging].std(axis=0) + 1e-3
        x -= mean
        x *= 8 / spread / np.sqrt(len(spread), dtype=np.float32)
        w = logistic(np.c_[x[~judging], np.ones((~judging).sum(), np.float32)], y[~judging], l2, rounds).astype(np.float64)
        if not judging.any():
            judging[:] = True
        right = (np.sign(x[judging] @ w[:-1] + w[-1]) == y[judging]).mean(axis=0)
        scaled = w[:-1] / spread[:, None] / np.sqrt(len(spread)) * 8
        return Model(languages, code, np.r_[scaled, np.zeros((1, scaled.shape[1]))].astype(np.float32), w[-1] - mean @ scaled, np.clip(2 * right - 1, 0.05, 1))

    def step(self) -> int:
        """Bytes of text worked at once: every character takes a row of weights."""
        return STEP_BYTES * 8 // max(8, self.code.shape[1])

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability and whether it is ambiguous, for each row."""
        if len(at) == 2 and len(raw) > STEP_BYTES:
            found, letter = histogram(raw)
            margin, letters = found[None] @ self.weights[:-1], np.array([letter])
        else:
            margin, letters = frequencies(raw, at, self.weights)
        if not self.languages:
            letters &= False
        if len(self.languages) < 2:
            return [self.languages[0] if k else UNKNOWN for k in letters], letters.astype(float), ~letters
        margin += self.bias
        loss = (np.logaddexp(0, -self.code[None] * margin[:, None]) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)], np.where(letters, top[:, -1], 0.0), ~letters | (top[:, -1] - top[:, -2] < LEAD)


def drawn(rows: DataFrame, label: str, id_col: str, per_label: int, total: int, text: str | None = None) -> DataFrame:
    """label, id_col (and text): of every label the ids of the least hashes, each once, at most per_label and total over all labels.

    The draw is the same at every run and partitioning. Labels are counted by a sketch, so that most rows are ruled
    out before any is shuffled.
    """
    ids = rows.groupBy(label).agg(F.approx_count_distinct(id_col).alias("n")).collect()  # a row for each class of the model
    if not ids:
        return rows.limit(0)
    each = max(1, min(per_label, total // len(ids)))
    whole = 1 << 62
    # twice as many as wanted and some more, so that chance and the sketch leave enough
    least = F.create_map(*[F.lit(v) for r in ids for v in (r[label], min(whole, int(whole * (2 * each + 50) / max(r["n"], 1))))])[F.col(label)]
    order = F.pmod(F.xxhash64(id_col), F.lit(whole))
    few = rows.filter(order < least).groupBy(label, id_col)
    few = few.agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t")))["t"].alias(text)) if text else few.agg(F.lit(0).alias("_"))
    nth = F.row_number().over(Window.partitionBy(label).orderBy(order, id_col))
    return few.withColumn("_nth", nth).filter(F.col("_nth") <= each).select(label, id_col, *([text] if text else []))


def fit(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model from the rows of docs where learnable holds; null and letterless texts teach nothing."""
    rows = docs.filter(learnable & F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in steps(batches, text):
            found = [histogram(raw[a:b])[0].astype(np.float32) for a, b in zip(at[:-1], at[1:], strict=True)]
            some = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k.astype(np.uint16).tobytes() for k in some], pa.binary()), pa.array([f[k].tobytes() for f, k in zip(found, some, strict=True)], pa.binary())], ["label", "id", "at", "value"])

    few = drawn(rows.select(lang, id_col, text), lang, id_col, per_language, sample, text).select(lang, id_col, text)
    counted = few.mapInArrow(count, f"label string, id {dict(docs.dtypes)[id_col]}, at binary, value binary")
    got = sorted(counted.toLocalIterator(), key=lambda r: (r["label"], r["id"]))
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Model.fit(x, [r["label"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, lang_pred, score, ambiguous for every row."""
    sent, rows = docs.sparkSession.sparkContext.broadcast(model), docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in steps(batches, text, sent.value.step()):
            lang, score, ambiguous = sent.value.predict(raw, at)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(id_col)), pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], [id_col, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.0, ambiguous: bool = True) -> DataFrame:
    """The rows whose language is known and has at least this score, as they are; ambiguous: whether those of two near languages stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in steps(batches, text, sent.value.step()):
            lang, score, unclear = sent.value.predict(raw, at)
            yield part.filter(pa.array([v != UNKNOWN and s >= least and (ambiguous or not u) for v, s, u in zip(lang, score, unclear, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
