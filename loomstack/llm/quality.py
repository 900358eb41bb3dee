"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns.

Shallow trees, each grown on a random half of the labelled rows to correct the trees before it, give conjunctive
rules: every path from a root. Logistic regression with a lasso penalty weighs the rules and drops most. What
remains is one column expression over the statistics, themselves column expressions over the whole text, so
scoring is a narrow projection without Python.

The model is fitted on a bounded sample: of each label the PER_LABEL labelled ids of the least hashes, each with one
text; only their statistics reach the driver.

Defined results: a null text counts as an empty one, whose statistics are all zero; with no row of one of the
labels to learn from, every score is the share of label 1 among what was learned (0 if nothing was); repeated rows
are scored each; repeated labels count once; null ids and labels are not learned from; empty tables give no rows;
statistics have names of their own inside, so no column of docs can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.llm.toxicity import label_odds, labelled

PER_LABEL = 3000
TREES, DEPTH, BINS, PENALTY = 40, 3, 24, 2e-3
THRESHOLD = 0.7


def statistics(text: str = "text") -> dict[str, Column]:
    """Counts of a text's characters and words, from which shares() follow."""
    t = F.coalesce(F.col(text), F.lit(""))

    def kept(other: str) -> Column:
        return F.length(F.regexp_replace(t, other, ""))

    words = F.split(F.lower(t), r"[ \t\n\r]+")
    return {
        "n": F.length(t),
        "solid": kept(r"\s+"),
        "letters": kept(r"[^\p{L}]+"),
        "capitals": kept(r"[^\p{Lu}]+"),
        "digits": kept(r"[^\p{N}]+"),
        "stops": kept(r"[^.,;:]+"),
        "lines": kept(r"[^\n]+"),
        "words": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "doubled": F.regexp_count(t, F.lit(r"(?<!\S)(\S++)(?=\s\1(?!\S))")),
    }


def shares() -> dict[str, Column]:
    """The statistics that rules test, as shares of characters or words, from a row with the struct _s."""
    s = {k: F.col(f"_s.{k}").cast("double") for k in ("n", "solid", "letters", "capitals", "digits", "stops", "lines", "words", "distinct", "doubled")}

    def of(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))

    return {
        "chars": s["n"],
        "letters": of(s["letters"], s["n"]),
        "capitals": of(s["capitals"], s["letters"]),
        "digits": of(s["digits"], s["n"]),
        "signs": of(s["solid"] - s["letters"] - s["digits"] - s["stops"], s["n"]),
        "stops": of(s["stops"], s["words"]),
        "lines": of(s["lines"], s["words"]),
        "word_chars": of(s["solid"], s["words"]),
        "distinct": of(s["distinct"], s["words"]),
        "doubled": of(s["doubled"], s["words"]),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each test, statistic, threshold, and whether the statistic must exceed it."""

    tests: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0

    def column(self, values: dict[str, Column]) -> Column:
        held = [values[s] > F.lit(t) if above else values[s] <= F.lit(t) for s, t, above in self.tests]
        both = held[0]
        for h in held[1:]:
            both &= h
        return F.when(both, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.all([(x[:, names.index(s)] > t) == above for s, t, above in self.tests], axis=0)


def _grow(x: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, depth: int, names: list[str], path: tuple, out: list[Rule], least: int) -> np.ndarray:
    """A regression tree for slope; its paths go to out, its values are returned."""
    best = (1e-12, None)
    if depth and len(x) >= 2 * least:
        whole = slope.sum() ** 2 / len(slope)
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            side = np.searchsorted(own, x[:, j], "left")
            n, g = (np.bincount(side, w, len(own) + 1).cumsum()[:-1] for w in (None, slope))
            fine = (n >= least) & (len(x) - n >= least)
            gain = np.where(fine, g * g / np.maximum(n, 1) + (slope.sum() - g) ** 2 / np.maximum(len(x) - n, 1) - whole, 0)
            if gain.max() > best[0]:
                best = (gain.max(), (j, float(own[gain.argmax()])))
    if best[1] is None:
        return np.full(len(x), slope.mean() if len(slope) else 0.0)
    j, cut = best[1]
    above, value = x[:, j] > cut, np.empty(len(x))
    for side in (True, False):
        rule = Rule((*path, (names[j], cut, side)))
        out.append(rule)
        value[above == side] = _grow(x[above == side], cuts, slope[above == side], depth - 1, names, rule.tests, out, least)
    return value


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Distinct rules of boosted trees; y of -1 and 1, balanced by weight."""
    rng, found, level = np.random.default_rng(seed), [], np.zeros(len(y))
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, BINS))) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
    groups = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    for _ in range(trees):
        half = np.concatenate([rng.choice(g, -(-min(map(len, groups)) // 2) if len(g) > 8 else len(g), replace=False) for g in groups])
        slope = y[half] / (1 + np.exp(y[half] * level[half]))
        rules: list[Rule] = []
        _grow(x[half], cuts, slope, depth, names, (), rules, max(3, len(half) // 200))
        found += rules
        tree = [r for r in rules if not any(len(o.tests) > len(r.tests) and o.tests[: len(r.tests)] == r.tests for o in rules)]
        for leaf in tree:
            inside = leaf.holds(x, names)
            own = inside[half]
            if own.any():
                level[inside] += 0.5 * np.clip(slope[own].sum() / (np.abs(slope[own]) * (1 - np.abs(slope[own])) + 1e-6).sum(), -4, 4)
    return list({tuple(sorted(r.tests)): r for r in found}.values())


def lasso(held: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute penalty, and a free constant; the labels weigh the same."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    x = np.c_[held, np.ones(len(y))].astype(np.float32)
    top = float(np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1])
    step, t = 4 / (top * 1.05), 1.0
    w = ahead = np.zeros(x.shape[1])
    for _ in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30))) * weight
        new = ahead - step * (x.T @ slope)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (last - 1) / t * (new - w)
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, names: list[str], odds: float = 1.0) -> Model:
        """odds: of label 1 among all labels; the sample's own share of it does not matter."""
        y = np.asarray(labels, float) * 2 - 1
        if not len(y) or abs(y.sum()) == len(y):
            return Model((), 20.0 if len(y) and y[0] > 0 else -20.0)
        rules = grow_rules(x, y, names)
        if not rules:
            return Model((), 0.0)
        weights, bias = lasso(np.stack([r.holds(x, names) for r in rules], axis=1), y)
        return Model(tuple(Rule(r.tests, round(float(w), 6)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4), float(bias + np.log(odds)))

    def column(self, values: dict[str, Column]) -> Column:
        """The score as one expression: a logistic of the sum of the weights of the rules that hold."""
        parts = [F.lit(self.bias), *(r.column(values) for r in self.rules)]
        while len(parts) > 1:  # a balanced sum keeps the expression shallow
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-parts[0]))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with struct _v of shares().

    Each step is an exploded array of one struct: no filter or projection above it can be folded into it, so
    every statistic is worked out once for each row.
    """
    first = docs.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in statistics(text).items()]))).alias("_s"))
    return first.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in shares().items()]))).alias("_v")).drop("_s")


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> Model:
    """A model from the labels of rows where learnable, an expression of id_col, holds."""
    names = list(shares())
    rows = with_statistics(labelled(docs, labels, label, learnable, per_label, id_col, text), text)
    got = np.array(sorted(tuple(r) for r in rows.select(*[F.col(f"_v.{k}") for k in names], F.col("_label").cast("double")).toLocalIterator())).reshape(-1, len(names) + 1)
    return Model.fit(got[:, :-1], got[:, -1], names, label_odds(labels, label, learnable))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score, predicted for every row."""
    scored = with_statistics(docs.select(id_col, text), text).select(id_col, "_v").select(id_col, model.column({k: F.col(f"_v.{k}") for k in shares()}).alias("score"))
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with at least this score, as they are."""
    scored = with_statistics(docs, text)
    return scored.filter(model.column({k: F.col(f"_v.{k}") for k in shares()}) >= threshold).select(docs.columns)
