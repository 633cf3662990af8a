"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Of each pair of a good and a
bad labelled document the good one should win, with the probability that the logistic
function gives for the difference of strengths; the weights minimise the logistic loss
on feature differences. The threshold is the quantile of strengths that leaves the
share of bad documents below it.

No pair is formed. A sum over all pairs of a smooth function of the difference of strengths
follows from sums over rows: strengths are cut into short intervals, in which the function
equals its interpolation at Chebyshev points to about twelve digits. Each Newton step adds up
counts, features and their products by class, interval and Chebyshev polynomial, in one pass
over the labelled rows; what reaches the driver is 48 kB for each class and interval of
strengths, however many rows they hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.labelled import fold, outside
from sparkloom.llm.session import cut, written
from sparkloom.operators.common import exact_quantiles

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "bars", "marks", "blank", "distinct_words", "distinct_pairs", "top_word", "long_words", "lines")
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "bars": b"|", "marks": b"!?",
    "symbols": b"#$%&*+<=>@[\\]^_`{|}~", "blank": b" \t\r\n", "lines": b"\n", "other": range(128, 256),
}
#: Strengths of an interval span WIDTH; functions of them are interpolated at NODES points. The logistic function's poles lie pi off the real line, so the error is about (pi + sqrt(pi ** 2 + 1)) ** -NODES.
WIDTH, NODES = 2.0, 16
#: Rows whose products are held at a time.
STEP_ROWS = 2048
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}


def features(column) -> np.ndarray:
    """A row of FEATURES for each text; zeros without words."""
    out = []
    for _, w in K.steps(column, K.BLANK_WORD, K.IDENTITY):
        docs = len(w.counts)
        sizes = np.diff(w.offsets)
        share = lambda kind, of: np.diff(np.concatenate([[0], np.cumsum(_MASKS[kind][w.data])])[w.offsets]) / np.maximum(of, 1)
        letters = share("upper", np.ones(docs)) + share("lower", np.ones(docs)) + share("other", np.ones(docs))
        words = np.maximum(w.counts, 1)
        lengths = w.ends - w.starts

        def distinct(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct names of each document, and how often its most frequent one stands."""
            if not len(names):
                return np.zeros(docs), np.zeros(docs)
            order = np.lexsort((names, doc))
            n, d = names[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1])]))
            times = np.diff(np.concatenate([head, [len(n)]]))
            top = np.zeros(docs)
            np.maximum.at(top, d[head], times)
            return np.bincount(d[head], minlength=docs), top

        single, top = distinct(w.name[0], w.doc)
        at, (pairs, _) = w.windows(2)
        double, _ = distinct(pairs, w.doc[at])
        x = np.stack(
            [
                np.log1p(w.counts), np.bincount(w.doc, lengths, docs) / words, share("upper", letters), share("symbols", sizes), share("digits", sizes), share("bars", sizes), share("marks", sizes), share("blank", sizes),
                single / words, double / np.maximum(w.counts - 1, 1), top / words, np.bincount(w.doc, lengths > 20, docs) / words, share("lines", words),
            ],
            axis=1,
        )
        out.append(np.where(w.counts[:, None] > 0, x, 0.0))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Strength weights over standardised features and their squares, and the threshold that scores `at`."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    at: float = 0.7

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.expand(x) * self.weights).sum(axis=1)  # row by row, so that equal rows score alike in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + shift, -30, 30)))


Moments = dict[tuple[int, int], np.ndarray]


def moments(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> Moments:
    """By label and interval of strengths: for each Chebyshev polynomial of the strength (rows) the sums of 1, z and the products of two z (columns)."""
    strength = z @ w / WIDTH
    interval = np.floor(strength)
    waves = chebvander(2 * (strength - interval) - 1, NODES - 1)
    i, j = np.triu_indices(z.shape[1])
    of_row = np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)
    keys, of = np.unique(np.stack([label, interval.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    own = [np.flatnonzero(of.ravel() == k) for k in range(len(keys))]
    return {(int(a), int(b)): waves[rows].T @ of_row[rows] for (a, b), rows in zip(keys, own)}


def add(total: Moments, more: Moments) -> None:
    for key, sums in more.items():
        total[key] = total[key] + sums if key in total else sums


def pair_sums(total: Moments, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all pairs of a good and a bad row: logistic loss of the difference of strengths, its negative gradient and its second derivatives.

    Moments become weights at the Chebyshev points of their interval; pairs of points take the place of pairs of rows.
    """
    points = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    spread = chebvander(points, NODES - 1) * np.where(np.arange(NODES) > 0, 2, 1) / NODES

    def at_points(kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = sorted(k for k in total if k[0] == kind)
        return np.concatenate([(k + (points + 1) / 2) * WIDTH for _, k in own]), np.concatenate([spread @ total[k] for k in own])

    (up, good), (down, bad) = at_points(1), at_points(0)
    loss, gradient, cross, squares = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(good.shape[1] - 1 - width)
    for k in range(0, len(up), NODES):
        here = good[k : k + NODES]
        apart = up[k : k + NODES, None] - down[None, :]
        lose = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
        loss += float(here[:, 0] @ np.logaddexp(0, -apart) @ bad[:, 0])
        gradient += (lose @ bad[:, 0]) @ here[:, 1 : 1 + width] - (here[:, 0] @ lose) @ bad[:, 1 : 1 + width]
        lose *= 1 - lose
        squares += (lose @ bad[:, 0]) @ here[:, 1 + width :] + (here[:, 0] @ lose) @ bad[:, 1 + width :]
        cross += here[:, 1 : 1 + width].T @ (lose @ bad[:, 1 : 1 + width])
    curve = np.zeros((width, width))
    curve[np.triu_indices(width)] = squares
    curve = curve + np.triu(curve, 1).T - cross - cross.T
    return loss, gradient, curve


def newton(measure: Callable[[np.ndarray], Moments], width: int, good: int, bad: int, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Bradley-Terry weights: Newton steps, halved where they overshoot, on the mean logistic loss over all pairs, times the number of rows.

    `measure` gives the moments of all rows under some weights.
    """
    w, step, best = np.zeros(width), np.zeros(width), np.inf
    scale = (good + bad) / (good * bad)
    for _ in range(rounds):
        loss, gradient, curve = pair_sums(measure(w + step), width)
        value = scale * loss + ridge / 2 * float((w + step) @ (w + step))
        if value > best * (1 + 1e-9):
            step = step / 2
            continue
        w, best = w + step, value
        step = np.linalg.solve(scale * curve + ridge * np.eye(width), scale * gradient - ridge * w)
        if np.abs(step).max() < 1e-6:
            return w + step
    return w


def pair_weights(good: np.ndarray, bad: np.ndarray, ridge: float = 1.0, rounds: int = 40, step_rows: int = STEP_ROWS) -> np.ndarray:
    """The weights for rows in memory, step_rows of them at a time."""

    def measure(w: np.ndarray) -> Moments:
        total: Moments = {}
        for kind, rows in ((1, good), (0, bad)):
            for k in range(0, len(rows), step_rows):
                part = rows[k : k + step_rows]
                add(total, moments(part, np.full(len(part), kind), w))
        return total

    return newton(measure, good.shape[1], len(good), len(bad), ridge, rounds)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _rows(total: Moments) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int64()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["label", "interval", "sums"]
    )


def measured_pairs(seen: DataFrame, model: Model) -> Callable[[np.ndarray], Moments]:
    """Moments of the table seen (label, x): tasks add up their rows, then what tasks found meets by label and interval."""
    columns = "label int, interval long, sums array<double>"

    def measure(w: np.ndarray) -> Moments:
        def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Moments = {}
            for batch in batches:
                for part in K.slices(batch, STEP_ROWS):
                    add(total, moments(model.expand(_matrix(part.column("x"), len(FEATURES))), part.column("label").to_numpy(), w))
            yield _rows(total)

        def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Moments = {}
            for batch in batches:
                for label, interval, sums in zip(batch.column("label").to_pylist(), batch.column("interval").to_pylist(), _matrix(batch.column("sums"), moment_cells(len(w)))):
                    add(total, {(label, interval): sums})
            yield _rows(total)

        found = seen.mapInArrow(of_rows, columns).repartition("label", "interval").mapInArrow(of_tasks, columns).toArrow()  # a row for each label and interval
        return {(r["label"], r["interval"]): np.array(r["sums"]).reshape(NODES, -1) for r in found.to_pylist()}

    return measure


def moment_cells(width: int) -> int:
    """Numbers that a label and interval have."""
    return NODES * (1 + width + width * (width + 1) // 2)


class QualityRanking:
    """Scores texts between 0 and 1; `at` and more means good.

    Learned from all preference pairs of a good and a bad document among all labelled ones
    outside the held-out fold, or, where `fit_rows` is given, among that many of them. All
    documents are scored. Only the text enters a score. Null and empty texts score as texts
    without words; repeated rows score alike; long texts are read whole. Without labelled
    rows of both kinds every strength is 0, which scores `at`. Further columns are ignored.

    Means, spreads and weights are rounded to single precision, as the order in which tasks
    are added up changes their last digits.
    """

    def __init__(self, fit_rows: int | None = None, folds: int = 4, held_out: int = 2, at: float = 0.7):
        self.fit_rows, self.folds, self.held_out, self.at = fit_rows, folds, held_out, at

    def measure(self, docs: DataFrame) -> DataFrame:
        """(doc_id, x): the features of every text."""

        def run(batches):
            for batch in batches:
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return own.mapInArrow(run, "doc_id long, x array<double>")

    def fit(self, docs: DataFrame, labels: DataFrame) -> Model:
        return self.fit_measured(written(self.measure(docs)), labels)

    def fit_measured(self, measured: DataFrame, labels: DataFrame) -> Model:
        """The model, from what measure() returned. Features are joined with the labels, so no text is."""
        own = outside(labels, "quality", self.folds, self.held_out, self.fit_rows)
        seen = written(measured.where(fold(F.col("doc_id"), self.folds) != self.held_out).join(own, "doc_id").select("label", "x"))
        n = len(FEATURES)
        model = Model(np.zeros(n), np.ones(n), np.zeros(2 * n), at=self.at)
        each = [f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(n)]
        rows, good, *found = seen.agg(F.count("*"), F.count_if(F.col("label") == 1), *each).first()
        if not 0 < good < rows:
            return model
        model.mean, model.spread = _single(found[:n]), np.maximum(_single(found[n:]), 1e-6)
        model.weights = _single(newton(measured_pairs(seen, model), 2 * n, good, rows - good))

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(batch.column("x"), n)))], names=["strength"])

        strengths = cut(seen.mapInArrow(run, "strength double"))
        model.threshold = exact_quantiles(strengths, {"strength": F.col("strength")}, [(rows - good) / rows])["strength"][0]
        return model

    def score(self, docs: DataFrame, model: Model) -> DataFrame:
        """(doc_id, score)."""
        return self.score_measured(self.measure(docs), model)

    def score_measured(self, measured: DataFrame, model: Model) -> DataFrame:
        """(doc_id, score), from what measure() returned."""

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"), len(FEATURES))))], names=["doc_id", "score"])

        return measured.mapInArrow(run, "doc_id long, score double")

    def run(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(doc_id, score) of all documents by a model learned from the labelled ones. Texts are read once."""
        measured = written(self.measure(docs))
        return self.score_measured(measured, self.fit_measured(measured, labels))


def _single(values) -> np.ndarray:
    return np.array(values, dtype=np.float32).astype(float)
