"""A quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good documents of the learning folds; the
unlabelled set is all documents of these folds. With logistic loss the unbiased risk
  prior * E_P[-z] + E_U[log(1 + e^z)]
is convex; its second part of negatives, E_U[l(-z)] - prior * E_P[l(-z)], is held
non-negative: where it falls below zero a step goes back on it. Each Newton step is
one pass over a small table of features and sums a bounded number of moments; the
class prior comes from the scores' distributions over all positives and all unlabelled
documents (the least ratio of their upper tails). No row is sampled. Weights are rounded,
so the order in which moments are summed does not show in a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import held_out, materialize

RIDGE, ROUNDS, BINS = 2e-2, 12, 512
#: Decimals of scaling and weights that count.
DECIMALS = 7
_U = np.uint64

_CLASS = np.zeros(256, np.uint8)  # 0: other punctuation
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[[0x2E, 0x2C]] = 6
_CLASS[0x21] = 7
_CLASS[0x7C] = 8
_CLASS[[0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x7E, 0x5C, 0x5F, 0x2B, 0x3D, 0x3C, 0x3E]] = 9
_CLASS[[0x28, 0x29, 0x5B, 0x5D, 0x7B, 0x7D]] = 10
_CLASS[0x80:] = 11
CLASSES = 12
FEATURES = 2 * CLASSES + 18


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text, from the whole text."""
    offsets, body, _ = W.flat(column)
    x = np.zeros((len(offsets) - 1, FEATURES))
    for i, j, h, where in W.word_groups(offsets, body):
        d = j - i
        counts = np.zeros((d, CLASSES))
        for a in range(int(offsets[i]), int(offsets[j]), W.PIECE):
            b = min(a + W.PIECE, int(offsets[j]))
            inside = np.clip(offsets[i : j + 1], a, b)
            row = np.repeat(np.arange(d), np.diff(inside))
            counts += np.bincount(row * CLASSES + _CLASS[body[a:b]], minlength=d * CLASSES).reshape(d, CLASSES)
        size = counts.sum(1)
        words = np.diff(where).astype(float)
        text = np.repeat(np.arange(d), np.diff(where))
        by_text = lambda mark: np.bincount(text, mark, d)  # noqa: E731, B023
        order = np.lexsort((h, text))
        hs, ts = h[order], text[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
        runs = np.diff(np.append(np.flatnonzero(new), len(hs)))
        most = np.zeros(d)
        np.maximum.at(most, ts[new], runs)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        second = np.zeros(len(h), bool)
        second[2:] = (h[2:] == h[:-2]) & (text[2:] == text[:-2])
        block = x[i:j]
        block[:, :CLASSES] = _ratio(counts, size[:, None])
        block[:, CLASSES : 2 * CLASSES] = np.sqrt(block[:, :CLASSES])
        letters = counts[:, 1] + counts[:, 2]
        block[:, 2 * CLASSES :] = np.stack(
            [
                np.log1p(size) / 10,
                np.log1p(words) / 10,
                _ratio(size, words) / 10,
                np.bincount(ts[new], minlength=d) / np.maximum(words, 1) if len(h) else np.zeros(d),
                _ratio(most, words),
                np.sqrt(_ratio(most, words)),
                _ratio(by_text(same), words),
                np.sqrt(_ratio(by_text(same), words)),
                _ratio(by_text(second), words),
                _ratio(counts[:, 2], letters),
                np.sqrt(_ratio(counts[:, 7:10].sum(1), words)),
                (size == 0).astype(float),
                _ratio(np.maximum(most - 1, 0), words),
                np.log1p(np.bincount(ts[new], minlength=d)) / np.log1p(np.maximum(words, 1)),
                # shares of words that saturate: a little of these says as much as a lot
                *(np.minimum(1, 5 * _ratio(c, words)) for c in (by_text(same), counts[:, 7], counts[:, 8], counts[:, 9])),
            ],
            1,
        )
    return x


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b["text"]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "held_out", "x"])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def _sums(data: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of the learning folds of f(features, is a positive), size numbers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b), np.asarray(b["positive"], dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["slot", "v"])

    out = np.zeros(size)
    for r in data.mapInArrow(part, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():
        out[r["slot"]] = r["v"]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(data: DataFrame) -> dict | None:
    """The model for data(positive, x): weights, scaling, prior and the risk's parts."""
    d = FEATURES + 1
    stats = _sums(data, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * FEATURES)
    n_u, n_p = stats[:2]
    if not n_u or not n_p:
        return None
    mean = np.round(stats[2 : 2 + FEATURES] / n_u, DECIMALS)
    scale = np.round(np.sqrt(np.maximum(stats[2 + FEATURES :] / n_u - mean**2, 1e-8)), DECIMALS)

    def moments(w: np.ndarray):
        def f(x, p):
            x = _scaled(x, mean, scale)
            z = x @ w
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return np.concatenate([x[p].sum(0), s @ x, s[p] @ x[p], ((x.T * (s * (1 - s))) @ x).ravel(), [_softplus(z).sum(), _softplus(z[p]).sum(), _softplus(-z[p]).sum()]])

        return f

    def newton(prior: float, w: np.ndarray, rounds: int) -> tuple[np.ndarray, float, float]:
        ridge = RIDGE * np.eye(d)
        ridge[-1, -1] = 0
        negative = positive = 0.0
        for _ in range(rounds):
            m = _sums(data, moments(w), 3 * d + d * d + 3)
            mean_p, grad_u, grad_p = m[:d] / n_p, m[d : 2 * d] / n_u, m[2 * d : 3 * d] / n_p
            curve = m[3 * d : 3 * d + d * d].reshape(d, d) / n_u + ridge + 1e-9 * np.eye(d)
            negative, positive = m[-3] / n_u - prior * m[-2] / n_p, prior * m[-1] / n_p
            if negative < 0:  # go back on the negatives' part alone
                w = w + 0.5 * np.linalg.solve(curve, grad_u - prior * grad_p)
                continue
            step = np.linalg.solve(curve, grad_u - prior * mean_p + ridge @ w)
            step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            w = w - step
            if np.abs(step).max() < 1e-3:
                break
        return w, negative, positive

    w = np.round(newton(0.5, np.zeros(d), 5)[0], DECIMALS)
    edges = 1 / (1 + np.exp(-np.linspace(-12, 12, BINS - 1)))

    def histogram(x, p):
        s = 1 / (1 + np.exp(-np.clip(_scaled(x, mean, scale) @ w, -40, 40)))
        k = np.searchsorted(edges, s)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k[p], minlength=BINS)]).astype(float)

    both = _sums(data, histogram, 2 * BINS)
    tail_u, tail_p = np.cumsum(both[:BINS][::-1]) / n_u, np.cumsum(both[BINS:][::-1]) / n_p
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(tail_p > 0.01, (tail_u + slack) / tail_p, np.inf)
    best = int(np.argmin(bound))
    prior = float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))
    w, negative, positive = newton(prior, w, ROUNDS)
    return {"w": np.round(w, DECIMALS), "mean": mean, "scale": scale, "prior": prior, "negative_risk": negative, "positive_risk": positive}


def _margin(x: np.ndarray, model: dict) -> np.ndarray:
    """Row by row, so the rows beside one do not show in its last bits."""
    return (_scaled(x, model["mean"], model["scale"]) * model["w"]).sum(1)


def _predict(model: dict | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if model is not None and b.num_rows:
                z = _margin(_matrix(b), model)
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return predict


def extract(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumn("held_out", held_out("id"))
    return materialize(rows.mapInArrow(_extract, "id long, held_out boolean, x binary"), "features")


def train(found: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> dict | None:
    """The model of the features in found and the labels outside the held-out fold."""
    good = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y is not null")
    good = good.groupBy("id").agg(F.min("y").alias("y")).where("y = 1")
    data = found.where("not held_out").join(good, "id", "left").select(F.col("y").isNotNull().alias("positive"), "x")
    return fit(materialize(data, "learning"))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    A null or empty text is scored like any other, from its own features; a null id is
    held out; a doc_id with several labels is a trusted positive only if all are 1;
    rows that repeat a doc_id are scored one by one; without positives or learning
    rows every score is 0.5; an empty table gives no rows; further columns are ignored.
    """
    found = extract(docs, id_column, text_column)
    return found.mapInArrow(_predict(train(found, labels)), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, scored in one further pass over the texts; all columns stay.

    Null and empty texts are judged like any other, rows that repeat a doc_id or have none
    one by one; without positives or learning rows all rows stay; an empty table stays empty.
    """
    model = train(extract(docs, id_column, text_column), labels)
    where = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is not None and b.num_rows:
                z = _margin(features(b.column(where)).astype(np.float32).astype(float), model)
                b = b.filter(pa.array(z >= 0))
            yield b

    return docs.mapInArrow(keep, docs.schema)
