"""Bounded samples of labelled rows, and small linear models fitted on them with NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_CHARS = 20_000  # labelled texts above it are not learned from
_HASHES = 2**63


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int = SAMPLE_CHARS, where: Column | None = None
) -> tuple[list[tuple], dict]:
    """((label, text) rows, rows per label) of docs(doc_id, text) and labels(doc_id, label).

    At most about ``per_class`` labels of each value, those with the smallest hash of their id, and of
    their rows the texts of at most ``max_chars`` characters, at most ``2 * per_class`` for each value.
    Where repeated ids give more labels or rows, those with the smallest hashes are taken, so the sample
    is the same in every run. Rows without id, label or text are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label")
    if where is not None:
        known = known.filter(where)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], {}
    place = F.xxhash64(F.col("doc_id"), F.lit("sample")).bitwiseAND(F.lit(_HASHES - 1))
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(_HASHES - 1, int(_HASHES * min(1.0, per_class / n))))).otherwise(share)
    chosen = known.filter(place <= share)
    bound = 2 * per_class * len(counts)
    chosen = chosen.orderBy(place, "doc_id", "label").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "label", "text")
    rows = rows.orderBy(place, "doc_id", "label", F.xxhash64("text"), "text").limit(bound).collect()
    return [(r["label"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], str(r["label"]), r["text"]))], counts


def fit_logistic(
    index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int,
    steps: int = 100, rate: float = 0.05, penalty: float = 1e-6,
) -> np.ndarray:
    """Weights of a logistic regression on sparse rows by Adam; the last weight is the intercept.

    Row i has the features index[first[i]:first[i + 1]] with their values.
    """
    row = np.repeat(np.arange(len(y)), np.diff(first))
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[index], minlength=len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = np.bincount(index, value * error[row], minlength=width + 1) + penalty * w
        grad[-1] = error.sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of p = 1 / (1 + exp(-(a z + b))), by Newton steps with slightly softened targets."""
    pos, neg = (weight * (y > 0)).sum(), (weight * (y <= 0)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum(), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(a, b)
        while size > 1e-4 and loss(a - size * move[0], b - size * move[1]) > now:
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(move).max() * size < 1e-7:
            break
    return float(a), float(b)


def crc32_text(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))
