"""Operator 8: quality rules by a hashed n-gram logistic regression, besides fixed base rules.

Features are the shares of hashed n-grams in a text: of 1 to 3 bytes, of 1 and 2 words, and of 1 to
3 word shapes (length class, symbols, capitals, closing mark, equal to the word before). The model is
fitted on a bounded sample of labelled rows, its scores are made probabilities on a held-out part
of that sample at the labels' true proportions, and texts are kept at a fixed probability. Scores
are computed in Arrow batches: each n-gram adds its weight, so nothing wide is ever built.

Defined cases: a null or wordless text has zero counts and fails the base rules; without labelled
rows of both classes the verdict is the base rules' alone (probability 1); null labels are not
learned from; very long texts are scored whole; repeated rows are scored each; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .learning import SAMPLE_CHARS, fit_logistic, fit_platt, labelled_sample

PER_CLASS = 1_500
THRESHOLD = 0.5
BYTE_BITS, WORD_BITS, SHAPE_BITS = 14, 14, 12
WIDTH = (1 << BYTE_BITS) + (1 << WORD_BITS) + (1 << SHAPE_BITS)
SCALE = 100.0  # of shares, so that weights stay near 1
REPEAT = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,!?;:")] = True


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (A.mix(h) >> A.U64(64 - bits)).astype(np.int32)


def _runs(feature: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, lo, hi) of n-grams; the last texts may begin behind the last n-gram if they hold none."""
    lo = np.minimum(first[:-1], len(feature))
    return feature, lo, np.maximum(first[1:] - n + 1, lo)


def features(t: A.Texts, w: A.Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, lo, hi) of each n-gram family: text i has the entries lo[i]:hi[i] of feature."""
    data = t.buf.astype(A.U64)
    code = data + A.U64(1)
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * A.U64(259) + data[n - 1 :] if len(code) > 1 else code[:0]
        yield _runs(_bucket(code * A.U64(4) + A.U64(n), BYTE_BITS), t.bounds, n)
    base = 1 << BYTE_BITS
    for n in (1, 2):
        yield _runs(base + _bucket(A.run_hashes(h, n), WORD_BITS), w.first, n)
    base += 1 << WORD_BITS
    shape = word_shapes(t, w, h)
    for n in (1, 2, 3):
        yield _runs(base + _bucket(A.run_hashes(shape, n), SHAPE_BITS), w.first, n)


def word_shapes(t: A.Texts, w: A.Words, h: np.ndarray) -> np.ndarray:
    if not len(w):
        return np.zeros(0, A.U64)
    size = w.end - w.start
    edges = np.stack((w.start, w.end), 1).ravel()

    def count(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(flag[t.buf], False).astype(np.int32), edges)[::2]

    same = np.zeros(len(w), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.per_text() > 0]] = False
    length = np.searchsorted([1, 2, 4, 8, 16], size)
    capitals = count(_CAPITAL)
    return (
        length + 8 * np.minimum(count(_SYMBOL), 2) + 32 * (capitals > 0) + 64 * (capitals * 2 > size)
        + 128 * _CLOSING[t.buf[w.end - 1]] + 256 * same
    ).astype(A.U64)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def logit(self, t: A.Texts, w: A.Words, h: np.ndarray) -> np.ndarray:
        z = np.full(len(t), self.intercept)
        for feature, lo, hi in features(t, w, h):
            total = np.concatenate(([0.0], np.cumsum(self.weights[feature])))
            z += SCALE * (total[hi] - total[lo]) / np.maximum(hi - lo, 1)
        return z

    def probability(self, t: A.Texts, w: A.Words, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.logit(t, w, h) + self.b, -40, 40)))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, value, sizes = [], [], []
    for t in A.text_chunks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]), "text"):
        w = A.split_words(t)
        families = list(features(t, w, A.word_hashes(t, w)))
        for i in range(len(t)):
            own = [f[lo[i] : hi[i]] for f, lo, hi in families]
            share = np.concatenate([np.full(len(x), SCALE / max(len(x), 1)) for x in own])
            keys, at = np.unique(np.concatenate(own), return_inverse=True)
            index.append(keys)
            value.append(np.bincount(at, share))
            sizes.append(len(keys))
    return np.concatenate(index), np.concatenate(value), np.concatenate(([0], np.cumsum(sizes)))


def fit(rows: list[tuple], counts: dict) -> Model | None:
    """A calibrated model from (label 0 or 1, text) rows; None unless both labels occur."""
    y = np.array([float(label > 0) for label, _ in rows])
    if len(set(y)) < 2:
        return None
    index, value, first = _sparse([text for _, text in rows])
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    balanced = np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum())
    w = fit_logistic(index, value, first, y, np.where(held, 0, balanced), WIDTH)
    z = np.bincount(np.repeat(np.arange(len(y)), np.diff(first)), value * w[index], minlength=len(y)) + w[-1]
    part = held if held.any() else ~held
    totals = {True: sum(n for k, n in counts.items() if k > 0), False: sum(n for k, n in counts.items() if k <= 0)}
    true = np.where(y > 0, totals[True] / max(y[part].sum(), 1), totals[False] / max((1 - y[part]).sum(), 1))[part]
    a, b = fit_platt(z[part], y[part], true * part.sum() / true.sum())
    return Model(w[:-1].astype(np.float32), float(w[-1]), a, b)


def base_counts(t: A.Texts, w: A.Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules of every text."""

    def total(flag: np.ndarray) -> np.ndarray:
        done = np.concatenate(([0], np.cumsum(flag)))
        return done[t.bounds[1:]] - done[t.bounds[:-1]]

    inside = np.zeros(len(t.buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    letters = (np.cumsum(inside[:-1]) > 0) & ((t.buf & 0xC0) != 0x80)
    dup_lines = []
    for i in range(len(t)):
        seen: set[bytes] = set()
        again = 0
        for line in t.raw(i).split(b"\n"):
            if line.strip():
                if line in seen:
                    again += 1
                seen.add(line)
        dup_lines.append(again)
    runs = A.run_hashes(h, REPEAT)
    own = A.spread(w.first[:-1], np.maximum(w.per_text() - REPEAT + 1, 0))
    covered = np.zeros(len(w) + 1, np.int64)
    if len(own):
        keys = A.mix(runs[own] + A.mix(w.text_of()[own].astype(A.U64) + A.U64(1)))
        _, at, many = np.unique(keys, return_inverse=True, return_counts=True)
        twice = own[many[at] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    return {
        "n_words": w.per_text(), "word_chars": total(letters), "n_symbols": total(_SYMBOL[t.buf]),
        "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": hit[w.first[1:]] - hit[w.first[:-1]],
    }


SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
    "base_failed BOOLEAN, kept BOOLEAN, probability DOUBLE"
)


def verdicts(model: Model | None, threshold: float, t: A.Texts) -> dict[str, pa.Array]:
    w = A.split_words(t)
    h = A.word_hashes(t, w)
    base = base_counts(t, w, h)
    failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
    p = model.probability(t, w, h) if model else np.ones(len(t))
    return {
        **{k: pa.array(v, pa.int64()) for k, v in base.items()}, "base_failed": pa.array(failed),
        "kept": pa.array(~failed & (p >= threshold)), "probability": pa.array(p),
    }


def _judge(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": t.rows.column("doc_id"), **verdicts(model, threshold, t)})

    return run


def judge_quality(
    docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str,
    per_class: int = PER_CLASS, threshold: float = THRESHOLD, max_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and probability of every text."""
    docs = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    labels = labels.select(labels[label_id].alias("doc_id"), labels[label].alias("label"))
    model = fit(*labelled_sample(docs, labels, per_class, max_chars))
    return docs.mapInArrow(_judge(model, threshold), SCHEMA).withColumnRenamed("doc_id", doc_id)


def keep_good(
    docs: DataFrame, text: str, labels: DataFrame, label_id: str, label: str, doc_id: str,
    per_class: int = PER_CLASS, threshold: float = THRESHOLD, max_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """The rows, with all their columns, whose text passes the base rules and the model."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    labels = labels.select(labels[label_id].alias("doc_id"), labels[label].alias("label"))
    model = fit(*labelled_sample(rows, labels, per_class, max_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, text):
            yield t.rows.filter(verdicts(model, threshold, t)["kept"])

    return docs.mapInArrow(run, docs.schema)
