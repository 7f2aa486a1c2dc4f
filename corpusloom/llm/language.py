"""Operator 9: language by the nearest of several centroids per language.

A text is the vector of its hashed byte n-grams (1 to 3, letters A-Z lowered, everything that is
neither a letter nor above ASCII read as one space), weighted by inverse document frequency and of
length 1. Document frequencies are counted over all learning rows. The vectors of a bounded sample of
each language are clustered (spherical k-means) and a text takes the language of the centroid with
the largest cosine. ``rejected`` marks texts farther from their centroid than nearly all sample rows
of that language are; the label stands, so a caller decides what to do with them.

Defined cases: a null text or one without a letter is 'und' with score 0; rows without id or language
teach nothing; without any learning rows all texts are 'und'; ties go to the language first in the
alphabet; very long texts are read whole; repeated rows are labelled each; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .learning import SAMPLE_CHARS, labelled_sample

BITS = 12
PER_LANGUAGE = 400
CENTROIDS = 4
ROWS = 256  # texts whose counts, 2^BITS figures each, are held at a time
REJECT = 0.005  # share of a language's sample rows that lie beyond its distance bound

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def counts(t: A.Texts) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    width = 1 << BITS
    data = _CLEAN[t.buf].astype(np.uint32)
    sizes = np.diff(t.bounds)
    row = np.repeat(np.arange(len(t), dtype=np.int64) * width, sizes)
    out = np.zeros(len(t) * width, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        m = max(len(data) - n + 1, 0)
        code = code[:m] * np.uint32(257) + data[n - 1 :][:m]
        own = np.ones(m, bool)  # inside one text
        for edge in t.bounds[1:-1]:
            own[max(edge - n + 1, 0) : edge] = False
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out += np.bincount((row[:m] + bucket)[own], minlength=len(out))
    return out.reshape(len(t), width)


def has_letter(t: A.Texts) -> np.ndarray:
    plain = np.concatenate(([0], np.cumsum((_CLEAN[t.buf] != 0x20) & (t.buf < 128))))
    found = plain[t.bounds[1:]] > plain[t.bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in t.raw(i).decode())
    return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: rows and document frequencies."""
    rows, df = 0, np.zeros(1 << BITS, np.int64)
    for t in A.text_chunks(batches, "text", rows=ROWS):
        rows += len(t)
        df += (counts(t) > 0).sum(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([rows], pa.int64()), A.list_array(df, np.array([len(df)]), pa.int64())], ["rows", "df"]
    )


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln(rows / document frequency) of every bucket over all rows."""
    parts = docs.select("text").mapInArrow(_frequencies, "rows BIGINT, df ARRAY<BIGINT>")
    width = 1 << BITS
    # one row of fixed width, added up in the cluster
    places = parts.select("rows", F.posexplode("df").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    idf = np.zeros(width)
    for r in places.collect():
        idf[r["at"]] = np.log((1 + r["rows"]) / (1 + r["n"]))
    return idf


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray  # index of each centroid's language
    names: list[str]
    bound: np.ndarray  # least cosine of each language

    def vectors(self, t: A.Texts) -> np.ndarray:
        x = np.log1p(counts(t)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def nearest(self, t: A.Texts) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(t) @ self.centroids.T
        best = cosine.argmax(1)
        return self.language[best], np.clip(cosine[np.arange(len(t)), best], 0, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """At most k unit centroids of unit rows; seeds are taken farthest first from the mean's nearest."""
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(1)
        near[seeds] = np.inf
        seeds.append(int(near.argmin()))
    centroids = x[seeds]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == i].sum(0) if (own == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(rows: list[tuple], idf: np.ndarray, k: int = CENTROIDS) -> Model | None:
    """Centroids from (language, text) rows."""
    if not rows:
        return None
    names = sorted({name for name, _ in rows})
    model = Model(idf, np.zeros((0, len(idf))), np.zeros(0, np.int64), names, np.zeros(len(names)))
    centroids, language = [], []
    for i, name in enumerate(names):
        texts = pa.record_batch({"text": pa.array([text for own, text in rows if own == name], pa.string())})
        x = np.concatenate([model.vectors(t) for t in A.text_chunks(iter([texts]), "text", rows=ROWS)])
        own = cluster(x, k)
        model.bound[i] = np.quantile((x @ own.T).max(1), REJECT)
        centroids.append(own)
        language += [i] * len(own)
    model.centroids, model.language = np.concatenate(centroids), np.array(language)
    return model


SCHEMA = "doc_id BIGINT, lang_pred STRING, score DOUBLE, rejected BOOLEAN"


def _label(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text", rows=ROWS):
            known = has_letter(t) if model else np.zeros(len(t), bool)
            which, score = model.nearest(t) if model else (np.zeros(len(t), np.int64), np.zeros(len(t)))
            names = [model.names[i] if ok else "und" for i, ok in zip(which, known)]
            far = ~known | (score < model.bound[which] if model else True)
            yield pa.RecordBatch.from_arrays(
                [t.rows.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def identify(
    docs: DataFrame, doc_id: str, text: str, lang: str, learn: Column | None = None,
    per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, max_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected; learned from the rows that ``learn`` selects, centroids from
    at most ``per_language`` of each language, of at most ``max_chars`` characters."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    taught = rows.filter("label IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    if learn is not None:
        taught = taught.filter(learn)
    sample, _ = labelled_sample(taught, taught, per_language, max_chars)
    model = fit(sample, inverse_frequencies(taught), centroids) if sample else None
    return rows.select("doc_id", "text").mapInArrow(_label(model), SCHEMA).withColumnRenamed("doc_id", doc_id)
