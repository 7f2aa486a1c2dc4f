"""Text embedding by a caller's encoder (H1)."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import WORD_PATTERN
from ..sizing import spread

Encoder = Callable[[list[str]], np.ndarray]


class HashedWords:
    """Stand-in encoder where no sentence model is at hand: word counts in ``dim`` hashed slots.

    Every distinct word of a batch is hashed once and all counts come from one array operation.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._words = re.compile(WORD_PATTERN)

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [self._words.findall(text.lower()) for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        which, distinct = pd.factorize(np.array([*chain.from_iterable(found)], dtype=object))
        slots = np.array([int(md5(word.encode()).hexdigest()[:6], 16) % self.dim for word in distinct], np.int64)
        cells = row * self.dim + (slots[which] if len(slots) else 0)
        return np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)


def embed(
    df: DataFrame, text_col: str, make_encoder: Callable[[], Encoder] = HashedWords,
    batch_size: int = 64, out: str = "embedding",
) -> DataFrame:
    """H1: unit-length float vectors; the encoder is made once per Python process, NULL text is ''."""

    def make():
        encoder = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            m = np.asarray(encoder(texts.tolist()), dtype=np.float64)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0).astype(np.float32)

        return predict

    encode = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    # Marked non-deterministic, a filter on the vectors does not run the encoder a second time.
    return spread(df).withColumn(out, encode.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
