"""Operator 11 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 4), (5, 7, 9), (70, 65, 67), (33, 200, 129)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    for most in (256, 2**27):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (hn.strassen(a, b, leaf=4) == a @ b).all()
    a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-1, 2, (k, n))  # sums on the way wrap
    with np.errstate(over="ignore"):
        assert (hn.strassen(a, b, leaf=2) == a @ b).all()


def brute(rows, every=50, positives=5, negatives=3):
    """rows of (id, label, vector)."""
    good = [
        (n, i, label, [int(np.floor(256 * float(x))) for x in v]) for n, (i, label, v) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, i, label, v in good:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, l == label) for m, j, l, w in good if m != n]
        for p in sorted([s for s in scored if s[2]], key=key)[:positives]:
            inside = [s for s in scored if not s[2] and 50 * p[0] <= 100 * s[0] <= 95 * p[0]]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(sorted(inside, key=key)[:negatives], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>").withColumns({c: F.lit("x") for c in ("_row", "_q", "_id", "rank", "anchor_id")})
    found = hn.mine_hard_negatives(df, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0, **kw)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(n, seed, labels=3, width=6, steps=4):
    """Coarse components, so scores tie often; one label holds most rows."""
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 0.5 else rng.randrange(labels), [rng.randrange(-1, steps) / steps for _ in range(width)]) for i in range(n)]


def test_equals_brute_force_with_ties_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_BLOCK", 40)
    monkeypatch.setattr(hn, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    rows = vectors(400, 1)
    assert mined(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    rows = vectors(120, 2) + [
        (200, None, [0.5] * 6), (201, 0, None), (202, 0, [0.5, None]), (203, 0, [float("nan")]), (204, 1, [float("inf")]),
        (50, 0, [0.25] * 6), (50, 0, [0.25] * 6), (None, 0, [0.75] * 6), (None, 1, [0.25] * 6), (250, 2, []), (251, 2, [0.5, 0.5]),
        (300, 9, [0.5] * 6), (350, -1, [0.5] * 9),
    ]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [0.5])]) == []


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(50, 1, [1e12]), (51, 1, [1.0])])
