"""Operator 13 against brute force."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from corpusloom.llm import spelling as sp


def plain_words(rows, least=5, count=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()))


def found(df):
    return sorted(tuple(r) for r in sp.spelling_variants(df, "doc_id", "text").select("word", "n", "n_near", "form", "form_n", "root").collect())


def noisy(n=300, seed=3):
    """Words of few letters with typos of all kinds, so neighbours, ties and chains are many."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcÀé", k=rng.randrange(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = list(rng.choice(base[: rng.choice([3, 10, 43])]))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["b"], [w[at], "a"], [w[at].upper()]])
            words.append("".join(w))
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    for i, chain in enumerate(("mnopqrstu", "ÀbcdefÀ", "zyxwvu")):  # each word a third as frequent as the one before, one letter longer
        rows.append((1000 + i, " ".join(" ".join([chain + "qéb"[:k]] * (5 * 3 ** (3 - k))) for k in range(4))))
    return rows


def test_variants_equal_brute_force(make):
    rows = noisy()
    want = brute(rows)
    assert found(make(rows, ("word", "n", "rank", "root"))) == want
    assert max(n for _, n, *_ in want) > 100 and sum(w[3] is not None and w[5] != w[3] for w in want) > 3


def test_odd_rows(make, odd_rows, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 64)
    monkeypatch.setattr(sp, "FLUSH", 5)
    long = "x" * 5_000
    rows = odd_rows + [(None, "without an identity " * 3)] * 2 + [(20, f"{long} {long}a {long}b"), (21, f"{long} {long}a"), (22, f"{long} {long}a"), (23, f"{long[1:]} " * 3)]
    assert found(make(rows)) == brute(rows) != []
    assert found(make([])) == []


@given(st.lists(st.text("abÿ", min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
@settings(max_examples=200, deadline=None)
def test_pair_rows_name_exactly_the_neighbours(words):
    owner, kind, before, behind = sp.pair_rows(words)
    rows = list(zip(owner.tolist(), kind.tolist(), zip(before.tolist(), behind.tolist())))
    seen = Counter()
    for a, k, key in rows:
        for b, l, other in rows:
            if a != b and key == other and (k != sp.SPLIT and l != sp.SPLIT and a < b or k == sp.SPLIT and l == sp.FIRST):
                seen[tuple(sorted((a, b)))] += 1
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_apart(words[i], words[j])}
    assert set(seen) == want and all(n == 1 for n in seen.values())


def test_false_agreement_of_numbers_is_no_neighbour(spark):
    words = spark.createDataFrame([(0, "aaaaa"), (1, "aaaab"), (2, "zzzzz")], "rank BIGINT, word STRING")
    agreed = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a BIGINT, b BIGINT")
    assert [tuple(r) for r in sp.confirmed(agreed, words).collect()] == [(0, 1)]
