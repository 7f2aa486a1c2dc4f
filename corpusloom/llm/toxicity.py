"""Operator 1: toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

A text is cut into sentences and those into units: words, with spelled-out single letters joined to
one. The kernel of two units compares their subsequences of three letters within a short span;
every skipped character costs a factor, so inserted characters and gaps weaken a match and do not
end it. Figures and signs that stand for letters are read as them, other signs are gaps. Equal units
of a chunk of texts are compared once. A kernel value is taken as a share of the landmark's own, so a
landmark that begins a longer word counts fully, and raised to a power; a sentence's value with a
landmark is that of its most similar unit.

Landmarks are words of labelled texts and beginnings of words: the ones that tell the classes apart
most and are not alike, by rank (those beyond chance first, weaker ones where these are few), and the
harmless words most like them. The Nyström map turns a sentence's kernel values with the landmarks
into features of a linear SVM. Labels are given for texts, so the SVM is trained in rounds: the
sentences of a toxic text that score as toxic, and its highest one in any case, stand for it, against
all sentences of the others. A text scores its highest sentence, as a probability calibrated at the
labels' true proportions.

Defined cases: a null, empty or wordless text scores like a sentence without any match; without
labelled rows of both classes, or any word in them, every score is 0; few toxic labels give weak
landmarks, which the SVM weighs; null labels are not learned from; very long texts
are scored whole; repeated rows are scored each; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .learning import SAMPLE_CHARS, fit_platt, labelled_sample

PER_CLASS = 1_500
TOXIC_LANDMARKS, HARMLESS_LANDMARKS = 40, 16
SPAN = 7  # letters and gaps a subsequence may stretch over
OWN_SPAN = 6  # and in a landmark itself, which leaves room for characters put in
DECAY = 0.85
POWER = 5
RIDGE = 0.1  # on the landmarks' kernel matrix, so that none of its directions is blown up
TELLING = 3.0  # log-likelihood ratio, beyond chance, from which a unit of toxic texts ranks first
PURE = 10  # if it is so many times as often in them as in others
OFTEN = 3  # and in so many of them
EMPTY = 0.5  # weight of a sentence without any match beside all sentences of a class
ALIKE = 0.5  # kernel value from which two landmarks are too alike
CHUNK = 1 << 21
UNITS = 512  # whose subsequences are weighed together
KNOWN_UNITS = 1 << 18  # a task remembers the kernel values of
BLOCK = 400  # candidates for landmarks that are compared at a time

_LETTERS = 64
_SYMBOL = np.zeros(256, np.int32)  # 0: a gap
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27 + np.arange(10)
for _sign, _letter in zip(b"0134578@$!", b"oieastbasi"):  # figures and signs read as letters
    _SYMBOL[_sign] = _letter - 96
_SYMBOL[128:192] = 37 + np.arange(64) % 25  # last byte of a letter beyond ASCII
_START, _END = 63, 62  # stand before (twice) and after every unit: where a match begins and ends counts
_LEAD = np.zeros(256, bool)
_LEAD[192:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass
class Units:
    symbol: np.ndarray  # of every kept byte of all words
    unit: np.ndarray  # its unit
    sentence: np.ndarray  # of every unit
    text: np.ndarray  # of every sentence


def units_of(t: A.Texts) -> Units:
    """Units and sentences of some texts; each text has a sentence, if an empty one."""
    w = A.split_words(t)
    size = w.end - w.start
    at = A.spread(w.start, size)
    word = np.repeat(np.arange(len(w)), size)
    kept = ~_LEAD[t.buf[at]]
    letters = np.bincount(word[kept], minlength=len(w))
    head = np.zeros(len(w), bool)
    head[w.first[:-1][w.per_text() > 0]] = True
    alone = letters == 1
    joined = np.zeros(len(w), bool)
    joined[1:] = alone[1:] & alone[:-1] & ~head[1:]
    unit_of_word = np.cumsum(~joined) - 1
    first_word = np.flatnonzero(~joined)
    # a sentence ends at a closing mark or where a line ends before the next word
    lines = np.concatenate(([0], np.cumsum(t.buf == 10)))
    stop = np.zeros(len(w), bool)
    if len(w):
        closing = _STOP[t.buf[w.end - 1]] & ~alone
        stop[1:] = head[1:] | closing[:-1] | (lines[w.start[1:]] > lines[w.end[:-1]])
        stop[0] = True
    text_of_word = w.text_of()
    empty = np.flatnonzero(w.per_text() == 0)
    starts = stop[first_word]
    sentence = np.cumsum(starts) - 1
    text = np.concatenate((text_of_word[first_word[starts]], empty))
    return Units(*_marked(_SYMBOL[t.buf[at[kept]]], unit_of_word[word[kept]]), sentence, text)


def _marked(symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and units with the marks put in."""
    if not len(unit):
        return symbol, unit
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    ends = np.append(first[1:], len(unit))
    places = np.concatenate((ends, first, first))  # an end comes before the next unit's start
    marks = np.repeat([_END, _START, _START], len(first))
    owners = np.concatenate((unit[ends - 1], unit[first], unit[first]))
    order = np.argsort(places, kind="stable")
    return np.insert(symbol, places[order], marks[order]), np.insert(unit, places[order], owners[order])


WHOLE = b"\x00"  # ends the name of a whole word; other names are beginnings of words


def _named(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bare = [x.removesuffix(WHOLE) for x in names]
    symbol = np.concatenate([_SYMBOL[np.frombuffer(x, np.uint8)] for x in bare])
    symbol, unit = _marked(symbol, np.repeat(np.arange(len(bare)), [len(x) for x in bare]))
    keep = (symbol != _END) | np.array([x.endswith(WHOLE) for x in names])[unit]
    return symbol[keep], unit[keep]


_ANY = np.outer(np.arange(_LETTERS) > 0, np.arange(_LETTERS) > 0).ravel()  # no end is a gap


def triples(symbol: np.ndarray, unit: np.ndarray, span: int = SPAN, known: np.ndarray = _ANY) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(code, unit, weight) of the three-letter subsequences of units whose ends are ``known``, one batch per pair of gaps."""
    for wide in range(2, span):
        n = len(symbol) - wide
        if n <= 0:
            return
        ends = np.flatnonzero(known[symbol[:n] * _LETTERS + symbol[wide:]] & (unit[wide:] == unit[:n]))
        outer = symbol[ends] * (_LETTERS * _LETTERS) + symbol[ends + wide]
        for mid in range(1, wide):
            middle = symbol[ends + mid]
            ok = middle > 0
            yield outer[ok] + middle[ok] * _LETTERS, unit[ends[ok]], DECAY ** (wide - 2)


class Landmarks:
    """Kernel values of units with fixed units."""

    def __init__(self, names: list[bytes], telling: int = 0):
        self.names = names
        self.telling = telling  # the first so many tell toxic texts from others
        symbol, unit = _named(names)
        found: Counter = Counter()
        for code, owner, weight in triples(symbol, unit, OWN_SPAN):
            for c, o in zip(code.tolist(), owner.tolist()):
                found[c, o] += weight
        codes = sorted({c for c, _ in found})
        self.row = np.full(_LETTERS**3, -1, np.int32)
        self.row[codes] = np.arange(len(codes))
        self.ends = np.zeros(_LETTERS * _LETTERS, bool)  # the first and last letters of these codes
        self.ends[[c // _LETTERS**2 * _LETTERS + c % _LETTERS for c in codes]] = True
        self.own = np.zeros((len(codes), len(names)), np.float32)  # weight of each code in each landmark
        for (c, o), weight in found.items():
            self.own[self.row[c], o] = weight
        self.square = np.maximum((self.own**2).sum(0), 1e-9)

    def values(self, symbol: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Kernel values of units 0, 1, ... (rows) with the landmarks."""
        n, many = int(unit[-1]) + 1 if len(unit) else 0, len(self.own)
        total = np.zeros((n, len(self.names)), np.float32)
        ends = np.searchsorted(unit, np.arange(0, n + UNITS, UNITS))
        for lo, a, b in zip(range(0, n, UNITS), ends, ends[1:]):
            cells, parts = [np.zeros(0, np.int64)], [np.zeros(0)]
            for code, owner, weight in triples(symbol[a:b], unit[a:b] - lo, SPAN, self.ends):
                row = self.row[code]
                hit = np.flatnonzero(row >= 0)
                cells.append(owner[hit] * many + row[hit])
                parts.append(np.full(len(hit), weight))
            size = min(UNITS, n - lo)
            met = np.bincount(np.concatenate(cells), np.concatenate(parts), minlength=size * many)
            total[lo : lo + size] = met.reshape(size, many).astype(np.float32) @ self.own
        return np.minimum(total / self.square, 1) ** POWER

    def rows(self, symbol: np.ndarray, unit: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The kernel values of the distinct units, a row each, and every unit's row.

        Equal units are found by a hash, and their symbols are compared.
        """
        if not len(unit):
            return np.zeros((0, len(self.names)), np.float32), np.zeros(0, np.int64)
        start = np.flatnonzero(np.diff(unit, prepend=-1))
        size = np.diff(np.append(start, len(unit)))
        spans = A.Words(start, start + size, np.array([0, len(start)]))
        data = symbol.astype(np.uint8)
        hashes, place, row = np.unique(A.word_hashes(A.Texts(None, data, np.array([0, len(data)])), spans), return_index=True, return_inverse=True)
        if not (np.array_equal(size[place][row], size) and np.array_equal(data[A.spread(start[place][row], size)], data)):
            place, row, known = np.arange(len(start)), np.arange(len(start)), None  # two units of one hash
        start, size = start[place], size[place]
        found = known.find(hashes, size, data[A.spread(start, size)]) if known else np.full(len(place), -1)
        new = np.flatnonzero(found < 0)
        at = A.spread(start[new], size[new])
        values = np.empty((len(place), len(self.names)), np.float32)
        values[new] = self.values(symbol[at], np.repeat(np.arange(len(new)), size[new]))
        if known:
            old = np.flatnonzero(found >= 0)
            values[old] = known.values[found[old]]
            known.add(hashes[new], size[new], data[at], values[new])
        return values, row

    def sentences(self, units: Units, known: Known | None = None) -> np.ndarray:
        """Kernel value of each landmark with the unit of each sentence that is most like it."""
        values, row = self.rows(units.symbol, units.unit, known)
        out = np.zeros((len(units.text), len(self.names)), np.float32)
        if len(row):
            first = np.flatnonzero(np.diff(units.sentence, prepend=-1))
            sentence = units.sentence[first]
            for i, column in enumerate(np.ascontiguousarray(values.T)):  # a landmark's values stay in the cache
                out[sentence, i] = np.maximum.reduceat(column[row], first)
        return out


class Known:
    """Distinct units met before and their kernel values, in the order they came; at most ``KNOWN_UNITS`` and one chunk's."""

    def __init__(self, wide: int):
        self.wide = wide
        self.forget()

    def forget(self) -> None:
        self.hashes, self.size, self.data = np.zeros(0, A.U64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.values, self.order = np.zeros((0, self.wide), np.float32), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The place of every unit, -1 for new ones. Hashes find a unit, and its symbols are compared."""
        place = np.full(len(hashes), -1)
        if not len(self.hashes):
            return place
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=self.order), len(self.order) - 1)]
        met = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == size))
        at = at[met]
        ours = self.data[A.spread((np.cumsum(self.size) - self.size)[at], size[met])]
        theirs = data[A.spread((np.cumsum(size) - size)[met], size[met])]
        if np.array_equal(ours, theirs):  # else two units have one hash: none is taken from here
            place[met] = at
        return place

    def add(self, hashes: np.ndarray, size: np.ndarray, data: np.ndarray, values: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > KNOWN_UNITS:
            self.forget()
        self.hashes, self.size = np.concatenate((self.hashes, hashes)), np.concatenate((self.size, size))
        self.data, self.values = np.concatenate((self.data, data)), np.concatenate((self.values, values))
        self.order = np.argsort(self.hashes, kind="stable")


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray  # of the landmarks' kernel sums: the SVM's weights behind the Nyström map
    intercept: float
    a: float
    b: float

    def margins(self, units: Units, n_texts: int, known: Known | None = None) -> np.ndarray:
        z = self.landmarks.sentences(units, known) @ self.weights + self.intercept
        best = np.full(n_texts, -np.inf)
        np.maximum.at(best, units.text, z)
        return best

    def score(self, t: A.Texts, known: Known | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(units_of(t), len(t), known) + self.b, -40, 40)))


def _chunks(texts: list[str]) -> Iterator[A.Texts]:
    return A.text_chunks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]), "text", CHUNK)


_LEAD_BYTES = bytes(range(192, 256))
HEADS = (4, 5, 6, 7)  # letters of the beginnings of words that may be landmarks


def _unit_names(t: A.Texts) -> list[set[bytes]]:
    """Lower-case words of each text and their beginnings."""
    names = []
    for i in range(len(t)):
        words = {x.strip(b".,;:!?()\"'") for x in set(t.raw(i).lower().translate(None, _LEAD_BYTES).split())}
        words = {x for x in words if 3 <= len(x) <= 24 and not x.isdigit()}
        names.append({x + WHOLE for x in words} | {x[:n] for x in words for n in HEADS if len(x) > n})
    return names


def choose_landmarks(toxic: list[str], other: list[str]) -> Landmarks | None:
    counts = []
    for texts in (toxic, other):
        found: Counter = Counter()
        for t in _chunks(texts):
            for names in _unit_names(t):
                found.update(names)
        counts.append(found)
    a_total, b_total = len(toxic), len(other)

    chance = np.log(max(len(counts[0]), 1))  # what the best of so many reaches by chance

    def told(x: bytes) -> float:
        """How far the classes differ in a unit (log-likelihood ratio), below 0 if others have it more."""
        a, b = counts[0][x], counts[1][x]
        p = (a + b) / (a_total + b_total)
        part = lambda k, n: k * np.log(max(k, 1e-9) / (n * p))
        ratio = float(part(a, a_total) + part(b, b_total))
        return ratio if a / a_total >= b / b_total else -ratio

    def strong(x: bytes) -> bool:
        a, b = counts[0][x], counts[1][x]
        return a >= OFTEN and a / a_total >= PURE * b / b_total and told(x) > chance + TELLING

    order = lambda x: (-told(x), -len(x), x)
    beyond = sorted(filter(strong, counts[0]), key=order)
    known = set(beyond)
    weak = [x for x in counts[0] or counts[1] if x not in known]
    weak = sorted([x for x in weak if told(x) > 0] or (weak if not beyond else []), key=order)
    chosen = unlike(beyond, TOXIC_LANDMARKS)
    telling = len(chosen)
    chosen += unlike(weak, TOXIC_LANDMARKS - len(chosen), chosen)
    if not chosen:
        return None
    telling = telling or len(chosen)  # weak ones tell only where no strong one is
    harmless = [x for x in counts[1] if counts[1][x] >= 3 and x not in counts[0] or counts[1][x] * a_total > 2 * counts[0][x] * b_total]
    near = kernel(chosen, harmless).max(0) if harmless else np.zeros(0)
    ranked = [harmless[i] for i in sorted(range(len(harmless)), key=lambda i: (-near[i], harmless[i]))]
    return Landmarks(chosen + unlike(ranked, HARMLESS_LANDMARKS, both=False), telling)


def unlike(ranked: list[bytes], most: int, others: list[bytes] | None = None, both: bool = True) -> list[bytes]:
    """The first ``most`` of some units that are like none of ``others`` and none before them: as a
    landmark to them and, if ``both``, the other way round."""
    chosen: list[bytes] = []
    for lo in range(0, len(ranked), BLOCK):
        if len(chosen) >= most:
            break
        block = ranked[lo : lo + BLOCK]
        before = [*(others or []), *chosen]
        near, between = kernel(block, before).max(1, initial=0), kernel(block, block)
        if both:
            near, between = np.maximum(near, kernel(before, block).max(0, initial=0)), np.maximum(between, between.T)
        for i, x in enumerate(block):
            if len(chosen) < most and near[i] < ALIKE:
                chosen.append(x)
                near = np.maximum(near, between[:, i])
    return chosen


def kernel(rows: list[bytes], columns: list[bytes]) -> np.ndarray:
    """Kernel values of two lists of units."""
    out = np.zeros((len(rows), len(columns)))
    if not rows or not columns:
        return out
    marks = Landmarks(rows)
    for lo in range(0, len(columns), 5_000):
        part = columns[lo : lo + 5_000]
        out[:, lo : lo + len(part)] = marks.values(*_named(part)).T
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights and, last, intercept of a linear SVM with squared hinge loss; y is 1 or -1."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        slack = np.maximum(1 - y * (x @ w[:-1] + w[-1]), 0) * y * weight
        grad = np.append(-2 * (x.T @ slack) + penalty * w[:-1], -2 * slack.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit(rows: list[tuple], counts: dict, rounds: int = 3) -> Model | None:
    """A model from (label 0 or 1, text) rows; None unless both labels occur with some unit."""
    toxic, other = ([text for label, text in rows if (label > 0) == flag] for flag in (True, False))
    if not toxic or not other:
        return None
    marks = choose_landmarks(toxic, other)
    if marks is None:
        return None
    between = kernel(marks.names, marks.names)
    values, vectors = np.linalg.eigh((between + between.T) / 2 + RIDGE * np.eye(len(between)))
    nystrom = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    raw, text = [], []
    done = 0
    for t in _chunks(toxic + other):
        units = units_of(t)
        raw.append(marks.sentences(units).astype(np.float64))
        text.append(units.text + done)
        done += len(t)
    raw, text = np.concatenate(raw), np.concatenate(text)
    x = raw @ nystrom
    is_toxic = text < len(toxic)
    z = raw[:, : marks.telling].max(1) ** (1 / POWER) - 0.9
    for _ in range(rounds):
        order = np.lexsort((-z, text))
        first = order[np.concatenate(([True], np.diff(text[order]) > 0))]
        stands = z > 0
        stands[first] = True
        use = ~is_toxic | stands
        y = np.where(is_toxic, 1.0, -1.0)[use]
        weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
        # a sentence without any match is harmless, however often the landmarks match
        w = fit_svm(np.vstack((x[use], np.zeros(x.shape[1]))), np.append(y, -1.0), np.append(weight, EMPTY))
        z = x @ w[:-1] + w[-1]
    best = np.full(len(toxic) + len(other), -np.inf)
    np.maximum.at(best, text, z)
    y = (np.arange(len(best)) < len(toxic)).astype(float)
    totals = [sum(n for k, n in counts.items() if (k > 0) == flag) for flag in (True, False)]
    true = np.where(y > 0, totals[0] / len(toxic), totals[1] / len(other))
    a, b = fit_platt(best, y, true * len(y) / true.sum())
    return Model(marks, nystrom @ w[:-1], float(w[-1]), a, b)


SCHEMA = "doc_id BIGINT, score DOUBLE, predicted INT"


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(len(model.landmarks.names)) if model else None
        for t in A.text_chunks(batches, "text", CHUNK):
            score = model.score(t, known) if model else np.zeros(len(t))
            yield pa.RecordBatch.from_arrays(
                [t.rows.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return run


def score_toxicity(
    docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str,
    learn: Column | None = None, per_class: int = PER_CLASS, max_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """doc_id, score and predicted of every text; ``learn`` (over doc_id) selects the rows learned from.

    At most ``per_class`` rows of each label, of at most ``max_chars`` characters, are learned from."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    labels = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("label"))
    model = fit(*labelled_sample(docs, labels, per_class, max_chars, learn))
    return docs.mapInArrow(_score(model), SCHEMA).withColumnRenamed("doc_id", doc_id)
