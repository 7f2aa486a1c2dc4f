"""Operator 5: information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers, found by fixed
rules. The corpus then says which other terms give them away. A place of a term is a distinct context,
the term with ``REACH`` words on either side, so copies of a text neither prove nor hide anything;
p(e | t) is the share of a term's places that lie within ``REACH`` words of the entity e, and

    -log2 p(e | t)

the bits of e that stay unknown where t is read. Terms that leave at most ``GENERALISE`` bits of some
entity are replaced by a placeholder wherever they stand, and those that leave at most ``REMOVE`` bits
are taken out. p(e | t) is the lower end of Wilson's interval, so a meeting or two, which any rare word
has by chance, leave too much unknown: three distinct contexts, all next to the entity, are the least
that disclose it. Text without the term changes no verdict on it, so verdicts do not depend on the
size of the corpus.

The corpus is read three times: for what stands next to entities, for the places of the terms that
could disclose one (a term that alone in one task has too many is out, and sends one row), and for
the places of the terms that do. Terms are looked up by a table of fixed size under their hash; rows
that it lets through wrongly fall in the join behind it.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds are all
reported and redacted once, under the kind listed first; rows are told apart by their text, so null
and repeated ids change nothing; words are compared with A-Z lowered; an empty table gives an empty
result; carried columns may have any names, and those named like a result column are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from ..sizing import broadcast_if_small
from . import arrays as A

KINDS = ["email", "ip", "card", "phone", "term", "removed_term"]
REACH = 5
SURE = 1.645  # standard errors p(e | t) is lowered by for: one-sided 95 %
GENERALISE, REMOVE = 1.0, 0.3219280948873623  # bits left: p(e | t) of a half and of four fifths
SLOTS = 1 << 18  # of the table terms are looked up in
HELD = 500_000  # places a task holds before it gives them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            yield "email", lo, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start."""
    spans = list(_emails(text))
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


_TERM = np.ones(256, bool)  # bytes outside of words
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Terms:
    """The words of some texts: their hashes, and of any place the hash of its context."""

    def __init__(self, t: A.Texts, reach: int):
        self.t, self.reach = t, reach
        self.words = A.split_words(t, _TERM)
        self.hashes = A.word_hashes(t, self.words, A.LOWER)
        self.text = self.words.text_of()

    def windows(self, places: np.ndarray) -> np.ndarray:
        total = np.zeros(len(places), np.uint64)
        first, last = self.words.first[:-1][self.text[places]], self.words.first[1:][self.text[places]]
        for step, factor in zip(range(-self.reach, self.reach + 1), A.constants(2 * self.reach + 1)):
            at = places + step
            inside = (at >= first) & (at < last)
            total[inside] += self.hashes[at[inside]] * factor
        return A.mix(total)

    def word(self, place: int) -> str:
        raw = self.t.buf[self.words.start[place] : self.words.end[place]]
        return A.LOWER[raw].tobytes().decode()


def beside(terms: Terms, i: int, reach: int) -> Iterator[tuple[str, np.ndarray]]:
    """(kind:value, places of the words next to it) of each base span of text i; words inside spans do not count."""
    raw = terms.t.raw(i)
    text = raw.decode()
    spans = sorted({(lo, hi, kind) for kind, lo, hi in base_spans(text)})
    if not spans:
        return
    place = np.arange(len(text) + 1) if len(text) == len(raw) else np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
    lo, hi = terms.words.first[i], terms.words.first[i + 1]
    start, end = (x[lo:hi] - terms.t.bounds[i] for x in (terms.words.start, terms.words.end))
    free = np.ones(hi - lo, bool)
    for first, last, _ in spans:
        free[np.searchsorted(end, place[first], "right") : np.searchsorted(start, place[last])] = False
    free = np.flatnonzero(free)
    for first, last, kind in spans:
        k = int(np.searchsorted(start[free], place[first]))
        yield f"{kind}:{text[first:last].lower()}", lo + free[max(k - reach, 0) : k + reach]


PAIRS = "entity STRING, key BIGINT, term STRING, place BIGINT"
_PAIRS = pa.schema([("entity", pa.string()), ("key", pa.int64()), ("term", pa.string()), ("place", pa.int64())])


def _pairs(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "text"):
            terms = Terms(t, reach)
            entity, places = [], []
            for i in range(len(t)):
                for name, near in beside(terms, i, reach):
                    entity += [name] * len(near)
                    places.append(near)
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(entity, pa.string()), pa.array(A.as_long(terms.hashes[at])),
                pa.array([terms.word(k) for k in at.tolist()], pa.string()), pa.array(A.as_long(terms.windows(at))),
            ], schema=_PAIRS)

    return run


def _places(reach: int, most: np.ndarray):
    """(key, place) of the terms in the table; of a term with more places than ``most`` says, one row without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        out: set[int] = set()

        def flush() -> pa.RecordBatch:
            key = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
            place = np.array([p for x in held.values() for p in x], np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place)], ["key", "place"])

        n = 0
        for t in A.text_chunks(batches, "text"):
            terms = Terms(t, reach)
            at = np.flatnonzero(most[terms.hashes & np.uint64(SLOTS - 1)])
            keys, windows = A.as_long(terms.hashes[at]), A.as_long(terms.windows(at))
            both = np.unique(np.stack((keys, windows), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            for key, window in both.tolist():
                if key not in out:
                    found = held.setdefault(key, set())
                    found.add(window)
                    if len(found) > most[key & (SLOTS - 1)]:
                        out.add(key)
                        del held[key]
            n += len(both)
            if n > HELD:
                yield flush()
                n = 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.nulls(len(out), pa.int64())], ["key", "place"])

    return run


def table_of(terms: DataFrame, most: Column) -> np.ndarray:
    """Largest value of ``most`` under each slot of the terms' keys; 0 where there is none. At most SLOTS figures come to the driver."""
    rows = terms.groupBy(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).agg(F.max(most.cast("int")).alias("most")).toPandas()
    out = np.zeros(SLOTS, np.int32)
    out[rows["slot"].to_numpy(np.int64)] = rows["most"].to_numpy(np.int64)
    return out


def sure_share(together: Column, places: Column) -> Column:
    """Lower end of Wilson's interval of together / places."""
    n = places.cast("double")
    share, z2 = together / n, SURE**2
    return (share + z2 / (2 * n) - F.sqrt(z2 * (share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)


def disclosing_terms(docs: DataFrame, text: str, reach: int = REACH, most_bits: float = GENERALISE) -> DataFrame:
    """(key, term, bits): terms that leave at most ``most_bits`` of some entity, and what they leave of the entity they disclose most."""
    docs = docs.select(F.col(text).alias("text"))
    near = cut_lineage(docs.mapInArrow(_pairs(reach), PAIRS), "contexts")
    pairs = near.groupBy("entity", "key", "term").agg(F.count_distinct("place").alias("together"))
    terms = pairs.groupBy("key", "term").agg(F.max("together").alias("together"))
    bits = lambda places: -F.log2(sure_share(F.col("together"), F.greatest(places, F.col("together"))))
    # All of a term's places next to the entity is the most it can disclose; at least a share of 2**-bits must be.
    terms = cut_lineage(terms.filter(bits(F.col("together")) <= most_bits), "candidates")
    most = table_of(terms, F.ceil(F.col("together") * 2.0**most_bits) + 1)
    if not most.any():
        return terms.select("key", "term", F.lit(0.0).alias("bits")).limit(0)
    met = docs.mapInArrow(_places(reach, most), "key BIGINT, place BIGINT")
    places = met.groupBy("key").agg(F.count_distinct("place").alias("places"), F.count_if(F.col("place").isNull()).alias("over"))
    told = terms.join(places.filter("over = 0"), "key").select("key", "term", bits(F.col("places")).alias("bits"))
    return told.filter(F.col("bits") <= most_bits)


def _marks(slots: np.ndarray):
    """Every place of the words whose key's slot is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "_text"):
            terms = Terms(t, 0)
            at = np.flatnonzero(slots[terms.hashes & np.uint64(SLOTS - 1)])
            row = pa.array(terms.text[at])
            yield pa.RecordBatch.from_arrays([
                t.rows.column("_tid").take(row), t.rows.column("_size").take(row), pa.array((at - terms.words.first[terms.text[at]]).astype(np.int32)),
                pa.array(A.as_long(terms.hashes[at])), pa.array([terms.word(k) for k in at.tolist()], pa.string()),
            ], ["_tid", "_size", "_pos", "key", "term"])

    return run


def _spans_of(text: str, terms: list[int], gone: list[int]) -> list[Span]:
    """Base spans and those of the words with the given numbers, in the kinds' order."""
    spans = base_spans(text)
    if terms or gone:
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        for kind, numbers in (("term", terms), ("removed_term", gone)):
            spans += [(kind, *places[n]) for n in sorted(numbers)]
    return spans


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets, removed terms by nothing; overlaps count once."""
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    out, done = [], 0
    for kind, lo, hi in order:
        if lo < done:
            if hi > done:  # the rest of an overlapping span goes with it
                done = hi
            continue
        out.append(text[done:lo])
        out.append("" if kind == "removed_term" else f"[{kind.upper()}]")
        done = hi
    return "".join(out) + text[done:]


FOUND = "n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_spans STRING, spans STRING, redacted STRING"


def _find(with_text: bool):
    """The other columns of the rows, and what is found in _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, "_text"):
            terms, gone = (t.rows.column(c).to_pylist() for c in ("_terms", "_gone"))
            null = t.rows.column("_text").is_null().to_pylist()
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "redacted")}
            for i in range(len(t)):
                text = t.raw(i).decode()
                spans = _spans_of(text, terms[i] or [], gone[i] or [])
                base = [s for s in spans if s[0] in KINDS[:4]]
                for kind in KINDS[:4]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in base))
                out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                out["redacted"].append(None if null[i] or not with_text else redact(text, spans))
            kinds = {k: pa.int64() if k.startswith("n_") else pa.string() for k in out}
            kept = t.rows.drop_columns(["_text", "_terms", "_gone"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(v, kinds[k]) for k, v in out.items()]], [*kept.schema.names, *out]
            )

    return run


def sanitise(
    docs: DataFrame, text: str, carry: list[str], with_text: bool = True, reach: int = REACH,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """The columns ``carry``, then counts by kind, base_spans, spans ("kind:start:end" joined by
    commas) and, if asked, redacted (the sanitised text; null stays null). ``generalise`` and
    ``remove`` are the most bits of an entity that a term may leave unknown."""
    found = [part.split(" ") for part in FOUND.split(", ")]
    carry = [c for c in carry if c not in {name for name, _ in found}]
    filled = F.coalesce(F.col(text), F.lit(""))
    held = F.struct(*carry) if carry else F.struct(F.lit(0).alias("_none"))
    docs = docs.select(held.alias("_carry"), F.col(text).alias("_text"), F.xxhash64(filled).alias("_tid"), F.octet_length(filled).alias("_size"))
    told = cut_lineage(disclosing_terms(docs, "_text", reach, generalise), "disclosing")
    told = told.select("key", "term", (F.col("bits") <= remove).alias("_out"))
    slots = table_of(told, F.lit(1)) > 0
    if slots.any():
        met = docs.select("_tid", "_size", "_text").mapInArrow(_marks(slots), "_tid BIGINT, _size INT, _pos INT, key BIGINT, term STRING")
        met = met.join(broadcast_if_small(told), ["key", "term"]).select("_tid", "_size", "_pos", "_out").distinct()
        places = met.groupBy("_tid", "_size").agg(
            F.collect_list(F.when(~F.col("_out"), F.col("_pos"))).alias("_terms"), F.collect_list(F.when(F.col("_out"), F.col("_pos"))).alias("_gone")
        )
        docs = docs.join(broadcast_if_small(cut_lineage(places, "places")), ["_tid", "_size"], "left")
    else:
        docs = docs.withColumns({c: F.lit(None).cast("array<int>") for c in ("_terms", "_gone")})
    facts = docs.select("_carry", "_text", "_terms", "_gone")
    schema = facts.select("_carry").schema
    for name, kind in found:
        schema = schema.add(name, kind.lower().replace("bigint", "long"))
    return facts.mapInArrow(_find(with_text), schema).select(*[F.col("_carry").getField(c).alias(c) for c in carry], *[name for name, _ in found])
