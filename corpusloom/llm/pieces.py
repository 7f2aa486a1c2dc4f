"""Operator 2: encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces' bytes drives a Viterbi pass: at each byte the state's
output links are followed, from the longest piece that ends there to the shortest, and each relaxes
the best score up to that place. Characters that no piece covers fall back to byte pieces. White
space is the pieces' own: a text gets one space in front, and a space stands for the piece sign. As
no piece goes on past a space that follows another character, a text falls apart there into
stretches whose best segmentations are independent; equal stretches are encoded once.

The pass runs over all new stretches of a chunk at once, one byte place at a time; a very long stretch
has a pass of its own that keeps only the scores a piece can reach back to. Stretches are known by a
hash; as their ids decode to the very bytes, each chunk is decoded and compared, and encoded anew
without that knowledge should it differ. Encoding
maximises the sum of the model's scores, whatever algorithm the model was trained for; the model is
read, never trained. Decoding returns the text exactly, the piece sign itself and control
characters included.

Defined cases: a null text gives null pieces and a null decoding; an empty text gives no pieces; a
text of spaces is encoded like any other; unknown or out-of-range ids in decoding raise an error;
repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays as A

SPACE = 0x20
FALLBACK = -1e5  # for a byte without a piece: below any sum of scores worth having
CACHE_STRETCHES = 150_000  # of an executor's Python process; beyond it the cache starts anew
LONG = 4_096  # bytes from which a stretch has a pass of its own
CELLS = 1 << 20  # places of one Viterbi group


class Automaton:
    """Dense transitions over the bytes that occur in pieces, and output links."""

    def __init__(self, pieces: list[tuple[bytes, int, float]]):
        used = sorted({b for piece, _, _ in pieces for b in piece})
        self.symbol = np.zeros(256, np.int32)  # 0: in no piece
        self.symbol[used] = np.arange(1, len(used) + 1)
        child: dict[int, int] = {}  # (state, byte) as one number
        parent, byte, depth = [0], [0], [0]
        ends: dict[int, tuple[int, int, float]] = {}
        for piece, number, score in pieces:
            node = 0
            for b in piece:
                nxt = child.get(node << 8 | b)
                if nxt is None:
                    nxt = child[node << 8 | b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    depth.append(depth[node] + 1)
                node = nxt
            if node not in ends or ends[node][2] < score:
                ends[node] = (number, len(piece), score)
        n = len(parent)
        parent, depth = np.array(parent, np.int32), np.array(depth, np.int32)
        symbol = self.symbol[np.array(byte, np.uint8)]
        self.next = np.zeros((n, len(used) + 1), np.uint16 if n < 1 << 16 else np.int32)
        self.piece = np.full(n, -1, np.int32)
        self.size = np.zeros(n, np.int32)
        self.score = np.zeros(n, np.float64)
        for node, (number, size, score) in ends.items():
            self.piece[node], self.size[node], self.score[node] = number, size, score
        self.longest = int(self.size.max())
        self.link = np.zeros(n, np.int32)  # next shorter piece that ends where this state does
        fail = np.zeros(n, np.int32)
        for level in range(depth.max() + 1):  # a state's fail state is of a level before, so complete
            here = np.flatnonzero(depth == level)
            if level:
                f = fail[here]
                self.link[here] = np.where(self.piece[f] >= 0, f, self.link[f])
                self.next[here] = self.next[f]
            below = np.flatnonzero(depth == level + 1)
            fail[below] = self.next[parent[below], symbol[below]]
            self.next[parent[below], symbol[below]] = below
        #: the first state with a piece on the way from each state, 0 if there is none
        self.first = np.where(self.piece >= 0, np.arange(n, dtype=np.int32), self.link)


class Decoder:
    """The bytes of a model's pieces."""

    def __init__(self, model: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_ids = np.full(256, -1, np.int32)
        text: list[bytes] = []
        self.pieces = []
        for i in range(processor.get_piece_size()):
            name = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                text.append(bytes([value]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                text.append(b"")
            else:
                raw = name.replace("▁", " ").encode()
                text.append(raw)
                if re.fullmatch(r" *[^ ]+| +", name.replace("▁", " ")) is None:
                    raise ValueError(f"piece {name!r} goes on past a space")
                self.pieces.append((raw, i, processor.get_score(i)))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.sizes = np.array([len(x) for x in text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, one after the other, and their sizes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id is outside of the model")
        sizes = self.sizes[ids]
        return self.flat[A.spread(self.starts[ids], sizes)], sizes

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, and their sizes."""
        data, sizes = self.raw(ids)
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.concatenate(([0], np.cumsum(count)))
        per_text = total[ends[1:]] - total[ends[:-1]]
        filled = per_text > 0  # the space in front goes
        keep = np.ones(len(data), bool)
        keep[total[ends[:-1]][filled]] = False
        return data[keep], per_text - filled


class Coder(Decoder):
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        super().__init__(model)
        self.automaton = Automaton(self.pieces)
        self.pieces = []
        self.known: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _viterbi(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of similar size, one after the other, and their counts."""
        auto, n, longest = self.automaton, len(start), int(size.max())
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((longest + 1, n), np.int32)  # the piece that ends here; -1: one byte
        state = np.zeros(n, np.int32)
        for at in range(longest):
            live = np.flatnonzero(size > at)
            data = buf[start[live] + at]
            state[live] = auto.next[state[live], auto.symbol[data]]
            top = best[at, live] + FALLBACK
            who = np.full(len(live), -1, np.int32)
            idx, out = np.arange(len(live)), auto.first[state[live]]
            on = out > 0
            idx, out = idx[on], out[on]
            while len(idx):  # the output links, longest piece first
                score = best[at + 1 - auto.size[out], live[idx]] + auto.score[out]
                better = score > top[idx]
                top[idx[better]] = score[better]
                who[idx[better]] = auto.piece[out[better]]
                out = auto.link[out]
                on = out > 0
                idx, out = idx[on], out[on]
            best[at + 1, live] = top
            back[at + 1, live] = who
        at, ends, owners = size.copy(), [], []
        live = np.flatnonzero(at > 0)
        while len(live):
            piece = back[at[live], live]
            byte = piece < 0
            ids = np.where(byte, self.byte_ids[buf[start[live] + at[live] - 1]], piece)
            ends.append(ids)
            owners.append(live)
            at[live] -= np.where(byte, 1, self.sizes[ids])
            live = live[at[live] > 0]
        owner = np.concatenate(owners)[::-1]
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ends)[::-1][order], np.bincount(owner, minlength=n)

    def _long(self, data: bytes) -> np.ndarray:
        """Ids of one stretch."""
        auto = self.automaton
        width, window = auto.next.shape[1], auto.longest + 1
        nxt, symbol = memoryview(auto.next.ravel()), auto.symbol.tolist()
        first, link, size, score, piece = (memoryview(x) for x in (auto.first, auto.link, auto.size, auto.score, auto.piece))
        best = [0.0] * window  # of the last places
        back = array("i", bytes(4 * (len(data) + 1)))
        state = 0
        for at, byte in enumerate(data, 1):
            state = nxt[state * width + symbol[byte]]
            top, who, out = best[(at - 1) % window] + FALLBACK, -1, first[state]
            while out:
                found = best[(at - size[out]) % window] + score[out]
                if found > top:
                    top, who = found, piece[out]
                out = link[out]
            best[at % window], back[at] = top, who
        ids, at, sizes, single = array("i"), len(data), self.sizes.tolist(), self.byte_ids.tolist()
        while at:
            who = back[at]
            ids.append(who if who >= 0 else single[data[at - 1]])
            at -= sizes[who] if who >= 0 else 1
        return np.array(ids, np.int32)[::-1]

    def _learn(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            limit = max(1, CELLS // (int(size[order[lo]]) * 2 + 8))
            while hi < len(order) and hi - lo < limit and size[order[hi]] <= max(2 * size[order[lo]], 8):
                hi = min(len(order), lo + limit, int(np.searchsorted(size[order], max(2 * size[order[lo]], 8), "right")))
            if size[order[lo]] > LONG:
                hi = lo + 1
            part = order[lo:hi]
            if hi == lo + 1 and size[part[0]] > LONG:
                ids = self._long(buf[start[part[0]] : start[part[0]] + size[part[0]]].tobytes())
                count = np.array([len(ids)])
            else:
                ids, count = self._viterbi(buf, start[part], size[part])
            need = self.used + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(need, len(self.ids)), np.int32)))
            base = len(self.known)
            if base + len(part) > len(self.first):
                grow = max(len(part), len(self.first))
                self.first, self.count = (np.concatenate((x, np.zeros(grow, np.int64))) for x in (self.first, self.count))
            self.ids[self.used : need] = ids
            self.first[base : base + len(part)] = self.used + np.cumsum(count) - count
            self.count[base : base + len(part)] = count
            self.known.update(zip(key[part].tolist(), range(base, base + len(part))))
            self.used = need
            lo = hi

    def encode(self, t: A.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their counts."""
        ids, count = self._encode(t)
        if not np.array_equal(self.decode(ids, count)[0], t.buf):  # two stretches of one hash
            self._reset()
            ids, count = self._encode(t, known=False)
            self._reset()
        return ids, count

    def _encode(self, t: A.Texts, known: bool = True) -> tuple[np.ndarray, np.ndarray]:
        n = len(t)
        sizes = np.diff(t.bounds)
        filled = sizes > 0
        first = t.bounds[:-1] + np.cumsum(filled) - filled  # of each text behind its space
        buf = np.full(int(sizes.sum() + filled.sum()), SPACE, np.uint8)
        buf[A.spread(first + filled, sizes)] = t.buf
        ends = np.concatenate((first, [len(buf)]))
        space = buf == SPACE
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first[filled]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.concatenate((start, [len(buf)])))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        stretches = A.Words(start, start + size, np.searchsorted(start, ends))
        hashes = A.word_hashes(A.Texts(t.rows, buf, ends), stretches) if known else np.arange(len(start), dtype=np.uint64)
        keys, where, slot = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > CACHE_STRETCHES:
            self._reset()
        listed = keys.tolist()
        new = np.array([i for i, key in enumerate(listed) if key not in self.known], np.int64)
        if len(new):
            self._learn(buf, start[where[new]], size[where[new]], keys[new])
        rows = np.array([self.known[key] for key in listed], np.int64)[slot]
        count = self.count[rows]
        ids = self.ids[A.spread(self.first[rows], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[stretches.first[1:]] - total[stretches.first[:-1]]


@lru_cache(maxsize=2)
def coder(model: str) -> Coder:
    return Coder(model)


@lru_cache(maxsize=2)
def decoder(model: str) -> Decoder:
    return Decoder(model)


def _lists(null: np.ndarray, ids: np.ndarray, count: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate((null, [False]))), pa.array(ids, pa.int32()))


def _encode(model: str, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, column):
            ids, count = coder(model).encode(t)
            null = t.rows.column(column).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*t.rows.columns, _lists(null, ids, count)], [*t.rows.schema.names, name])

    return run


def _checked(model: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.text_chunks(batches, column):
            ids, count = coder(model).encode(t)
            data, sizes = coder(model).decode(ids, count)
            ends, raw = np.concatenate(([0], np.cumsum(sizes))).tolist(), data.tobytes()
            null = t.rows.column(column).is_null().to_numpy(zero_copy_only=False)
            sums = [None if null[i] else sha256(raw[ends[i] : ends[i + 1]]).hexdigest() for i in range(len(sizes))]
            kept = t.rows.drop_columns([column])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, _lists(null, ids, count), pa.array(count, pa.int64()), pa.array(sums, pa.string())],
                [*kept.schema.names, "ids", "n_tokens", "text_sha256"],
            )

    return run


def _decode(model: str, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                lists = rows.column(column)
                null = lists.is_null().to_numpy(zero_copy_only=False)
                count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, sizes = decoder(model).decode(lists.flatten().to_numpy(zero_copy_only=False), count)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                raw = data.tobytes()
                texts = [None if null[i] else raw[ends[i] : ends[i + 1]].decode() for i in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, name])

    return run


def encode(df: DataFrame, text: str, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of a text column as an array column, in place of a column of that name."""
    kept = df.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(_encode(model, text, ids), schema)


def encode_checked(df: DataFrame, text: str, model: str) -> DataFrame:
    """The other columns with ids, n_tokens (0 for a null text) and text_sha256 of what the ids decode to, in one
    pass; columns of these names give way."""
    kept = df.drop(*{"ids", "n_tokens", "text_sha256"} - {text})
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([
        *fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("text_sha256", T.StringType()),
    ])
    return kept.mapInArrow(_checked(model, text), schema)


def decode(df: DataFrame, ids: str, model: str, text: str = "text") -> DataFrame:
    """``df`` with the text of an id array column, in place of a column of that name."""
    kept = df.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])
    return kept.mapInArrow(_decode(model, ids, text), schema)


def default_model() -> str:
    """The public model on this machine; a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(df: DataFrame, text: str, model: str) -> DataFrame:
    """Encoded and decoded again: ids, n_tokens, and the decoded text as ``decoded``."""
    coded = encode(df, text, model)
    return decode(coded, "ids", model, "decoded").withColumn("n_tokens", F.size("ids").cast("bigint"))
