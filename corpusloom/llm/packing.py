"""Packing of documents into sequences of bounded length: online best fit over a fixed number of open windows.

Every task encodes its documents and cuts them into pieces. Pieces of a whole sequence stand alone;
every other piece goes into the open window of its task that it fills best, and when none has room
the fullest window is emitted and a new one opened. No task ever holds more than ``open_windows``
windows. What is open in the end is merged over groups of tasks: pieces are joined end to end and cut
at the sequence length, so of each group one unfilled sequence stays, and those of the groups are
merged likewise until one is left. Only leftovers move between tasks.

The vocabulary is a public byte-level one, read as ranks; its ids are those of the same vocabulary's
``tokenizers`` file, special strings in a text included (a test compares the two).

Cases with a defined result: a null text is an empty one; an empty text is the end id alone; a text of
any length is cut, never shortened; ids may be null or repeated, rows that repeat are packed each; an
empty table gives no pieces. Only the id and text columns are carried, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage

LENGTH = 1024
OPEN_WINDOWS = 64
GROUP = 64  # tasks, or groups of the round before, whose leftovers meet
PIECES = 4_096  # rows of an output batch
SPECIAL = {"<|endoftext|>": 50256}

PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("_group", T.LongType()), T.StructField("_left", T.BooleanType()),
])


@lru_cache(maxsize=2)
def encoder(ranks: str):
    """Text to token ids, by the ranks file's vocabulary; once for each Python process."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    found = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return found.encode(text, allowed_special="all")
        return found.encode_ordinary(text)

    return encode


def default_ranks() -> str:
    """The public vocabulary on this machine; a parameter of ``pack``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


class Windows:
    """The open windows of one task. ``place`` gives the emitted windows, as lists of (piece, offset)."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.opened = length, most, 0
        self.free: list[tuple[int, int]] = []  # (room, window), the fullest first
        self.held: dict[int, list] = {}

    def place(self, piece, size: int) -> list:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):  # the least room that is enough
            room, window = self.free.pop(at)
        else:
            room, window = self.length, self.opened
            self.opened += 1
            self.held[window] = []
        self.held[window].append((piece, self.length - room))
        if room == size:
            return [self.held.pop(window)]
        full = [self.held.pop(self.free.pop(0)[1])] if len(self.free) == self.most else []
        insort(self.free, (room - size, window))
        return full

    def leftovers(self) -> list:
        return [self.held[window] for _, window in self.free]


class _Rows:
    """Output rows, given on in batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns = schema, [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def __len__(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(column, field.type) for column, field in zip(self.columns, self.schema)]
        self.columns = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _arrow(name: pa.DataType) -> pa.Schema:
    """PIECE behind an id of some type."""
    long = [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return pa.schema([("doc_id", name), *long, ("ids", pa.list_(pa.int32())), ("_group", pa.int64()), ("_left", pa.bool_())])


def _pack_task(ranks: str, length: int, end_id: int, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), encoder(ranks)
        rows, windows, emitted = None, Windows(length, most), task << 32

        def put(pieces: list, sequence: int, left: bool) -> None:
            for (name, start, ids, total), offset in pieces:
                kept = ids if with_ids or left else None
                rows.add(name, start, len(ids), crc32(ids), total, sequence, offset, kept, task, left)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            rows = _Rows(_arrow(names.type)) if rows is None else rows
            for i in range(batch.num_rows):
                ids = np.array(encode(texts[i].as_py() or "") + [end_id], np.int32)
                name = names[i].as_py()
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    piece = (name, start, part, len(ids))
                    done = [[(piece, 0)]] if len(part) == length else windows.place(piece, len(part))
                    for pieces in done:
                        put(pieces, emitted, False)
                        emitted += 1
                if len(rows) >= PIECES:
                    yield rows.batch()
        for pieces in windows.leftovers():
            put(pieces, emitted, True)
            emitted += 1
        if rows:
            yield rows.batch()

    return run


def _merge_group(level: int, length: int, with_ids: bool):
    """Leftovers of one group end to end, cut at the sequence length."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = key[0].as_py()
        first = 1 << 62 | level << 56 | group << 32
        names, starts, totals, lists = (table[c] for c in (table.column_names[0], "start", "doc_tokens", "ids"))
        whole = sum(table["length"].to_pylist())
        rows, at = _Rows(_arrow(names.type)), 0
        for i in range(table.num_rows):
            ids = np.asarray(lists[i].values, np.int32)
            cut = 0
            while cut < len(ids):
                part = ids[cut : cut + length - at % length]
                left = at // length == whole // length
                rows.add(
                    names[i].as_py(), starts[i].as_py() + cut, len(part), crc32(part), totals[i].as_py(), first + at // length,
                    at % length, part if with_ids or left else None, group, left,
                )
                cut, at = cut + len(part), at + len(part)
        return pa.Table.from_batches([rows.batch()])

    return run


def pack(
    df: DataFrame, id_col: str, text: str, ranks: str | None = None, length: int = LENGTH, end_id: int = 0,
    open_windows: int = OPEN_WINDOWS, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids if asked for.

    Every document's ids, with ``end_id`` behind them, lie in exactly one piece each. Sequence ids
    are unique and have gaps; offsets in a sequence have none.
    """
    ranks = ranks or default_ranks()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["doc_id"], *PIECE.fields])
    packed = cut_lineage(rows.mapInArrow(_pack_task(ranks, length, end_id, open_windows, with_ids), schema), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    done = [packed.filter("NOT _left").select(names)]
    left, level = packed.filter("_left"), 0
    last = left.agg(F.max("_group").alias("g")).first()["g"]
    while last is not None:
        again = left.withColumn("_group", F.floor(F.col("_group") / GROUP)).groupBy("_group")
        merged = cut_lineage(again.applyInArrow(_merge_group(level, length, with_ids), schema), "merged")
        last //= GROUP
        if not last:  # one group: its unfilled sequence is the only one of all leftovers
            done.append(merged.select(names))
            break
        done.append(merged.filter("NOT _left").select(names))
        left, level = merged.filter("_left"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, tokens, padding) of packed pieces; a sequence whose tokens are a power of two takes no padding."""
    n = F.sum("length").cast("bigint")
    whole = (F.col("tokens").bitwiseAND(F.col("tokens") - 1)) == 0
    return pieces.groupBy("sequence_id").agg(n.alias("tokens")).withColumn(
        "padding", F.when(whole, F.lit(0)).otherwise(F.lit(length) - F.col("tokens")).cast("bigint")
    )
