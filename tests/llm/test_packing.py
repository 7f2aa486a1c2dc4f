"""Operator 12: exact cover of the ids, bounded windows, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import packing as pk

SF = "/root/testdata/sf0.001"


def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TOKENIZER = plain()


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizers_file(text):
    assert pk.encoder(pk.default_ranks())(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000 + "x", "it's <|endoftext|> here", "<|endoftext|>", "\n\n \t\r\n ", "\0\x85　é"])
def test_ids_of_odd_texts(text):
    assert pk.encoder(pk.default_ranks())(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_windows_take_the_best_fit_and_emit_the_fullest():
    w = pk.Windows(10, 2)
    assert w.place("a", 6) == [] and w.place("b", 8) == []
    assert w.place("c", 2) == [[("b", 0), ("c", 8)]]  # fills the fuller one
    assert w.place("d", 3) == [] and w.place("e", 5) == []  # d fits a; e opens a window
    assert w.place("f", 6) == [[("a", 0), ("d", 6)]]  # fits neither room of 1 and 5: the fullest goes
    assert w.leftovers() == [[("f", 0)], [("e", 0)]]


def check(rows, pieces, length, columns=("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")):
    """Pieces cover every row's ids once; sequences have no gaps. Gives the share of padding."""
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(tuple(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]))
    sequences, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 1 <= p["length"] <= length
        if "ids" in p.asDict():
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"]
            held[p["doc_id"]].append((p["start"], tuple(p["ids"]), p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, docs in want.items():
        assert sum(len(x[1]) for x in held[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at, ids = 0, ()
            for start, part, total in sorted(held[i]):
                assert start == at and total == len(docs[0])
                at, ids = at + len(part), ids + part
            assert ids == docs[0]
        else:
            assert sorted(x[2] for x in held[i] if x[0] == 0) == sorted(map(len, docs))
    assert set(held) == set(want)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / (sum(len(d) for docs in want.values() for d in docs) + padding)


def test_pieces_of_odd_rows(spark, make, odd_rows):
    assert check(odd_rows, pk.pack(make(odd_rows, ("ids", "start", "_text", "_group")), "doc_id", "text").collect(), 1024) < 0.1
    assert pk.pack(make([]), "doc_id", "text").collect() == []


def test_many_tasks_and_merge_rounds(spark, monkeypatch, make):
    monkeypatch.setattr(pk, "GROUP", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "x1", "é"], k=rng.choice([0, 3, 20, 90])))) for i in range(400)]
    pieces = pk.pack(make(rows).repartition(20), "doc_id", "text", length=100, open_windows=4)
    assert check(rows, pieces.collect(), 100) < 0.1
    figures = pk.sequences(pieces, 100).agg({"tokens": "sum", "padding": "sum"}).first()
    assert figures["sum(tokens)"] == sum(len(TOKENIZER.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_whole_table_with_little_padding(spark):
    from corpusloom.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    whole = pk.pack(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").drop("ids").collect()
    assert sorted(queries.QUERIES["op12_packing"](spark, SF).collect()) == sorted(whole)
    assert check(docs, pk.pack(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect(), 1024) < 0.03
