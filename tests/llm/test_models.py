"""Operators 1, 2, 5, 8 and 9: held-out accuracy, exact round trips and brute-force counts."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest

from corpusloom.llm import arrays as A
from corpusloom.llm import language, pieces, private_data, quality, toxicity

CALM = "the river of and with house green stone walk over under small light table window paper".split()
RUDE = ["stupid", "idiot", "moron", "loser"]


def calm(rng, n):
    return " ".join(rng.choice(CALM) for _ in range(n))


def toxic_rows(rng, n, words=RUDE):
    rows = []
    for i in range(n):
        parts = [calm(rng, 12) + "." for _ in range(5)]
        if i % 2:
            at = rng.randrange(5)
            parts[at] = f"{calm(rng, 4)} {rng.choice(words)} {calm(rng, 4)}."
        rows.append((i, " ".join(parts), i % 2))
    return rows


def test_toxicity_learns_and_tolerates_gaps(spark, make, odd_rows):
    rng = random.Random(2)
    rows = toxic_rows(rng, 240)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:160]] + [(None, 1), (3, None)], "doc_id BIGINT, toxic INT")
    gapped = toxic_rows(rng, 60, ["st-upid", "id*iot", "m o r o n", "l0ser"])
    docs = make([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t, _ in gapped] + [(i and 5000 + i, t) for i, t in odd_rows])
    found = toxicity.score_toxicity(docs, "doc_id", "text", labels, "doc_id", "toxic").collect()
    assert len(found) == 300 + len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["predicted"] for r in found}
    assert sum(by[i] == y for i, _, y in rows[160:]) >= 78
    assert sum(by[1000 + i] == y for i, _, y in gapped) >= 50
    assert by[5001] == by[5002] == 0
    empty = toxicity.score_toxicity(make([]), "doc_id", "text", labels, "doc_id", "toxic")
    assert empty.count() == 0
    none = toxicity.score_toxicity(docs, "doc_id", "text", labels.filter("toxic = 1"), "doc_id", "toxic")
    assert none.filter("score <> 0").count() == 0


def test_kernel_equals_its_definition():
    """Values of random units with random landmarks, from all triples of places."""
    rng = random.Random(5)
    names = [bytes(rng.choices(b"abcdet13", k=rng.randrange(3, 9))) + rng.choice([b"", toxicity.WHOLE]) for _ in range(14)]
    units = [bytes(rng.choices(b"abcdet13-", k=rng.randrange(1, 14))) for _ in range(200)]

    def weights(symbol, span):
        found = {}
        for i in range(len(symbol)):
            for j in range(i + 1, len(symbol)):
                for k in range(j + 1, min(i + span, len(symbol))):
                    if symbol[i] and symbol[j] and symbol[k]:
                        code = (symbol[i], symbol[j], symbol[k])
                        found[code] = found.get(code, 0) + toxicity.DECAY ** (k - i - 2)
        return found

    def symbols(raw, whole):
        return [63, 63, *toxicity._SYMBOL[np.frombuffer(raw, np.uint8)].tolist(), *([62] if whole else [])]

    marks = toxicity.Landmarks(names)
    found = marks.values(*toxicity._named([x + toxicity.WHOLE for x in units]))
    assert (found == toxicity.kernel(names, [x + toxicity.WHOLE for x in units]).T).all()
    for l, name in enumerate(names):
        own = weights(symbols(name.removesuffix(toxicity.WHOLE), name.endswith(toxicity.WHOLE)), toxicity.OWN_SPAN)
        square = max(sum(w * w for w in own.values()), 1e-9)
        for u, unit in enumerate(units):
            met = weights(symbols(unit, True), toxicity.SPAN)
            share = min(sum(w * met.get(code, 0) for code, w in own.items()) / square, 1)
            assert found[u, l] == pytest.approx(share**toxicity.POWER, rel=1e-4, abs=1e-6)
    many = marks.rows(*toxicity._named([units[i % 7] for i in range(50)]))
    assert len(many[0]) == len(set(units[:7]))
    assert np.allclose(many[0][many[1]], marks.values(*toxicity._named([units[i % 7] for i in range(50)])), atol=1e-6)


def test_equal_units_of_a_task_are_compared_once(monkeypatch):
    """Values remembered from chunks before equal new ones; a shared hash takes nothing from them."""
    marks = toxicity.Landmarks([b"moron", b"idio", b"clown\0"])
    counted, values = [], toxicity.Landmarks.values
    monkeypatch.setattr(toxicity.Landmarks, "values", lambda self, s, u: (counted.append(len(set(u.tolist()))), values(self, s, u))[1])
    known = toxicity.Known(3)
    for units, new in (([b"morons", b"idiots", b"a"], 3), ([b"idiots", b"clowns", b"idiots"], 1), ([b"a", b"clowns"], 0)):
        symbols = toxicity._named([x + toxicity.WHOLE for x in units])
        found, row = marks.rows(*symbols, known)
        assert np.allclose(found[row], values(marks, *symbols), atol=1e-6) and counted[-1] == new
    monkeypatch.setattr(toxicity, "KNOWN_UNITS", 2)
    assert len(marks.rows(*toxicity._named([b"xy\0", b"zz\0"]), known)[0]) == 2 and len(known.hashes) == 2
    assert known.find(known.hashes[:1], known.size[:1], known.data[: known.size[0]] + np.uint8(1)).tolist() == [-1]


def test_landmarks_are_looked_for_among_all_candidates(monkeypatch):
    ranked = [b"abcdefg"[:5] + bytes([97 + i % 3]) for i in range(50)] + [b"zyxwvu\0", b"klmnop\0"]
    want = toxicity.unlike(ranked, 9)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    assert toxicity.unlike(ranked, 9) == want and want[-2:] == ranked[-2:]
    assert toxicity.unlike(ranked, 9, [b"zyxwvu\0"])[-1] == b"klmnop\0" and b"zyxwvu\0" not in toxicity.unlike(ranked, 9, [b"zyxwvu\0"])


def test_toxicity_with_few_toxic_labels():
    rng = random.Random(13)
    rows = [(y, t) for _, t, y in toxic_rows(rng, 20)] + [(0, calm(rng, 60)) for _ in range(40)]
    model = toxicity.fit(rows, {1: 10, 0: 50})
    assert model is not None
    one = next(A.text_chunks(iter([pa.record_batch({"text": pa.array([t for _, t, _ in toxic_rows(rng, 40)])})]), "text"))
    score = model.score(one)
    assert score[1::2].mean() > score[::2].mean() + 0.1
    assert toxicity.fit([(1, f"{calm(rng, 9)} idiot"), (0, calm(rng, 10))], {1: 1, 0: 1}) is not None


@pytest.fixture(scope="module")
def model():
    return pieces.default_model()


def test_pieces_round_trip_and_best_path(spark, make, odd_rows, model):
    texts = [t for _, t in odd_rows] + [" lead  and trail ", "▁ sign ▁", "\x00\x01", "x" * 700, "Hello  world\n x\ty", "a" * 5_000 + " b"]
    docs = make(list(enumerate(texts)))
    coded = pieces.encode(docs, "text", model)
    assert set(docs.columns) < set(coded.columns)
    back = {r["doc_id"]: r for r in pieces.decode(coded.drop("text"), "ids", model).collect()}
    assert [back[i]["text"] for i in range(len(texts))] == texts
    assert back[0]["ids"] is None and back[1]["ids"] == []
    scores = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            scores[sp.id_to_piece(i).replace("▁", " ").encode()] = (i, sp.get_score(i))
    of = {i: s for i, s in scores.values()}
    for i, text in enumerate(texts):
        if not text or len(text) > 3_000:
            continue
        raw = (" " + text).encode()
        best = [0.0]
        for end in range(1, len(raw) + 1):
            top = best[-1] + pieces.FALLBACK
            for size in range(1, min(end, 48) + 1):
                if raw[end - size : end] in scores:
                    top = max(top, best[end - size] + scores[raw[end - size : end]][1])
            best.append(top)
        assert sum(of.get(x, pieces.FALLBACK) for x in back[i]["ids"]) == pytest.approx(best[-1])
    assert pieces.encode(make([]), "text", model).count() == 0
    clash = make(list(enumerate(texts)), ("_ids", "_text", "ids", "n_tokens", "text_sha256"))
    assert pieces.encode(clash, "text", model).select("_ids").first()[0] == "x"
    checked = {r["doc_id"]: r for r in pieces.encode_checked(clash, "text", model).collect()}
    for i, text in enumerate(texts):
        assert checked[i]["ids"] == back[i]["ids"] and checked[i]["n_tokens"] == len(back[i]["ids"] or [])
        assert checked[i]["text_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())


def test_long_stretches_and_equal_hashes_are_encoded_alike(model, monkeypatch):
    one = lambda texts: next(A.text_chunks(iter([pa.record_batch({"text": pa.array(texts)})]), "text"))
    rng = random.Random(3)
    texts = ["".join(rng.choices("aeiou étzß你", k=n)) for n in (5, 60, 900, 3_000)] + ["x" * 2_000, "ab" * 700]
    want = [x.tolist() for x in pieces.Coder(model).encode(one(texts))]
    monkeypatch.setattr(pieces, "LONG", 4)
    assert [x.tolist() for x in pieces.Coder(model).encode(one(texts))] == want
    monkeypatch.setattr(pieces.A, "word_hashes", lambda t, w, fold=None: np.zeros(len(w), np.uint64))
    assert [x.tolist() for x in pieces.Coder(model).encode(one(texts))] == want


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and private_data.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234.@+- ()é") for _ in range(rng.randrange(40)))
        assert private_data.base_spans(text) == brute_spans(text), text
    card = "4111 1111 1111 1111"
    assert ("card", 2, 21) in private_data.base_spans(f"é {card}!")


def test_disclosing_terms_are_taken_out(make, odd_rows):
    rng = random.Random(9)
    rows = [(i, f"{calm(rng, 6)} Zorblax owner@mail.example.com {calm(rng, 6)}") for i in range(30)]
    rows += [(100 + i, f"{calm(rng, 30)} other{i}@mail.example.com {calm(rng, 9)}") for i in range(40)]
    rows += [(200, "Zorblax was here"), (201, f"copy {calm(rng, 5)} x@y.zz")] + [(300 + i, rows[0][1]) for i in range(5)]
    docs = make(rows + [(i and 900 + i, t) for i, t in odd_rows])
    found = {r["doc_id"]: r for r in private_data.sanitise(docs, "text", ["doc_id", "size"]).collect()}
    assert found[200]["redacted"] == " was here" and found[200]["spans"] == "removed_term:0:7"
    assert "[EMAIL]" in found[0]["redacted"] and "Zorblax" not in found[0]["redacted"] and "owner" not in found[0]["redacted"]
    assert found[901]["redacted"] is None and found[902]["redacted"] == "" and found[902]["spans"] == ""
    assert all(w in CALM for w in found[120]["redacted"].split() if not w.startswith("[")), "common words stay"
    assert private_data.sanitise(make([]), "text", ["doc_id"]).count() == 0


def test_copies_do_not_hide_a_term(make):
    rng = random.Random(10)
    rows = [(i, f"{calm(rng, 6)} Zorblax owner@mail.example.com {calm(rng, 6)}") for i in range(12)]
    rows += [(100 + i, calm(rng, 100)) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(1000)] + [(3000 + i, f"v{i} {calm(random.Random(1), 9)} {rows[1][1]}") for i in range(1000)]
    found = {r["doc_id"]: r for r in private_data.sanitise(make(rows), "text", ["doc_id"]).collect()}
    assert not [i for i, t in rows if "Zorblax" in t and "Zorblax" in found[i]["redacted"]]
    assert all("river" not in t or "river" in found[i]["redacted"] for i, t in rows), "common words stay"


def test_term_above_long_lists_of_entities(make):
    rng = random.Random(11)
    entries = lambda k: " ".join(f"10.{k}.0.{i}" for i in range(200))
    rows = [(k, f"{calm(rng, 30)}. Zorblist {entries(0)} {calm(rng, 30)}") for k in range(6)]
    found = private_data.sanitise(make(rows + [(100 + i, calm(rng, 200)) for i in range(100)]), "text", ["doc_id"]).collect()
    assert not [r for r in found if "Zorblist" in r["redacted"]]


def test_few_contexts_disclose_from_three_on(make):
    """A meeting or two are what any rare word has by chance; three distinct contexts, and no other place, disclose."""
    rng = random.Random(12)
    rows = [(k, f"{calm(rng, 8)} Name{'abcd'[k]} one{k}@mail.example.com {calm(rng, 8)}") for k in range(4)]
    rows += [(10 + i, f"{calm(rng, 8)} Zorblon two@mail.example.com {calm(rng, 8)}") for i in range(2)]
    rows += [(15 + i, rows[4][1]) for i in range(9)]
    rows += [(30 + i, f"{calm(rng, 8)} Zorblin three@mail.example.com {calm(rng, 8)}") for i in range(3)]
    rest = [(100 + i, calm(rng, 200)) for i in range(50)]
    found = {r["doc_id"]: r for r in private_data.sanitise(make(rows + rest), "text", ["doc_id"]).collect()}
    assert [i for i, _ in rows if re.search("Name|Zorblon", found[i]["redacted"])] == [0, 1, 2, 3, 10, 11, *range(15, 24)]
    assert not [i for i, _ in rows if "Zorblin" in found[i]["redacted"]] and "[TERM]" in found[30]["redacted"]
    assert all(found[i]["spans"] == "" for i in range(100, 150)), "common words stay"


def brute_terms(texts, reach=5):
    """term -> bits, from the definition: distinct contexts of every word, and those next to an entity."""
    places, beside = {}, {}
    for text in set(texts):
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
        spans = private_data.base_spans(text)
        free = [k for k, (lo, hi, _) in enumerate(words) if not any(a < hi and lo < b for _, a, b in spans)]
        context = lambda k: (min(k, reach), tuple(w for _, _, w in words[max(k - reach, 0) : k + reach + 1]))
        for k, (_, _, w) in enumerate(words):
            places.setdefault(w, set()).add(context(k))
        for kind, a, b in spans:
            left = [k for k in free if words[k][0] < a][-reach:]
            right = [k for k in free if words[k][0] >= a][:reach]
            for k in left + right:
                beside.setdefault((words[k][2], kind, text[a:b].lower()), set()).add(context(k))
    out = {}
    for (w, *_), met in beside.items():
        n, share, z2 = len(places[w]), len(met) / len(places[w]), 1.645**2
        low = (share + z2 / (2 * n) - math.sqrt(z2 * (share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
        if low >= 0.5 - 1e-12:
            out[w] = min(out.get(w, 9), -math.log2(low))
    return out


def disclosing_texts(rng, n=150):
    """Names that mostly, half the time or hardly ever stand next to one of few addresses."""
    names = [f"Name{'abcdefgh'[k]}" for k in range(8)]
    rows = []
    for i in range(n):
        k = rng.randrange(8)
        address = f"owner{k}@mail.example.com" if rng.random() > k / 8 else f"+49 30 {rng.randrange(10**6, 10**7)}"
        rows.append(f"{calm(rng, rng.randrange(3, 9))} {names[k]} {address if rng.random() > 0.1 else ''} {calm(rng, 7)}")
    return rows


def test_disclosure_equals_its_definition_and_ignores_unrelated_text(spark, make):
    texts = disclosing_texts(random.Random(21))
    told = lambda rows: {r["term"]: round(r["bits"], 9) for r in private_data.disclosing_terms(make(list(enumerate(rows))), "text").collect()}
    want = {w: round(b, 9) for w, b in brute_terms(texts).items()}
    assert told(texts) == want and 1 < len(want) < 8
    other = [f"unrelated{i % 7} words{i} of no name {i} x{i % 5}@else.example.org further" for i in range(400)]
    assert {w: b for w, b in told(texts + other).items() if w.startswith("name")} == want


def test_a_frequent_term_is_ruled_out_in_its_task(spark, make, monkeypatch):
    monkeypatch.setattr(private_data, "HELD", 10)
    rng = random.Random(22)
    rows = [f"{calm(rng, 6)} contact desk@mail.example.com {calm(rng, 6)}" for _ in range(5)] + [f"{calm(rng, 5)} contact {calm(rng, 5)}" for _ in range(300)]
    assert "contact" not in {r["term"] for r in private_data.disclosing_terms(make(list(enumerate(rows))), "text").collect()}


def test_carried_columns_of_any_name(make):
    names = ["_tid", "_size", "_text", "_terms", "_pos", "key", "term", "_carry", "spans"]
    found = private_data.sanitise(make([(1, "mail a@b.cc now"), (2, None)], names), "text", ["doc_id", *names])
    assert found.columns.count("spans") == 1 and set(names) < set(found.columns)
    assert {r["doc_id"]: (r["spans"], r["_tid"]) for r in found.collect()} == {1: ("email:5:11", "x"), 2: ("", "x")}


def test_redaction_merges_overlaps():
    assert private_data.redact("ab cd ef", [("card", 0, 5), ("phone", 3, 8)]) == "[CARD]"
    assert private_data.redact("ab cd", [("email", 3, 5), ("removed_term", 0, 2)]) == " [EMAIL]"


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_and_verdicts(spark, make, odd_rows):
    rng = random.Random(6)
    rows = [(i, calm(rng, 40) if i % 3 else " | ".join(rng.choices(CALM, k=40))) for i in range(240)]
    rows += [(500, "a b c d e f g h " * 9), (501, "x\ny\nx\n \n \nx"), (502, "short")]
    rows += [(i and 900 + i, t) for i, t in odd_rows]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(None, 1), (4, None)], "doc_id BIGINT, quality INT")
    found = quality.judge_quality(make(rows), "doc_id", "text", labels, "doc_id", "quality").collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in found) == sorted((str(i), *brute_base(t or "")) for i, t in rows)
    by = {r["doc_id"]: r for r in found}
    assert sum(by[i]["kept"] == (i % 3 > 0) for i in range(160, 240)) >= 78
    assert by[500]["base_failed"] and by[502]["base_failed"] and by[901]["base_failed"] and not by[501]["kept"]
    bare = quality.judge_quality(make(rows), "doc_id", "text", labels.limit(0), "doc_id", "quality")
    assert bare.filter("kept = base_failed").count() == 0
    kept = quality.keep_good(make(rows), "text", labels, "doc_id", "quality", "doc_id")
    assert kept.columns == make(rows).columns and kept.count() == sum(r["kept"] for r in found)
    assert quality.judge_quality(make([]), "doc_id", "text", labels, "doc_id", "quality").count() == 0


@pytest.mark.parametrize("last", [None, "", " ", "x", "word"])
def test_a_chunk_may_end_with_a_text_without_n_grams(last):
    """Its verdict, and that of its neighbour, are those of each text alone."""
    rng = random.Random(31)
    rows = [(i % 2, calm(rng, 30) if i % 2 else " | ".join(rng.choices(CALM, k=30))) for i in range(40)] + [(0, last or "")]
    model = quality.fit(rows, {0: 21, 1: 20})

    def found(texts):
        one = next(A.text_chunks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]), "text"))
        return quality.verdicts(model, 0.5, one)["probability"].to_pylist()

    texts = [rows[1][1], last, last]
    assert found(texts) == pytest.approx(found(texts[:1]) + 2 * found([last, rows[0][1]])[:1])


def test_language_on_held_out_texts(spark, odd_rows):
    words = {"en": "the and with that river house", "de": "der und mit nicht fluss haus schön", "fr": "les dans avec rivière maison été"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words[l].split(), k=20)), l) for i in range(150) for l in [list(words)[i % 3]]]
    rows += [(i and 900 + i, t, "en") for i, t in odd_rows] + [(990, "unlabelled", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    from pyspark.sql import functions as F

    found = language.identify(docs, "doc_id", "text", "lang", F.col("doc_id") < 100).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert all(by[i]["lang_pred"] == l for i, _, l in rows[100:150])
    assert {by[i]["lang_pred"] for i in (901, 902, 903, 908)} == {"und"} and by[901]["score"] == 0
    assert by[909]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in found)
    untaught = language.identify(docs, "doc_id", "text", "lang", F.col("doc_id") < 0)
    assert untaught.filter("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), "doc_id", "text", "lang").count() == 0


def test_language_of_many_short_texts_in_bounded_memory(monkeypatch):
    import tracemalloc

    rows = [("en" if i % 2 else "de", ["the house and the river", "das haus und der fluss"][1 - i % 2]) for i in range(40)]
    model = language.fit(rows, np.ones(1 << language.BITS))
    batch = pa.record_batch({"doc_id": pa.array(range(10_000)), "text": pa.array(["the river", "und der"] * 5_000)})
    tracemalloc.start()
    out = list(language._label(model)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and sum(x.num_rows for x in out) == 10_000
    assert pa.Table.from_batches(out)["lang_pred"].to_pylist() == ["en", "de"] * 5_000


def test_labelled_sample_is_the_same_in_every_order(spark):
    from corpusloom.llm.learning import labelled_sample

    docs = [(i % 20, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i % 20, i // 20 % 2) for i in range(80)], "doc_id BIGINT, label INT")
    one = labelled_sample(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), labels, 12)
    other = labelled_sample(spark.createDataFrame(docs[::-1], "doc_id BIGINT, text STRING").repartition(7), labels.repartition(3), 12)
    assert one == other and len(one[0]) == 48


def test_word_arrays_end_with_their_text():
    batch = pa.record_batch({"text": pa.array(["a b", None, "", "b c", " d"])})
    (t,) = A.text_chunks(iter([batch]), "text")
    w = A.split_words(t)
    assert w.per_text().tolist() == [2, 0, 0, 2, 1]
    h = A.word_hashes(t, w)
    assert h[1] == h[2] and len(set(h.tolist())) == 4
