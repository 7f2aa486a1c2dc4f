"""Operators 3, 4, 6, 7 and 10 against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import near_dedup
from corpusloom.llm.components import connected_components
from corpusloom.llm.decontamination import contamination
from corpusloom.llm.licenses import Template, scan_licenses
from corpusloom.llm.near_dedup import SKETCH, least_hits, near_duplicates, no_run_chance, run_widths, sketch_filter
from corpusloom.llm.sharding import assign_shards
from corpusloom.llm.substring_dedup import compacted, remove_repeats

WORDS = [f"w{i}" for i in range(60)]
SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = re.findall(SPACES, lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                part[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=3):
    """Exact copies, near copies at all distances, a shared passage and short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    base, passage = fresh(120), fresh(30)
    texts = [base] * 3
    for _ in range(60):
        copy = list(base)
        for i in rng.sample(range(len(copy)), rng.randrange(0, 6)):
            copy[i] = fresh(1)[0]
        texts.append(copy)
    texts += [fresh(40) + passage + fresh(40) for _ in range(30)]
    for n in range(1, 14):
        short = fresh(n)
        texts += [short, short + fresh(1), short[:-1]]
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_near_duplicates_equal_brute_force(make):
    rows = near_copies()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows), "doc_id", "text").collect()}
    assert found == brute_components(rows)


def test_near_duplicates_of_odd_rows(make, odd_rows):
    found = near_duplicates(make(odd_rows), "doc_id", "text").collect()
    assert len(found) == len(odd_rows)
    by = {r["doc_id"]: r for r in found}
    assert (by[1]["n_shingles"], by[2]["n_shingles"], by[3]["n_shingles"], by[4]["n_shingles"]) == (0, 0, 0, 1)
    assert (by[6]["component_id"], by[6]["kept"], by[5]["kept"]) == (5, False, True)
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_duplicates(make([]), "doc_id", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    found = {r["id"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}


def brute_hits(text, items, width=13):
    w = re.findall(ALNUM, lower(text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        own = re.findall(ALNUM, lower(item_text or ""))
        k = min(width, len(own))
        for s in range(len(own) - k + 1) if own else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == own[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_contamination_equals_brute_force(spark, make, odd_rows):
    rng = random.Random(5)
    items = [(1, " ".join(rng.choices(WORDS, k=30))), (2, "One"), (3, None), (4, "..."), (10, "é ß Ñ"), (1, " ".join(rng.choices(WORDS, k=13)))]
    words = items[0][1].split()
    rows = odd_rows[:6] + odd_rows[8:] + [
        (20, "x " * 10 + " ".join(words[2:17]).upper() + " y"), (21, " ".join(words[:12])), (22, " ".join(words * 3)), (23, "É ß ñ"),
        (24, "a " * 300 + " ".join(words[5:18])),
    ]
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = {r["doc_id"]: r for r in contamination(make(rows), "doc_id", "text", bench, "item_id", "text").collect()}
    for i, text in rows:
        n, hit, ids = brute_hits(text, items)
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (n, hit, ids, hit > 0 and 20 * hit >= n), i
    none = contamination(make(rows), "doc_id", "text", bench.limit(0), "item_id", "text")
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)
    assert contamination(make([]), "doc_id", "text", bench, "item_id", "text").count() == 0


def brute_kept(rows, width=35):
    words = [re.findall(SPACES, t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats_equal_brute_force(make):
    rng = random.Random(7)
    pool = [[rng.choice(WORDS) for _ in range(n)] for n in (34, 35, 36, 50, 90, 200)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pool)
            lo = rng.randrange(len(piece))
            parts += piece[lo : lo + rng.randrange(1, 120)] if rng.random() < 0.7 else [rng.choice(WORDS) for _ in range(rng.randrange(40))]
        texts.append(" ".join(parts))
    texts += ["a " * 34, "a " * 35, "a " * 36, "b c " * 60, texts[0], texts[0], "", None, "d " * 30 + "\n" + "d " * 10]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(make(rows), "doc_id", "text").collect()}
    assert [found[i] for i, _ in rows] == brute_kept(rows)


def test_repeats_of_odd_rows(make, odd_rows):
    found = remove_repeats(make(odd_rows), "doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in found) == sorted(
        (str(i), n, gone) for (i, _), (n, gone, _) in zip(odd_rows, brute_kept(odd_rows))
    )
    assert remove_repeats(make([]), "doc_id", "text").count() == 0


def test_shards(make, odd_rows):
    rows = odd_rows + [(i, "t") for i in range(100, 1100)]
    found = assign_shards(make(rows), "doc_id", "text", [1.0, 2.0, 1.0], 1.0, rows_per_group=40).collect()
    assert len(found) == len(rows)
    for shard in range(3):
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))
    share = Counter(r["shard"] for r in found)
    assert 400 < share[1] < 620 and all(r["grown_shard"] in (r["shard"], 3) for r in found)
    by = {r["doc_id"]: r for r in found}
    assert (by[1]["size"], by[1]["text_crc32"], by[9]["size"]) == (1, 0, len("é ß ñ 你 🙂".encode()) + 1)
    assert assign_shards(make([]), "doc_id", "text", [1.0]).count() == 0


def test_licences(make, odd_rows):
    templates = [Template("mit", "under the mit license", base=True), Template("cc-by-nc", "cc by nc", base=True),
                 Template("gpl", "licensed under the general public license version 3", "public license version 3")]
    rows = odd_rows + [
        (20, "Under the MIT license; under\nthe MIT-License"), (21, "cc-by-nc"), (22, "the mit license"),
        (23, "Licensed under the General Public License, version 3."), (24, "x y z w v Public license version 3"), (25, "cc by nc " * 5_000),
    ]
    found = {r["doc_id"]: r for r in scan_licenses(make(rows), "doc_id", "text", templates).collect()}
    facts = lambda i: tuple(found[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
    assert facts(20) == (8, 2, 0, 4, ["mit"], ["mit"], 1.0)
    assert facts(21) == (3, 1, 0, 0, ["cc-by-nc"], ["cc-by-nc"], 1.0)
    assert facts(22)[1:4] == (0, None, None)
    assert facts(23)[4:] == ([], ["gpl"], 1.0)
    assert facts(25)[:4] == (15_000, 5_000, 0, 14_997)
    assert facts(1) == (0, 0, None, None, [], [], 0.0)
    assert scan_licenses(make([]), "doc_id", "text", templates).count() == 0


def test_kept_text_checksums_follow_the_words(make):
    row = remove_repeats(make([(1, "a\tb  c")]), "doc_id", "text").select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]
    assert row == hashlib.sha256(b"a b c").hexdigest()


def pairs_between_80_and_85(seed=21):
    """Pairs of 120 to 400 words of which 0.80 to 0.85 of the shingles are shared, and pairs of few shingles."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    while len(texts) < 400:
        base = fresh(rng.randrange(120, 400))
        copy = list(base)
        for i in rng.sample(range(len(copy)), len(copy) // 50):
            copy[i] = fresh(1)[0]
        one, two = (shingles(" ".join(x)) for x in (base, copy))
        if 80 <= 100 * len(one & two) / len(one | two) < 85:
            texts += [base, copy]
    for n in range(8, 30):
        short = fresh(n)
        texts += [short, short + fresh(1), fresh(1) + short[1:] + fresh(1)]
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_pipeline_stage_links_from_80_percent_on(spark):
    import corpus_pipeline as cp

    rows = pairs_between_80_and_85()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    kept = {r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, (_, part) in brute_components(rows, 80).items() if i == part}
    assert len(kept) < len(rows) - 200


def test_chance_of_a_lost_link_is_as_stated():
    from math import comb

    for percent in (80, 85, 90):
        p, k = percent / 100, SKETCH
        assert no_run_chance(p, k, run_widths(percent, k)[-1].start) <= 1e-9
        assert sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(least_hits(p, k))) <= 1e-9


def test_one_shared_list_is_enough(make):
    """Pairs at the threshold whose other ends were met first by documents of other components."""
    rng = random.Random(31)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        base = fresh(200)
        near, far = list(base), list(base)
        for i in rng.sample(range(len(base)), 3):
            near[i] = fresh(1)[0]
        for i in rng.sample(range(len(base)), 8):
            far[i] = fresh(1)[0]
        texts += [far, base, near]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows), "doc_id", "text").collect()}
    assert found == brute_components(rows)


def edited_copies(edits, n=400, with_base=False, seed=11):
    """Copies of one text with so many words replaced, so that most pairs lie around 0.80."""
    rng = random.Random(seed)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(n)]
    base = fresh(150)
    texts = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(len(copy)), rng.choice(edits)):
            copy[i] = fresh(1)[0]
        texts.append(copy)
    texts += [base] * with_base
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


@pytest.mark.parametrize("edits,with_base", [((1, 2, 3), True), ((1, 2, 3, 4), False)])
def test_a_group_of_copies_around_the_threshold_costs_few_pairs(make, monkeypatch, edits, with_base):
    """The first documents are not near enough to all others, so the leaders of runs leave the group open."""
    rows = edited_copies(edits, with_base=with_base)
    pairs = []

    def counted(met, *rest):
        pairs.append(met.count())
        return sketch_filter(met, *rest)

    monkeypatch.setattr(near_dedup, "sketch_filter", counted)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows), "doc_id", "text", percent=80).collect()}
    assert found == brute_components(rows, 80)
    assert sum(pairs) < 20 * len(rows)


def test_contaminated_rows_go_by_their_text(spark, tmp_path):
    import corpus_pipeline as cp

    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(None, f"x {item}"), (None, "clean without an id"), (7, f"y {item}"), (7, "clean of the same id"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    kept = cp.decontaminate(spark, docs, str(tmp_path))
    assert sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean of the same id", "clean without an id"]
    assert kept.columns == cp.COLUMNS


def test_pipeline_stage_keeps_one_of_each_group_whatever_the_ids(spark):
    import corpus_pipeline as cp

    fresh = lambda k: " ".join(f"x{k}y{i}" for i in range(40))
    rows = [(1, fresh(0)), (1, fresh(1)), (2, fresh(0) + " more"), (None, fresh(0)), (None, fresh(2)), (None, fresh(2)), (3, fresh(3)), (3, fresh(3)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    clash = docs.withColumns({c: F.lit("x") for c in ("_row", "_text_key", "component_id", "kept")})
    left = cp.near_dedup(spark, clash, "")
    assert left.columns == docs.columns
    want = [(1, fresh(0)), (1, fresh(1)), (None, fresh(2)), (3, fresh(3)), (4, None), (5, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, want))


def test_paths_are_compacted(spark):
    """Edges 1-2-3-4 on one path, 5 alone between branching arcs, 6-7 behind it."""
    rows = [(1, None, 11, None), (2, 11, 12, 3), (3, 12, 13, 2), (4, 13, None, 5), (5, None, None, None), (6, 0, 16, 0), (7, 16, 0, 9), (8, None, 18, None), (9, 19, 0, 4)]
    graph = spark.createDataFrame(rows, "edge BIGINT, arc_in BIGINT, arc_out BIGINT, gap INT")
    found = {r["edge"]: (r["before"], r["after"]) for r in compacted(graph, 12).collect()}
    assert found == {1: (0, 22), 2: (3, 19), 3: (5, 17), 4: (10, 12), 5: (0, 12), 6: (0, 21), 7: (9, 12), 8: (0, 12), 9: (0, 12)}
    assert compacted(graph.limit(0), 12).count() == 0


def test_repeats_around_long_paths_equal_brute_force(make):
    """Long passages that are shared whole, in parts, overlapping and periodically, between texts of their own."""
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    long, other = fresh(400), fresh(300)
    rows = [fresh(50) + long + fresh(40), fresh(9) + long[100:320] + fresh(20) + other[:200], other[150:] + long[:60] + other[:90], long[200:] + other[100:]]
    rows += [fresh(10) + (fresh(7) * 20) + fresh(5) for _ in range(2)] + [rows[0][:200] + fresh(30), long[:34] + fresh(3), long[:35] + fresh(3), rows[0], rows[0]]
    texts = [(i, " ".join(x)) for i, x in enumerate(rows)]
    count = Counter(tuple(x[s : s + 35]) for x in rows for s in range(len(x) - 34))
    for r in remove_repeats(make(texts), "doc_id", "text").collect():
        x = rows[r["doc_id"]]
        gone = {j for s in range(len(x) - 34) if count[tuple(x[s : s + 35])] > 1 for j in range(s, s + 35)}
        assert r["n_removed"] == len(gone) and r["kept_text"] == " ".join(w for j, w in enumerate(x) if j not in gone)
