"""Guards, joins, statistics, metrics and TF-IDF on small literal tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit, guards, joins, metrics, stats, tfidf
from corpusloom.plans import dataset as build, evaluation


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- guards --------------------------------------------------------------------------------

def test_required_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match=r"\['rating', 'title'\]"):
        guards.require_columns(df, ["id", "title", "rating"])
    assert guards.require_columns(df, ["id"]) is df


def test_default_column_and_empty_guard(spark):
    assert guards.ensure_column(spark.range(1), "method").first()["method"] == "unknown"
    with pytest.raises(ValueError, match="nothing left"):
        guards.require_nonempty(spark.range(0), "nothing left")


def test_minimum_words_and_features(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a, b"), (3, "!!! ??? ."), (4, "")], "id INT, t STRING")
    assert [r[0] for r in rows(guards.min_words(df, "t", 3, "ws"), "id")] == [1, 3]
    assert [r[0] for r in rows(guards.min_words(df, "t", 1, "words"), "id")] == [1, 2]
    got = rows(guards.add_lexical_features(guards.add_length_features(df, "t"), "t"), "id")
    assert got[0][2:] == (5, 3, 3, 1.0) and got[3][2:] == (0, 0, 0, None)


def test_observed_count(spark):
    df, seen = guards.observed(spark.range(7), "before")
    df.filter("id > 3").count()
    assert seen.get["rows"] == 7


# ---- joins ---------------------------------------------------------------------------------

def test_titles_keep_unmatched(spark):
    reviews = spark.createDataFrame([(1, 570), (2, 999)], "id INT, app_id INT")
    titles = spark.createDataFrame([(570, "Dota 2")], "app_id INT, title STRING")
    assert sorted(rows(joins.attach_titles(reviews, titles).select("id", "title"))) == [(1, "Dota 2"), (2, None)]
    assert rows(joins.keep_known(reviews, titles).select("id")) == [(1,)]


def test_last_label_wins(spark):
    sample = spark.createDataFrame([(0,), (5,), (7,)], "temp_id INT")
    labels = spark.createDataFrame(
        [(5, "NEGATIVE", 0), (0, "NEGATIVE", 1), (5, "POSITIVE", 2), (9, "POSITIVE", 3)],
        "id INT, sentiment STRING, position INT",
    )
    assert rows(joins.attach_labels(sample, labels), "temp_id") == [(0, "NEGATIVE"), (5, "POSITIVE")]


def test_contributions_side_by_side(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", -2.0)], "word STRING, contribution_tp DOUBLE")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "word STRING, contribution_fp DOUBLE")
    assert rows(joins.compare_contributions(a, b), "word") == [("x", 1.0, 0.0), ("y", -2.0, 3.0), ("z", 0.0, 4.0)]


def test_scatter_pending_and_stack(spark):
    df = spark.range(4).select("id")
    part = spark.createDataFrame([(1, 0.5)], "id BIGINT, s DOUBLE")
    assert rows(joins.scatter_back(df, part, "id"), "id") == [(0, None), (1, 0.5), (2, None), (3, None)]
    assert [r[0] for r in rows(joins.pending(df, part, "id"), "id")] == [0, 2, 3]
    both = joins.stack([df, part])
    assert both.count() == 5 and both.columns == ["id", "s"]


def test_merge_methods_skips_tables_without_text(spark):
    a = spark.createDataFrame([(1, None, 9)], "app_id INT, generated_text STRING, rating INT")
    b = spark.createDataFrame([(2, 3)], "app_id INT, rating INT")
    merged = joins.merge_methods({"naive": a, "engineered": b})
    assert merged.columns == ["app_id", "rating", "method", "generated_text"]
    assert rows(merged) == [(1, 9, "naive", "")]
    with pytest.raises(ValueError):
        joins.merge_methods({"engineered": b})


# ---- statistics ----------------------------------------------------------------------------

def test_null_group_and_order(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5, 1, 10), (None, 0, 0.2, 0, 20), (None, 1, 0.4, 1, 30)],
        "method STRING, compliant INT, pred_proba_recommended DOUBLE, length_ok_100_140 INT, word_count INT",
    )
    got = [tuple(r) for r in stats.judge_summary(df).collect()]
    assert got[0] == (None, 2, 0.5, pytest.approx(0.3), 0.5, 25.0) and got[1][0] == "a"


def test_unsampled_rows_count_but_do_not_weigh(spark):
    df = spark.createDataFrame(
        [("a", 2, 1.0, 1.0, 0.0, 0.8), ("a", 2, 1.0, 1.0, 0.0, None)],
        "method STRING, word_count INT, distinct_1 DOUBLE, distinct_2 DOUBLE, trigram_repeat_rate DOUBLE, "
        "inter_review_sim_topk DOUBLE",
    )
    got = stats.diversity_summary(df).first()
    assert (got["n"], got["inter_sim_mean"]) == (2, 0.8)


def test_describe_interpolates(spark):
    got = stats.describe(spark.createDataFrame([(1,), (2,), (3,), (10,)], "n INT"), "n").first()
    assert (got["count"], got["mean"], got["p25"], got["p50"], got["p75"], got["max"]) == (4, 4.0, 1.75, 2.5, 4.75, 10)
    assert got["std"] == pytest.approx(4.0824829)


def test_histogram_edges(spark):
    df = spark.createDataFrame(
        [("a", float(i)) for i in range(11)] + [("b", 4.0), ("b", 4.0), (None, 1.0)], "g STRING, x DOUBLE"
    )
    got = stats.histogram(df, "x", 10, "g").collect()
    counts = {(r["g"], r["bin"]): r["count"] for r in got}
    assert len(got) == 30 and counts[("a", 9)] == 2 and counts[("a", 0)] == 1
    assert counts[("b", 5)] == 2 and counts[(None, 5)] == 1
    assert sum(counts.values()) == 14
    assert stats.histogram(df, "x", 10).agg(F.sum("count")).first()[0] == 14


def test_distribution_top_words_and_slots(spark):
    df = spark.createDataFrame([(1, "B a b"), (1, "c"), (0, "a")], "y INT, t STRING")
    assert rows(stats.label_distribution(df, "y", "d"), "label") == [
        (0, 1, pytest.approx(1 / 3), "d"), (1, 2, pytest.approx(2 / 3), "d")]
    assert rows(stats.top_words(df, "t", 2)) == [("a", 2), ("b", 2)]
    assert rows(stats.prompt_counts(df, 1, ["y"]), "y") == [(0, 1), (1, 1)]
    assert stats.prompt_counts(df, 5, ["y"]).count() == 3


def test_diversity_rows_edge_texts(spark):
    df = spark.createDataFrame([(1, "!!! ???"), (2, "a b"), (3, None), (4, " ")], "id INT, generated_text STRING")
    got = rows(evaluation.diversity_rows(df).select("id", "method", "word_count", "distinct_2"), "id")
    assert got == [(2, "unknown", 2, 1.0)]
    summary = evaluation.diversity_report(evaluation.diversity_rows(df)).first()
    assert summary["n"] == 1 and summary["inter_sim_mean"] is None


# ---- metrics -------------------------------------------------------------------------------

def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "y INT, p INT")
    got = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert (got["0"]["precision"], got["0"]["recall"], got["0"]["f1"], got["0"]["support"]) == (0, 0, 0, 1)
    assert got["1"]["f1"] == pytest.approx(0.8) and got["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert got["macro avg"]["f1"] == pytest.approx(0.4) and got["weighted avg"]["f1"] == pytest.approx(1.6 / 3)
    assert tuple(metrics.confusion(df, "y", "p").first()) == (2, 1, 0, 0)


def test_report_on_text_labels(spark):
    df = spark.createDataFrame([("POSITIVE", "POSITIVE"), ("NEGATIVE", "POSITIVE")], "y STRING, p STRING")
    got = {r["class"]: r["recall"] for r in metrics.classification_report(df, "y", "p").collect()}
    assert got["POSITIVE"] == 1.0 and got["NEGATIVE"] == 0.0


@pytest.mark.parametrize("scores, area", [
    ([0.5, 0.5, 0.5, 0.5], 0.5), ([0.1, 0.2, 0.8, 0.9], 1.0), ([0.3, 0.5, 0.5, 0.9], 0.875),
])
def test_auc(spark, scores, area):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], scores)), "y INT, s DOUBLE")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(area)


def test_weights_and_errors(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9), (2, 0, 1, 0.7), (3, 1, 0, -0.2), (4, 1, 1, 0.4)],
                               "id INT, y INT, p INT, s DOUBLE")
    assert {r["weight"] for r in metrics.class_weights(df, "y").collect()} == {1.0}
    got = metrics.confident_errors(df, "y", "p", "s", "id", 1)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]
    assert sorted(r["id"] for r in metrics.first_errors(df, "y", "p", "id", 1).collect()) == [1, 3]


# ---- TF-IDF --------------------------------------------------------------------------------

DOCS = [(1, "good game good fun"), (2, "Bad game, no fun"), (3, "good fun élan_vital x"), (4, "")]


def plain_tfidf(docs, min_df=2):
    import re

    bags = {}
    for i, text in docs:
        words = re.findall(r"\b\w\w+\b", text.lower())
        bags[i] = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    df = Counter(term for bag in bags.values() for term in bag)
    out = {}
    for i, bag in bags.items():
        raw = {w: tf * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, tf in bag.items() if df[w] >= min_df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, w): x / norm for w, x in raw.items()})
    return out


def test_tfidf_against_plain_python(spark):
    df = spark.createDataFrame(DOCS, "id INT, t STRING")
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf(df, "id", "t").collect()}
    assert got == pytest.approx(plain_tfidf(DOCS))


def test_vocabulary_cut_and_score(spark):
    df = spark.createDataFrame(DOCS, "id INT, t STRING")
    totals = tfidf.term_totals(df, "t")
    n = df.agg(F.count(F.lit(1)).alias("n_docs"))
    assert [r["term"] for r in tfidf.vocabulary(totals, n, 2, 2).collect()] == ["fun", "good"]
    known = {r["term"]: (r["df"], r["total"]) for r in tfidf.vocabulary(totals, n, 1).collect()}
    assert known["good"] == (2, 3) and known["fun"] == (3, 3) and known["good fun"] == (2, 2)
    assert tfidf.vocabulary(totals, n, 9).count() == 0
    weights = spark.createDataFrame([(1, "good", 0.5), (1, "fun", 0.5), (2, "bad", 1.0)], "id INT, term STRING, weight DOUBLE")
    coefs = spark.createDataFrame([("good", 2.0), ("fun", 1.0), ("bad", -3.0)], "term STRING, coef DOUBLE")
    got = rows(tfidf.linear_score(df.select("id"), weights, coefs, "id", 0.1), "id")
    assert [x for _, x in got] == pytest.approx([1.6, -2.9, 0.1, 0.1])
    outcomes = spark.createDataFrame([(1, "TP"), (2, "FN")], "id INT, outcome STRING")
    contrib = tfidf.contributions(weights, coefs, outcomes, "id")
    assert rows(tfidf.discriminant_table(contrib, "TP", 1)) == [("good", 1.0)]
    assert rows(tfidf.discriminant_table(contrib, "FN")) == [("bad", -3.0)]
    top = tfidf.top_coefs(coefs, 1)
    assert sorted(rows(top)) == [("bad", -3.0, "bottom"), ("good", 2.0, "top")]


def test_signed_top_takes_the_farthest(spark):
    df = spark.createDataFrame([("a", -0.1), ("b", -5.0), ("c", 3.0), ("d", -2.0)], "word STRING, c DOUBLE")
    assert [r[0] for r in rows(tfidf.signed_top(df, "c", -1, 2))] == ["b", "d"]
    assert [r[0] for r in rows(tfidf.signed_top(df, "c", 1, 2))] == ["c"]
    assert [r[0] for r in rows(tfidf.sort_by_size(df, "c", absolute=True))] == ["b", "c", "d", "a"]


# ---- dataset, prompts, audits --------------------------------------------------------------

REVIEWS = [
    (1, 570, True, "x" * 30, 1), (2, 570, False, "x" * 30, 1), (3, 730, False, "x" * 30, 1),
    (4, 570, True, "y" * 29, 1), (5, 570, True, None, 1), (6, 999, True, "z" * 31, 1),
]


def test_dataset_and_prompt_batch(spark):
    reviews = spark.createDataFrame(REVIEWS, "id INT, app_id INT, recommended BOOLEAN, review_text STRING, votes_up INT")
    titles = spark.createDataFrame([(570, "Dota 2"), (730, "Counter-Strike 2")], "app_id INT, title STRING")
    data = build.build_dataset(reviews, titles)
    assert [tuple(r)[:4] for r in data.orderBy("id").collect()] == [
        (1, 570, "Dota 2", 9), (3, 730, "Counter-Strike 2", 3), (6, 999, None, 9)]
    batch = build.build_prompt_batch(data).collect()
    assert len(batch) == 6 and {r["generated_text"] for r in batch} == {""}
    untitled = [r["prompt"] for r in batch if r["app_id"] == 999 and r["method"] == "naive"]
    assert untitled == ['Write a Steam user review for the game "" with rating 9/10.']


def test_training_pairs(spark):
    data = [(i, "T", 9, " " + "w" * 90) for i in range(11)] + [
        (20, " ", 9, "w" * 90), (21, "T", 5, "w" * 90), (22, "T", 3, "w" * 79), (23, "T", 3, "w" * 1201)]
    df = spark.createDataFrame(data, "id INT, title STRING, rating INT, review_text STRING")
    pairs = build.training_pairs(df, exact=True).collect()
    assert len(pairs) == 11 and sum(r["split"] == "validation" for r in pairs) == 2
    assert {r["completion"] for r in pairs} == {"w" * 90}
    with pytest.raises(ValueError, match="title"):
        build.training_pairs(df.drop("title"))


def test_audit_prompts(spark):
    data = [(i, 570, 9 if i % 2 else 3, "naive", f'text "{i}"\n more') for i in range(120)]
    data += [(200, 730, 3, "engineered", "other"), (201, 570, 3, "naive", None), (202, 440, 3, "naive", "unknown app")]
    df = spark.createDataFrame(data, "id INT, app_id INT, rating INT, method STRING, generated_text STRING")
    meta = spark.createDataFrame([(570, "Dota 2", "D."), (730, "CS2", "C.")], "app_id INT, title STRING, description STRING")
    got = audit.audit_prompts(df, meta, "hallucination").orderBy("seq").collect()
    assert [(r["method"], r["app_id"], r["seq"]) for r in got] == [("naive", 570, 1), ("engineered", 730, 2)]
    assert '"total_reviews_checked": 50,' in got[0]["prompt"] and "OFFICIAL DESCRIPTION: D.\n" in got[0]["prompt"]
    assert got[0]["prompt"].count("[ID: ") == 50 and '[ID: 50] "text \'' in got[0]["prompt"]
    sentiment = audit.audit_prompts(df, meta, "sentiment").orderBy("rating").collect()
    assert [r["rating"] for r in sentiment] == [3, 9]
    assert all('"total_reviews_checked": 25,' in r["prompt"] for r in sentiment)
    with pytest.raises(ValueError):
        audit.audit_prompts(df, meta, "other")


def test_judge_block(spark):
    data = [(i, "naive", "n" * 400) for i in range(3)] + [(9, "engineered", "e"), (10, "engineered", None)]
    df = spark.createDataFrame(data, "id INT, method STRING, generated_text STRING")
    sample = audit.judge_sample(df, n=2)
    assert sorted((r["temp_id"], r["method"]) for r in sample.collect()) == [
        (0, "naive"), (1, "naive"), (2, "engineered")]
    got = audit.judge_block(sample).first()
    lines = got["block"].split(",\n")
    assert lines[0] == '{ "id": 0, "text": "' + "n" * 300 + '..." }' and lines[2] == '{ "id": 2, "text": "e..." }'
    assert "list of 3 video game reviews" in got["prompt"]


def test_quantiles_are_exact_at_every_bound(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(6)
    columns = {
        "distinct": [rng.gauss(0, 1e6) for _ in range(3000)], "hot": [7.0] * 2500 + [rng.random() for _ in range(500)],
        "steps": [float(rng.randrange(5)) for _ in range(999)], "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice([1, -1]) for _ in range(2000)],
        "two": [1.0, 2.0], "one": [5.0],
    }
    monkeypatch.setattr(stats, "BRACKET_ROWS", 20)
    monkeypatch.setattr(stats, "ACCURACY", 50)
    for name, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE").repartition(3)
        plain = df.agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)]))).first()[0]
        assert stats.quantiles(df, "v", (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)) == plain, name
        assert np.allclose(plain, np.quantile(values, (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)))
    assert stats.describe(spark.createDataFrame([(None,)], "v INT"), "v").first()["p50"] is None


def test_keyword_table(spark, monkeypatch):
    words = [(3, "ring", "late"), (1, "Elden", "first"), (2, "ring of", "second"), (4, "elden", "again"), (5, " ", "blank"), (6, None, "null"), (None, "x", "none")]
    words += [(100 + i, f"kw{i}q", f"d{i}") for i in range(10_000)]
    table = spark.createDataFrame(words, "priority INT, keyword STRING, description STRING")
    titles = spark.createDataFrame([(0, "ELDEN Ring"), (1, "a ring of x"), (2, "a ring"), (3, None), (4, "zkw77qz kw9999q"), (5, "nothing"), (6, "a ring")], "id INT, title STRING")
    want = ["first", "second", "late", "?", "d77", "?", "late"]
    for at_once in (50_000, 999):
        monkeypatch.setattr(joins, "KEYWORDS_AT_ONCE", at_once)
        got = joins.attach_keyword_description(titles, table, default="?").orderBy("id").collect()
        assert [r["description"] for r in got] == want and got[0].asDict().keys() == {"id", "title", "description"}
    none = joins.attach_keyword_description(titles, table.limit(0))
    assert {r["description"] for r in none.collect()} == {None}


def test_tfidf_counts_whole_texts_and_adds_up_repeated_ids(spark):
    """Weights are ready where a text is read; rows of one id, or of none, are one document, and no term list is shuffled."""
    from collections import Counter
    from math import log, sqrt

    from corpusloom.operators import tfidf

    texts = [(1, "Bee ant bee ant cow"), (2, "ant cow"), (2, "cow ant cow"), (None, "bee"), (None, "cow bee"), (3, None), (4, ""), (5, "élan ant é")]
    texts += [(i, f"ant bee w{i % 3} x{i}") for i in range(10, 40)]
    df = spark.createDataFrame(texts, "id INT, text STRING").repartition(3)
    words = lambda x: [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (x or "").lower()).split() if len(w) > 1]
    grams = lambda w: w + [" ".join(x) for x in zip(w, w[1:])] + [" ".join(x) for x in zip(w, w[1:], w[2:])]
    held, total, docs = Counter(), Counter(), {}
    for i, x in texts:
        held.update(set(grams(words(x))))
        total.update(grams(words(x)))
        docs.setdefault(i, Counter()).update(grams(words(x)))
    got = {r["term"]: (r["df"], r["total"]) for r in tfidf.term_totals(df, "text", 3).collect()}
    assert got == {g: (held[g], total[g]) for g in total}
    idf = {g: log((1 + len(texts)) / (1 + n)) + 1 for g, n in held.items() if n >= 2}
    want = {}
    for i, counts in docs.items():
        raw = {g: n * idf[g] for g, n in counts.items() if g in idf}
        want |= {(i, g): w / sqrt(sum(x * x for x in raw.values())) for g, w in raw.items()}
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf(df, "id", "text", 3).collect()}
    assert got == pytest.approx(want)
    unique = df.filter("id > 2")
    vocab = spark.createDataFrame(list(idf.items()), "term STRING, idf DOUBLE")
    plan = tfidf.weigh_texts(unique, vocab, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_distinct_grams_by_row(spark):
    """Counts of sorted numbers equal sets of grams, also where the numbers are renumbered because they grow too large."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [[], ["a"], ["a", "a"], None, *([f"w{i}" for i in rng.integers(0, 4 + 900 * (j % 2), 400)] for j in range(30))]
    want = lambda n: [[len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) for k in range(1, n + 1)] for w in (x or [] for x in rows)]
    for n in (3, 8):
        assert tfidf._distinct_by_row(pa.array(rows, pa.list_(pa.string())), n).tolist() == want(n)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "id INT, t ARRAY<STRING>").repartition(3)
    assert [r["n"] for r in df.select("id", tfidf.distinct_grams(F.col("t"), 3).alias("n")).orderBy("id").collect()] == want(3)
