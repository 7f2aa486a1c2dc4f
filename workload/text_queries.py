"""Payloads, guards, projections and text functions: A5-A9, C1-C21, F1, G1-G18."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed_texts as T, flags, prompts, text as tx
from corpusloom.operators import dedup, guards, joins, sampling
from corpusloom.sizing import spread
from corpusloom.sources import readers

from . import tables as t
from .registry import query, r6
from .tables import with_


# ---- payloads ------------------------------------------------------------------------------

@query("a4_verdict_objects", with_("reviews") + """
    SELECT id, 0 AS pos, 'app ' || app_id AS game, CAST(50 AS INT) AS checked,
           CAST(votes_up AS INT) AS failed FROM reviews
    UNION ALL
    SELECT id, 1, 'app ' || app_id, CAST(25 AS INT), CAST(25 - votes_up AS INT) FROM reviews""")
def a4(spark, sf):
    from corpusloom.operators.audit import normalise_verdicts

    game = F.concat(F.lit("app "), F.col("app_id").cast("string")).alias("game")
    first = F.to_json(F.struct(
        game, F.lit(50).alias("total_reviews_checked"), F.col("votes_up").alias("fake_spoiler_count"),
        F.col("review_text").alias("analysis"),
    ))
    second = F.to_json(F.struct(
        game, F.lit(25).alias("total_reviews_checked"), F.col("votes_up").alias("correct_sentiment_count"),
    ))
    texts = t.reviews(spark, sf).select(
        "id", F.concat(first, F.lit("\n"), second).alias("value"), F.lit("x").alias("task"),
        F.lit("y").alias("approach"),
    )
    parsed = readers.parse_verdicts(texts)
    keyed = parsed.withColumn("task", F.col("id").cast("string")).withColumn("approach", F.col("pos").cast("string"))
    return normalise_verdicts(keyed).select(
        F.col("task").cast("bigint").alias("id"), F.col("approach").cast("int").alias("pos"),
        "game", "checked", "failed",
    )


@query("a5_flatten_review_pages", with_("reviews") + """
    SELECT app_id, id, CAST(0 AS INT) AS pos, recommended, review_text, votes_up FROM reviews
    UNION ALL
    SELECT app_id, id, CAST(1 AS INT), NOT recommended, '', votes_up + 1 FROM reviews""")
def a5(spark, sf):
    own = F.struct(
        F.col("recommended").alias("voted_up"), F.col("review_text").alias("review"), "votes_up"
    )
    bare = F.struct(
        (~F.col("recommended")).alias("voted_up"), F.lit(None).cast("string").alias("review"),
        (F.col("votes_up") + 1).alias("votes_up"),
    )
    page = F.to_json(F.struct(F.array(own, bare).alias("reviews"), F.lit("*").alias("cursor")))
    pages = t.reviews(spark, sf).select("app_id", "id", page.alias("value"))
    return readers.flatten_review_pages(pages)


@query("a6_flatten_app_details", r"""
    SELECT CAST(page_id AS INT) AS app_id, url AS title,
           regexp_replace(html, '<[^\n]*?>', '', 'g') AS description
    FROM pages WHERE page_id % 3 <> 0""")
def a6(spark, sf):
    app = F.struct(
        (F.col("page_id") % 3 != 0).alias("success"),
        F.struct(F.col("url").alias("name"), F.col("html").alias("short_description")).alias("data"),
    )
    payload = F.to_json(F.create_map(F.col("page_id").cast("string"), app))
    return readers.flatten_app_details(t.table(spark, sf, "pages").select(payload.alias("value")))


@query("a7_cap_per_key", with_("reviews") + """
    SELECT app_id, id FROM (
        SELECT app_id, id, row_number() OVER (PARTITION BY app_id ORDER BY id) AS rn FROM reviews)
    WHERE rn <= 20""")
def a7(spark, sf):
    rows = t.reviews(spark, sf).select("app_id", "id")
    return sampling.cap_per_key(rows, "app_id", ["id"], 20)


@query("a7_cap_at_quota", with_("reviews") + """
    SELECT app_id, id FROM (
        SELECT app_id, id, row_number() OVER (PARTITION BY app_id ORDER BY id) AS rn FROM reviews)
    WHERE rn <= 2000""")
def a7_quota(spark, sf):
    rows = t.reviews(spark, sf).select("app_id", "id")
    return sampling.cap_per_key(rows, "app_id", ["id"], 2000)


@query("a8_a10_guards",
       "SELECT 'unknown' AS method, lang, count(*) AS n FROM documents GROUP BY lang")
def a9(spark, sf):
    docs = guards.require_columns(t.table(spark, sf, "documents"), ["doc_id", "text", "lang"])
    docs = guards.require_nonempty(docs, "no documents")
    return guards.ensure_column(docs, "method").groupBy("method", "lang").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- projections and filters ---------------------------------------------------------------

@query("c1_clean_text_col", """
    SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def c1(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id")
    labels = t.table(spark, sf, "labels").select("doc_id", "quality")
    return guards.clean_text_col(docs.join(labels, "doc_id", "left"), "quality")


@query("c2_non_blank", r"""
    SELECT page_id, replace(url, '/', ' ') AS path FROM pages
    WHERE regexp_matches(regexp_replace(html, '<[^\n]*?>', '', 'g'), '\S')""")
def c2(spark, sf):
    pages = t.table(spark, sf, "pages").withColumn("text", tx.strip_tags(F.col("html")))
    return guards.non_blank(pages, "text").select(
        "page_id", F.replace("url", F.lit("/"), F.lit(" ")).alias("path")
    )


@query("c3_char_length_between",
       "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 80 AND 1200")
def c3(spark, sf):
    docs = t.table(spark, sf, "documents")
    return docs.filter(tx.char_length_between(F.col("text"), 80, 1200)).select(
        "doc_id", F.length("text").cast("bigint").alias("n")
    )


@query("c4_min_words", r"""
    SELECT doc_id FROM documents
    WHERE len(regexp_extract_all(text, '\S+')) >= 20
      AND len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) >= 25""")
def c4(spark, sf):
    docs = guards.min_words(t.table(spark, sf, "documents"), "text", 20, "ws")
    return guards.min_words(docs, "text", 25, "words").select("doc_id")


@query("c5_keep_in", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def c5(spark, sf):
    return guards.keep_in(t.table(spark, sf, "documents"), "lang", ["fr", "de"]).select("doc_id", "lang")


@query("c6_equality_selection", with_("reviews", "filled") + """
    SELECT id, app_id FROM filled WHERE method = 'naive' AND app_id = 7 AND rating = 9""")
def c6(spark, sf):
    rows = t.filled(spark, sf)
    return rows.filter("method = 'naive' AND app_id = 7 AND rating = 9").select("id", "app_id")


@query("c7_drop_null", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL""")
def c7(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id")
    labels = t.table(spark, sf, "labels").select("doc_id", "quality")
    return guards.drop_null(docs.join(labels, "doc_id", "left"), "quality")


@query("c8_c9_rating_and_targets", with_("reviews") + """
    SELECT id, rating, CAST(rating > 5 AS INT) AS above_5, CAST(rating >= 7 AS INT) AS at_least_7,
           CAST(rating = 9 AS INT) AS is_9
    FROM (SELECT id, CASE WHEN recommended THEN 9 ELSE 3 END AS rating FROM reviews)""")
def c8(spark, sf):
    rows = t.reviews(spark, sf).select("id", flags.to_rating(F.col("recommended")).alias("rating"))
    return rows.select("id", "rating", *[
        flags.target(F.col("rating"), rule).alias(rule) for rule in flags.TARGET_RULES
    ])


@query("c10_c11_project_and_tag", with_("reviews", "filled") + """
    SELECT app_id, rating, method, 'Train' AS dataset FROM filled""")
def c10(spark, sf):
    kept = guards.project_present(t.filled(spark, sf), ["app_id", "title", "rating", "method"])
    return guards.tag(kept, "dataset", "Train")


@query("c12_recode", """
    SELECT doc_id, CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS lang
    FROM documents""")
def c12(spark, sf):
    names = {"fr": "French", "de": "German"}
    return t.table(spark, sf, "documents").select("doc_id", flags.recode(F.col("lang"), names).alias("lang"))


@query("c13_c16_flags", with_("scored") + """
    SELECT id, round(1 / (1 + exp(-score)), 6) AS pred_proba, CAST(score >= 0 AS INT) AS pred_label,
           CAST(1 / (1 + exp(-score)) >= 0.5 AS INT) AS proba_label,
           CAST((score >= 0) = (y = 1) AS INT) AS compliant, CAST(score >= 0.9 AS INT) AS overlap,
           CAST(score * 100 BETWEEN 10 AND 14 AS INT) AS in_range
    FROM scored""")
def c13(spark, sf):
    rows = t.scored(spark, sf)
    score = F.col("score")
    label = flags.score_to_label(score)
    return rows.select(
        "id", r6(flags.score_to_probability(score)).alias("pred_proba"), label.alias("pred_label"),
        flags.probability_to_label(flags.score_to_probability(score)).alias("proba_label"),
        flags.equal_flag(label, F.col("y")).alias("compliant"),
        flags.overlap_flag(score).alias("overlap"),
        flags.range_flag(score * 100, 10, 14).alias("in_range"),
    )


@query("c17_dense_id", """
    SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_id FROM documents""")
def c17(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.dense_id(docs, ["lang", "doc_id"])


@query("c18_expand_methods", with_("reviews") + """
    SELECT id, m.method, CASE m.method WHEN 'naive' THEN 'N ' ELSE 'E ' END || app_id AS prompt,
           '' AS generated_text
    FROM reviews CROSS JOIN (VALUES ('naive'), ('engineered')) m(method)""")
def c18(spark, sf):
    app = F.col("app_id").cast("string")
    rows = joins.expand_methods(t.reviews(spark, sf).select("id", "app_id"), {
        "naive": F.concat(F.lit("N "), app), "engineered": F.concat(F.lit("E "), app),
    })
    return rows.drop("app_id")


@query("c19_c20_text_features", r"""
    SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, len(list_distinct(w)) AS unique_words,
           round(len(list_distinct(w)) / len(w), 6) AS lexical_diversity
    FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def c19(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    rows = guards.add_lexical_features(guards.add_length_features(docs, "text"), "text")
    return rows.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_chars", "n_words", "unique_words")],
        r6("lexical_diversity"),
    )


@query("c21_has_word", r"""
    SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE
        regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)')) AS BIGINT) AS with_word
    FROM documents GROUP BY lang""")
def c21(spark, sf):
    return t.table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tx.has_word(F.col("text"), "the")).alias("with_word")
    )


@query("f1_dedup_first", """
    SELECT min(doc_id) AS doc_id, source, md5(text) AS h FROM documents GROUP BY source, text""")
def f1(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "source", "text")
    unique = dedup.dedup_first(docs, ["source", "text"], "doc_id", text_col="text")
    return unique.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))


# ---- tokens and n-grams --------------------------------------------------------------------

@query("g1_word_tokens", with_("reviews", "filled", "words") + """
    SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS exact,
           md5(lower(array_to_string(t, ' '))) AS lowered FROM words""")
def g1(spark, sf):
    text = F.col("generated_text")
    return t.filled(spark, sf).select(
        "id", F.size(tx.word_tokens(text)).cast("bigint").alias("n"),
        F.md5(F.array_join(tx.word_tokens(text), " ").cast("binary")).alias("exact"),
        F.md5(F.array_join(tx.word_tokens(text, lower=True), " ").cast("binary")).alias("lowered"),
    )


@query("g2_ws_tokens", r"""
    SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n,
           md5(array_to_string(regexp_extract_all(text, '\S+'), '|')) AS tokens FROM documents""")
def g2(spark, sf):
    text = F.col("text")
    return t.table(spark, sf, "documents").select(
        "doc_id", tx.ws_word_count(text).cast("bigint").alias("n"),
        F.md5(F.array_join(tx.ws_tokens(text), "|").cast("binary")).alias("tokens"),
    )


@query("g3_ngrams", with_("reviews", "filled", "words") + """
    SELECT gram, count(*) AS n FROM (
        SELECT unnest(list_transform(range(1, len(t) - 1),
                      lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram
        FROM words) GROUP BY gram HAVING count(*) > 1""")
def g3(spark, sf):
    tokens = spread(t.filled(spark, sf)).select(tx.word_tokens(F.col("generated_text")).alias("_t"))
    grams = tokens.select(F.explode(tx.ngrams(F.col("_t"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("g4_g6_diversity_ratios", with_("reviews", "filled", "words") + """
    SELECT id, len(t) AS word_count,
           round(CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END, 6) AS distinct_1,
           round(CASE WHEN len(b) > 0 THEN len(list_distinct(b)) / len(b) ELSE 0 END, 6) AS distinct_2,
           round(CASE WHEN len(c) > 0 THEN (len(c) - len(list_distinct(c))) / len(c) ELSE 0 END, 6)
               AS trigram_repeat_rate
    FROM (SELECT id, t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b,
                 list_transform(range(1, len(t) - 1),
                                lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS c
          FROM words)
    WHERE len(t) >= 1""")
def g4(spark, sf):
    from corpusloom.plans.evaluation import diversity_rows

    return diversity_rows(t.filled(spark, sf)).select(
        "id", F.col("word_count").cast("bigint").alias("word_count"), r6("distinct_1"),
        r6("distinct_2"), r6("trigram_repeat_rate"),
    )


# ---- cleaning ------------------------------------------------------------------------------

@query("g7_g11_clean_and_snippet", r"""
    SELECT conv_id, turn, md5(c) AS cleaned,
           replace(regexp_replace(trim(substr(text, 1, 300), E' \t\n\r'), '\s+', ' ', 'g'), '"', '''')
               || '...' AS snippet
    FROM (SELECT *, replace(regexp_replace(trim(text, E' \t\n\r'), '\s+', ' ', 'g'), '"', '''') AS c
          FROM conversations)""")
def g7(spark, sf):
    text = F.col("text")
    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(tx.clean_text(text).cast("binary")).alias("cleaned"),
        tx.snippet(text, 300).alias("snippet"),
    )


@query("g8_strip_tags", r"""
    SELECT page_id, length(regexp_replace(html, '<[^\n]*?>', '', 'g')) AS n,
           md5(regexp_replace(html, '<[^\n]*?>', '', 'g')) AS h FROM pages""")
def g8(spark, sf):
    plain = tx.strip_tags(F.col("html"))
    return t.table(spark, sf, "pages").select(
        "page_id", F.length(plain).cast("bigint").alias("n"), F.md5(plain.cast("binary")).alias("h")
    )


@query("g9_g10_generated_cleaning", r"""
    SELECT conv_id, turn, md5(trim(text, E' \t\n\r')) AS no_label, md5(trim(text, E' \t\n\r')) AS after_colon,
           md5(trim(text, E' \t\n\r')) AS no_echo, md5(trim(text, E' \t\n\r')) AS untouched
    FROM conversations""")
def g9(spark, sf):
    text = F.col("text")
    rows = t.table(spark, sf, "conversations")
    prompt = F.concat(F.lit("Q "), F.col("role"), F.lit(": "))

    def h(c):
        return F.md5(c.cast("binary"))

    return rows.select(
        "conv_id", "turn",
        h(tx.clean_generated(F.concat(F.lit("  REVIEW : "), text))).alias("no_label"),
        h(tx.after_review_colon(F.concat(F.lit("\tReview:"), text))).alias("after_colon"),
        h(tx.strip_prompt(F.concat(prompt, text), prompt)).alias("no_echo"),
        h(tx.strip_prompt(text, prompt)).alias("untouched"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_fill(template: str, **values: str) -> str:
    """The template with every {name} replaced by a SQL expression."""
    out = _sql_text(template)
    for name, expr in values.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


@query("g12_g14_prompts", with_("reviews", "titles", "dataset") + f"""
    SELECT id, {_sql_fill(T.NAIVE_PROMPT, title="title", rating="CAST(rating AS VARCHAR)")} AS naive,
           md5({_sql_fill(T.ENGINEERED_PROMPT, title="title", rating="CAST(rating AS VARCHAR)",
                          description="'About ' || title",
                          points=f"CASE WHEN rating >= 7 THEN {_sql_text(T.POINTS_MOSTLY_LIKED)} "
                                 f"ELSE {_sql_text(T.POINTS_MOSTLY_DISLIKED)} END")}) AS engineered,
           {_sql_fill(T.TRAINING_PROMPT, title="title", rating="CAST(rating AS VARCHAR)",
                      sentiment="CASE WHEN rating >= 7 THEN 'positive' ELSE 'negative' END")} AS training
    FROM (SELECT id, rating, coalesce(title, '') AS title FROM dataset)""")
def g12(spark, sf):
    from corpusloom.plans.dataset import build_dataset

    rows = build_dataset(t.reviews(spark, sf), t.titles(spark, sf)).withColumn(
        "title", tx.as_text(F.col("title"))
    )
    title, rating = F.col("title"), F.col("rating")
    about = F.concat(F.lit("About "), title)
    return rows.select(
        "id", prompts.naive_prompt(title, rating).alias("naive"),
        F.md5(prompts.engineered_prompt(title, rating, about).cast("binary")).alias("engineered"),
        prompts.training_prompt(title, rating).alias("training"),
    )


@query("g16_g17_training_text", r"""
    SELECT doc_id, md5(rtrim(source || E' \n\t', E' \n\t') || E'\n' || trim(text, E' \t\n\r')) AS h,
           lower(lang) AS lang FROM documents""")
def g16(spark, sf):
    padded = F.concat("source", F.lit(" \n\t"))
    text = tx.training_text(padded, F.concat(F.lit("\t "), "text", F.lit(" \n")))
    return t.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.cast("binary")).alias("h"),
        F.lower(tx.strip(F.concat(F.lit("\t"), "lang"))).alias("lang"),
    )


@query("g18_percent_value", "SELECT doc_id, round((n_chars % 1001) / 1000.0, 6) AS value FROM documents")
def g18(spark, sf):
    pct = F.concat(((F.col("n_chars") % 1001) / 10).cast("string"), F.lit("%"))
    return t.table(spark, sf, "documents").select("doc_id", r6(tx.percent_value(pct)).alias("value"))
