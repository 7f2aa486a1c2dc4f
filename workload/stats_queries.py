"""Samples, splits, summaries and metrics: E1-E22, F2-F8, F12-F14."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusloom.functions import flags, text as tx
from corpusloom.operators import audit, guards, metrics, sampling, stats

from . import tables as t
from .registry import query, r6, rounded
from .tables import with_

HASH = "md5(concat_ws('|', '42', CAST(id AS VARCHAR)))"


# ---- samples -------------------------------------------------------------------------------

@query("f2_sample_per_group", with_("reviews", "filled") + f"""
    SELECT id, method, app_id FROM (
        SELECT *, row_number() OVER (PARTITION BY method, app_id ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 5""")
def f2(spark, sf):
    rows = t.filled(spark, sf).select("id", "method", "app_id")
    return sampling.sample_per_group(rows, ["method", "app_id"], 5, "id")


@query("f2_sample_of_fifty", with_("reviews", "filled") + f"""
    SELECT id, method, app_id FROM (
        SELECT *, row_number() OVER (PARTITION BY method, app_id ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 50""")
def f2_fifty(spark, sf):
    rows = t.filled(spark, sf).select("id", "method", "app_id")
    return sampling.sample_per_group(rows, ["method", "app_id"], 50, "id")


@query("f3_sample_per_app_and_rating", with_("reviews", "filled") + f"""
    SELECT id, app_id, rating FROM (
        SELECT *, row_number() OVER (PARTITION BY app_id, rating ORDER BY {HASH}, id) AS rn
        FROM filled WHERE method = 'naive')
    WHERE rn <= 25""")
def f3(spark, sf):
    rows = t.filled(spark, sf).filter("method = 'naive'").select("id", "app_id", "rating")
    return sampling.sample_per_group(rows, ["app_id", "rating"], 25, "id")


@query("f4_stratified", with_("reviews", "filled") + f"""
    SELECT id, method, CAST(row_number() OVER (ORDER BY m, {HASH}, id) - 1 AS INT) AS temp_id FROM (
        SELECT *, CASE method WHEN 'naive' THEN 1 WHEN 'engineered' THEN 2 ELSE 3 END AS m,
               row_number() OVER (PARTITION BY method ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 100""")
def f4(spark, sf):
    return audit.judge_sample(t.filled(spark, sf)).select("id", "method", "temp_id")


@query("f5_balanced", with_("reviews", "filled") + f"""
    SELECT id, rating FROM (
        SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 25""")
def f5(spark, sf):
    return sampling.sample_per_group(t.filled(spark, sf).select("id", "rating"), ["rating"], 25, "id")


@query("f6_sample_n", with_("reviews") + f"SELECT id FROM reviews ORDER BY {HASH}, id LIMIT 150")
def f6(spark, sf):
    return sampling.sample_n(t.reviews(spark, sf).select("id"), 150, "id")


@query("f7_split_flag", with_("reviews") + f"SELECT id, substr({HASH}, 1, 8) < '1999999a' AS is_test FROM reviews")
def f7(spark, sf):
    return t.reviews(spark, sf).select("id", sampling.split_flag("id").alias("is_test"))


@query("f7_split_exact", with_("reviews") + f"""
    SELECT id, row_number() OVER (ORDER BY {HASH}, id) <= (SELECT ceil(0.1 * count(*)) FROM reviews) AS is_test
    FROM reviews""")
def f7_exact(spark, sf):
    return sampling.split_exact(t.reviews(spark, sf).select("id"), "id")


@query("f8_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def f8(spark, sf):
    return sampling.head(t.table(spark, sf, "documents").select("doc_id", "lang"), 20, ["doc_id"])


# ---- summaries -----------------------------------------------------------------------------

JUDGED_SQL = r"""judged AS (
    SELECT *, CAST(rating >= 7 AS INT) AS target_label,
           CAST((rating >= 7) = (pred_label = 1) AS INT) AS compliant,
           CAST(word_count BETWEEN 100 AND 140 AS INT) AS length_ok_100_140
    FROM (SELECT id, method, rating, (length(generated_text) % 997) / 498.5 - 1 AS score,
                 1 / (1 + exp(-((length(generated_text) % 997) / 498.5 - 1))) AS pred_proba_recommended,
                 CAST((length(generated_text) % 997) / 498.5 - 1 >= 0 AS INT) AS pred_label,
                 len(regexp_extract_all(generated_text, '\S+')) AS word_count
          FROM filled WHERE regexp_matches(generated_text, '\S')))"""


def judged(spark, sf):
    from corpusloom.plans.evaluation import generation_rows

    score = (F.length("generated_text") % 997) / F.lit(498.5) - 1
    rows = guards.non_blank(t.filled(spark, sf), "generated_text").withColumn("score", score)
    return generation_rows(rows.withColumns({
        "pred_proba_recommended": flags.score_to_probability(F.col("score")),
        "pred_label": flags.score_to_label(F.col("score")),
    }))


@query("e1_judge_summary", with_("reviews", "filled") + "," + JUDGED_SQL + """
    SELECT method, count(*) AS n, round(avg(compliant), 6) AS compliance_rate,
           round(avg(pred_proba_recommended), 6) AS mean_pred_proba,
           round(avg(length_ok_100_140), 6) AS length_ok_rate, round(avg(word_count), 6) AS mean_word_count
    FROM judged GROUP BY method ORDER BY n DESC, method""")
def e1(spark, sf):
    return rounded(
        stats.judge_summary(judged(spark, sf)), "compliance_rate", "mean_pred_proba",
        "length_ok_rate", "mean_word_count",
    )


@query("f14_summary_order", with_("reviews", "filled") + "," + JUDGED_SQL + """
    SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, rating) AS BIGINT) AS place, rating, count(*) AS n FROM judged GROUP BY rating""")
def f14(spark, sf):
    """Groups numbered as the summary's rows come, so their order is seen."""
    rows = stats.judge_summary(judged(spark, sf), "rating").select("rating", "n").withColumn("at", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"), "rating", "n")


DIVERSITY_SQL = """div AS (
    SELECT id, method, lang, len(t) AS word_count,
           CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END AS d1,
           CASE WHEN len(b) > 0 THEN len(list_distinct(b)) / len(b) ELSE 0 END AS d2,
           CASE WHEN len(c) > 0 THEN (len(c) - len(list_distinct(c))) / len(c) ELSE 0 END AS rep
    FROM (SELECT id, method, lang, t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b,
                 list_transform(range(1, len(t) - 1),
                                lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS c
          FROM words) WHERE len(t) >= 1)"""


@query("e2_diversity_summary", with_("reviews", "filled", "words") + "," + DIVERSITY_SQL + """
    SELECT method, count(*) AS n, round(avg(word_count), 6) AS mean_word_count,
           round(avg(d1), 6) AS distinct1_mean, round(avg(d2), 6) AS distinct2_mean,
           round(avg(rep), 6) AS trigram_repeat_mean, CAST(NULL AS DOUBLE) AS inter_sim_mean
    FROM div GROUP BY method ORDER BY n DESC, method""")
def e2(spark, sf):
    from corpusloom.plans.evaluation import diversity_report, diversity_rows

    return rounded(
        diversity_report(diversity_rows(t.filled(spark, sf))), "mean_word_count", "distinct1_mean",
        "distinct2_mean", "trigram_repeat_mean",
    )


@query("e4_label_distribution", with_("reviews", "titles", "dataset") + """
    SELECT CAST(rating = 9 AS INT) AS label, count(*) AS count,
           round(count(*) / (SELECT count(*) FROM dataset), 6) AS proportion, 'train' AS dataset
    FROM dataset GROUP BY 1""")
def e4(spark, sf):
    from corpusloom.plans.dataset import build_dataset

    rows = build_dataset(t.reviews(spark, sf), t.titles(spark, sf)).withColumn(
        "recommended", flags.target(F.col("rating"), "is_9")
    )
    return rounded(stats.label_distribution(rows, "recommended", "train"), "proportion")


@query("e5_proportions", with_("reviews") + """
    SELECT app_id, round(avg(CASE WHEN recommended THEN 0 ELSE 1 END), 6) AS not_recommended,
           round(avg(CASE WHEN recommended THEN 1 ELSE 0 END), 6) AS recommended
    FROM reviews GROUP BY app_id""")
def e5(spark, sf):
    rows = t.reviews(spark, sf).withColumn("vote", F.col("recommended").cast("int"))
    return rounded(stats.proportions(rows, "app_id", "vote"), "not_recommended", "recommended")


@query("e6_describe", r"""
    SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
           round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50,
           round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS max
    FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents)""")
def e6(spark, sf):
    rows = guards.add_length_features(t.table(spark, sf, "documents").select("text"), "text")
    wide = rows.withColumn("n_words", F.col("n_words").cast("bigint"))
    return rounded(stats.describe(wide, "n_words"), "mean", "std", "p25", "p50", "p75")


@query("e7_means", r"""
    SELECT round(avg(len(list_distinct(w)) / len(w)), 6) AS lexical_diversity,
           round(avg(CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])la([^\p{L}\p{N}_]|$)')
                          THEN 1 ELSE 0 END), 6) AS has_word
    FROM (SELECT text, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def e7(spark, sf):
    rows = guards.add_lexical_features(t.table(spark, sf, "documents").select("text"), "text")
    means = stats.mean_of(
        rows, lexical_diversity=F.col("lexical_diversity"), has_word=tx.has_word(F.col("text"), "la")
    )
    return rounded(means, "lexical_diversity", "has_word")


@query("e8_top_words", r"""
    SELECT word, count(*) AS count FROM (
        SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents)
    GROUP BY word ORDER BY count DESC, word LIMIT 20""")
def e8(spark, sf):
    return stats.top_words(t.table(spark, sf, "documents").select("text"), "text")


@query("e9_confusion", with_("scored") + """
    SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
           count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn
    FROM scored""")
def e9(spark, sf):
    return metrics.confusion(t.scored(spark, sf), "y", "p")


REPORT_SQL = """
    c AS (SELECT cls, sum(CAST(y = cls AND p = cls AS INT)) AS hit, sum(CAST(p = cls AS INT)) AS said,
                 sum(CAST(y = cls AS INT)) AS support
          FROM scored, (VALUES (0), (1)) k(cls) GROUP BY cls),
    m AS (SELECT cls, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr,
                 CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re, hit, support FROM c),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


@query("e10_classification_report", with_("scored") + "," + REPORT_SQL + """
    SELECT CAST(cls AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall,
           round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6),
                     CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6),
                     round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                     CAST(sum(support) AS BIGINT) FROM f""")
def e10(spark, sf):
    return rounded(metrics.classification_report(t.scored(spark, sf), "y", "p"), "precision", "recall", "f1")


@query("e11_accuracy", with_("scored") + """
    SELECT 'all' AS method, round(avg(CAST(y = p AS INT)), 6) AS accuracy FROM scored
    UNION ALL SELECT method, round(avg(CAST(y = p AS INT)), 6) FROM scored GROUP BY method""")
def e11(spark, sf):
    rows = t.scored(spark, sf)
    overall = metrics.accuracy(rows, "y", "p").withColumn("method", F.lit("all"))
    return rounded(overall.unionByName(metrics.accuracy(rows, "y", "p", "method")), "accuracy")


AUC_SQL = """
    k AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score),
    below AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                AND 1 PRECEDING), 0) AS lower_neg FROM k)"""


@query("e12_roc_auc", with_("scored") + "," + AUC_SQL + """
    SELECT round(sum(pos * (lower_neg + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM below""")
def e12(spark, sf):
    return rounded(metrics.roc_auc(t.scored(spark, sf), "y", "score"), "roc_auc")


@query("e13_class_weights", with_("scored") + """
    SELECT id, y, round((SELECT count(*) FROM scored) / (2 * count(*) OVER (PARTITION BY y)), 6) AS weight
    FROM scored""")
def e13(spark, sf):
    return rounded(metrics.class_weights(t.scored(spark, sf).select("id", "y"), "y"), "weight")


@query("b5_metrics_table", with_("scored") + "," + REPORT_SQL + "," + AUC_SQL + """,
    lines AS (
        SELECT CAST(cls AS VARCHAR) AS class, pr, re, f1, support FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),
                         sum(f1 * support) / sum(support), sum(support) FROM f)
    SELECT 'length' AS model, metric, class, round(value, 6) AS value FROM (
        SELECT 'threshold' AS metric, NULL AS class, CAST(0 AS DOUBLE) AS value
        UNION ALL SELECT 'roc_auc', NULL, sum(pos * (lower_neg + neg / 2)) / (sum(pos) * sum(neg)) FROM below
        UNION ALL SELECT 'precision', class, pr FROM lines
        UNION ALL SELECT 'recall', class, re FROM lines
        UNION ALL SELECT 'f1', class, f1 FROM lines
        UNION ALL SELECT 'support', class, support FROM lines)
    WHERE value IS NOT NULL""")
def b5(spark, sf):
    return rounded(metrics.metrics_table(t.scored(spark, sf), "y", "p", "score", "length"), "value")


@query("e15_histogram", with_("scored") + """,
    o AS (SELECT score, CASE WHEN y = 1 AND p = 1 THEN 'TP' WHEN y = 0 AND p = 1 THEN 'FP'
                             WHEN y = 0 THEN 'TN' ELSE 'FN' END AS outcome FROM scored),
    s AS (SELECT outcome, CASE WHEN min(score) < max(score) THEN min(score) ELSE min(score) - 0.5 END AS lo,
                 CASE WHEN min(score) < max(score) THEN max(score) ELSE max(score) + 0.5 END AS hi
          FROM o GROUP BY outcome),
    b AS (SELECT o.outcome, least(CAST(floor((score - lo) * (30 / (hi - lo))) AS INT), 29) AS bin, count(*) AS n
          FROM o JOIN s ON o.outcome = s.outcome GROUP BY ALL)
    SELECT s.outcome, CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 30, 6) AS bin_lo,
           round(lo + (i + 1) * (hi - lo) / 30, 6) AS bin_hi, coalesce(n, 0) AS count
    FROM s CROSS JOIN range(0, 30) r(i) LEFT JOIN b ON b.outcome = s.outcome AND b.bin = i""")
def e15(spark, sf):
    rows = t.scored(spark, sf).withColumn("outcome", flags.outcome(F.col("y"), F.col("p")))
    return rounded(stats.histogram(rows, "score", 30, "outcome"), "bin_lo", "bin_hi")


CLEAN_SQL = r"""replace(regexp_replace(trim({0}, E' \t\n\r'), '\s+', ' ', 'g'), '"', '''')"""


@query("e16_numbered_block", with_("reviews", "filled") + f"""
    SELECT method, app_id, count(*) AS n,
           md5(string_agg('[ID: ' || rn || '] "' || {CLEAN_SQL.format('generated_text')} || '"', E'\\n' ORDER BY rn)) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY method, app_id ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 50 GROUP BY method, app_id""")
def e16(spark, sf):
    blocks = audit.numbered_block(t.filled(spark, sf), ["method", "app_id"], "generated_text", "id")
    return blocks.withColumn("block", F.md5(F.col("block").cast("binary")))


@query("e17_judge_block", with_("reviews", "filled") + f"""
    SELECT count(*) AS n, string_agg('{{ "id": ' || temp_id || ', "text": "' ||
           {CLEAN_SQL.format('substr(generated_text, 1, 300)')} || '..." }}', E',\\n' ORDER BY temp_id) AS block
    FROM (SELECT generated_text, row_number() OVER (ORDER BY m, {HASH}, id) - 1 AS temp_id FROM (
            SELECT *, CASE method WHEN 'naive' THEN 1 WHEN 'engineered' THEN 2 ELSE 3 END AS m,
                   row_number() OVER (PARTITION BY method ORDER BY {HASH}, id) AS rn FROM filled)
          WHERE rn <= 100)""")
def e17(spark, sf):
    return audit.judge_block(audit.judge_sample(t.filled(spark, sf))).select("n", "block")


VERDICT_SQL = f"""picked AS (
    SELECT method AS approach, 'app ' || app_id AS game, rn, length(generated_text) % 3 = 0 AS bad
    FROM (SELECT *, row_number() OVER (PARTITION BY method, app_id ORDER BY {HASH}, id) AS rn FROM filled)
    WHERE rn <= 50),
    verdicts AS (
        SELECT approach, game, count(*) AS checked, count(*) FILTER (WHERE bad) AS failed,
               round(100 * count(*) FILTER (WHERE bad) / count(*), 1) / 100 AS declared
        FROM picked GROUP BY approach, game)"""


def _verdicts(spark, sf):
    """Sampled batches judged by a rule, as a judge would write them down."""
    by = ["method", "app_id"]
    rows = t.filled(spark, sf)
    picked = sampling.sample_per_group(rows, by, 50, "id").withColumn(
        "i", F.row_number().over(sampling.sample_order(by, "id"))
    )
    bad = F.length("generated_text") % 3 == 0
    return picked.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("checked"), F.count_if(bad).cast("int").alias("failed"),
        F.sort_array(F.collect_list(F.when(bad, F.col("i")))).alias("ids"),
    ).select(
        F.lit("structure").alias("task"), F.col("method").alias("approach"),
        F.concat(F.lit("app "), F.col("app_id").cast("string")).alias("game"), "checked", "failed",
        (F.round(100 * F.col("failed") / F.col("checked"), 1) / 100).alias("declared"),
        "ids", F.lit(None).cast("int").alias("target_rating"),
    )


@query("e18_verdict_rates", with_("reviews", "filled") + "," + VERDICT_SQL + """
    SELECT 'structure' AS task, approach, game, CAST(checked AS BIGINT) AS checked,
           CAST(failed AS BIGINT) AS failed, round(failed / checked, 6) AS rate,
           round(declared, 6) AS declared, true AS ids_match, round(failed / checked, 6) AS pooled FROM verdicts
    UNION ALL SELECT 'structure', approach, NULL, CAST(sum(checked) AS BIGINT), CAST(sum(failed) AS BIGINT),
                     round(avg(failed / checked), 6), round(avg(declared), 6), true,
                     round(sum(failed) / sum(checked), 6)
              FROM verdicts GROUP BY approach""")
def e18(spark, sf):
    return rounded(audit.verdict_rates(_verdicts(spark, sf)), "rate", "declared", "pooled")


@query("e18_all_tasks", with_("reviews", "filled") + "," + VERDICT_SQL + """,
    told AS (
        SELECT task, approach, game, checked, failed, CASE WHEN task = 'spoilers' THEN 1 ELSE 0 END AS more,
               CASE WHEN task = 'negative_positive'
                    THEN 1 - round(100 * (checked - failed) / checked, 1) / 100 ELSE declared END AS declared
        FROM verdicts, (VALUES ('hallucinations'), ('structure'), ('spoilers'), ('negative_positive')) v(task)),
    rates AS (SELECT task, approach, game, checked, failed, failed / checked AS rate, declared, more = 0 AS ids_match FROM told)
    SELECT task, approach, game, CAST(checked AS BIGINT) AS checked, CAST(failed AS BIGINT) AS failed, round(rate, 6) AS rate,
           round(declared, 6) AS declared, ids_match, round(failed / checked, 6) AS pooled FROM rates
    UNION ALL SELECT task, approach, NULL, CAST(sum(checked) AS BIGINT), CAST(sum(failed) AS BIGINT), round(avg(rate), 6),
                     round(avg(declared), 6), bool_and(ids_match), round(sum(failed) / sum(checked), 6)
              FROM rates GROUP BY task, approach""")
def e18_all(spark, sf):
    """Verdict texts of all four tasks, parsed, normalised and rolled up; spoilers list an id too many."""
    from corpusloom.sources import readers

    rows = _verdicts(spark, sf)
    share = lambda n: F.concat(F.round(100 * n / F.col("checked"), 1).cast("string"), F.lit("%"))
    right = F.col("checked") - F.col("failed")
    names = {"hallucinations": ("hallucination_count", "hallucination_percentage", "hallucinated_ids"),
             "structure": ("structure_failure_count", "structure_failure_percentage", "failed_ids"),
             "spoilers": ("fake_spoiler_count", "fake_spoiler_percentage", "fake_spoiler_ids"),
             "negative_positive": ("correct_sentiment_count", "accuracy_percentage", "failed_ids")}
    texts = []
    for task, (count, percent, ids) in names.items():
        said = right if task == "negative_positive" else F.col("failed")
        listed = F.concat("ids", F.array(F.lit(0))) if task == "spoilers" else F.col("ids")
        text = F.to_json(F.struct(
            "game", F.col("checked").alias("total_reviews_checked"), said.alias(count), share(said).alias(percent), listed.alias(ids)
        ))
        grouped = rows.groupBy("approach").agg(F.array_join(F.collect_list(text), "\n").alias("value"))
        texts.append(grouped.withColumn("task", F.lit(task)))
    every = texts[0]
    for more in texts[1:]:
        every = every.unionByName(more)
    found = audit.normalise_verdicts(readers.parse_verdicts(every))
    return rounded(audit.verdict_rates(found), "rate", "declared", "pooled")


@query("e18_failed_ids", with_("reviews", "filled") + "," + VERDICT_SQL + """
    SELECT 'structure' AS task, approach, game, CAST(rn AS INT) AS id
    FROM picked WHERE bad""")
def e18_ids(spark, sf):
    return audit.failed_ids(_verdicts(spark, sf)).drop("target_rating")


@query("e19_cleaning_report", with_("reviews", "titles", "dataset") + """
    SELECT (SELECT count(*) FROM reviews) AS rows_before, (SELECT count(*) FROM dataset) AS rows_after""")
def e19(spark, sf):
    from corpusloom.plans.dataset import build_dataset

    raw = t.reviews(spark, sf)
    return guards.cleaning_report(raw, build_dataset(raw, t.titles(spark, sf)))


@query("e20_distinct_values", "SELECT DISTINCT source FROM documents")
def e20(spark, sf):
    return stats.distinct_values(t.table(spark, sf, "documents"), "source")


@query("e21_generation_check", r"""
    SELECT count(*) AS rows, round(avg(n), 6) AS mean_words,
           round(avg(CASE WHEN n BETWEEN 100 AND 140 THEN 1 ELSE 0 END), 6) AS share_100_140
    FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents)""")
def e21(spark, sf):
    return rounded(stats.generation_check(t.table(spark, sf, "documents"), "text"), "mean_words", "share_100_140")


@query("e22_prompt_counts", with_("reviews", "titles", "dataset") + """
    SELECT app_id, title, rating, CAST(unnest(range(1, least(20, n) + 1)) AS INT) AS slot
    FROM (SELECT app_id, title, rating, count(*) AS n FROM dataset GROUP BY app_id, title, rating)""")
def e22(spark, sf):
    from corpusloom.plans.dataset import build_dataset

    return stats.prompt_counts(build_dataset(t.reviews(spark, sf), t.titles(spark, sf)), 20)


@query("e22_prompt_counts_at_quota", with_("reviews", "titles", "dataset") + """
    SELECT app_id, title, rating, CAST(unnest(range(1, least(1000, n) + 1)) AS INT) AS slot
    FROM (SELECT app_id, title, rating, count(*) AS n FROM dataset GROUP BY app_id, title, rating)""")
def e22_quota(spark, sf):
    from corpusloom.plans.dataset import build_dataset

    return stats.prompt_counts(build_dataset(t.reviews(spark, sf), t.titles(spark, sf)), 1000)


# ---- errors --------------------------------------------------------------------------------

@query("f12_confident_errors", with_("scored") + """
    (SELECT id, round(score, 6) AS score, 'FP' AS outcome FROM scored WHERE y = 0 AND p = 1
     ORDER BY score DESC, id LIMIT 5)
    UNION ALL
    (SELECT id, round(score, 6), 'FN' FROM scored WHERE y = 1 AND p = 0 ORDER BY score, id LIMIT 5)""")
def f12(spark, sf):
    errors = metrics.confident_errors(t.scored(spark, sf), "y", "p", "score", "id")
    return errors.select("id", r6("score"), "outcome")


@query("f13_first_errors", with_("scored") + """
    (SELECT id, 'FP' AS outcome FROM scored WHERE y = 0 AND p = 1 ORDER BY id LIMIT 10)
    UNION ALL (SELECT id, 'FN' FROM scored WHERE y = 1 AND p = 0 ORDER BY id LIMIT 10)""")
def f13(spark, sf):
    return metrics.first_errors(t.scored(spark, sf), "y", "p", "id").select("id", "outcome")
