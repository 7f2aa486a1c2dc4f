"""Whole flows and round trips through files: dataset, prompts, pairs, reports, A1-A4, B1-B6, I3."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed_texts as T, text as tx
from corpusloom.operators import audit, judge, tfidf
from corpusloom.operators.stats import judge_summary
from corpusloom.plans import dataset as build, evaluation
from corpusloom.session import cut_lineage, scratch_path
from corpusloom.sources import readers, sinks
from corpusloom.streaming.incremental import run_batch, run_incremental

from . import tables as t
from .join_queries import _knn_sql
from .model_queries import _labelled
from .registry import query, rounded
from .stats_queries import CLEAN_SQL, DIVERSITY_SQL, HASH
from .tables import with_
from .text_queries import _sql_fill, _sql_text


def _md5(c):
    return F.md5(F.col(c).cast("binary")).alias(c)


def _dataset(spark, sf):
    return build.build_dataset(t.reviews(spark, sf), t.titles(spark, sf))


@query("dataset_build", with_("reviews", "titles", "dataset") + """
    SELECT id, app_id, title, rating, review_text FROM dataset""")
def dataset_build(spark, sf):
    return _dataset(spark, sf)


def _description_sql() -> str:
    by_kw = "".join(
        f" WHEN contains(lower(title), {_sql_text(k)}) THEN {_sql_text(T.DESCRIPTION_BY_APP[a])}"
        for k, a in T.APP_BY_TITLE_KEYWORD.items()
    )
    return f"CASE{by_kw} ELSE {_sql_text(T.DEFAULT_DESCRIPTION)} END"


@query("prompt_batch", with_("reviews", "titles", "dataset") + f"""
    SELECT app_id, title, rating, slot, method, md5(CASE method WHEN 'naive' THEN
             {_sql_fill(T.NAIVE_PROMPT, title="title", rating="CAST(rating AS VARCHAR)")}
             ELSE {_sql_fill(T.ENGINEERED_PROMPT, title="title", rating="CAST(rating AS VARCHAR)",
                             description=_description_sql(),
                             points=f"CASE WHEN rating >= 7 THEN {_sql_text(T.POINTS_MOSTLY_LIKED)} "
                                    f"ELSE {_sql_text(T.POINTS_MOSTLY_DISLIKED)} END")} END) AS prompt,
           '' AS generated_text
    FROM (SELECT app_id, coalesce(title, '') AS title, rating, CAST(unnest(range(1, least(1000, n) + 1)) AS INT) AS slot
          FROM (SELECT app_id, title, rating, count(*) AS n FROM dataset GROUP BY app_id, title, rating))
    CROSS JOIN (VALUES ('naive'), ('engineered')) m(method)""")
def prompt_batch(spark, sf):
    return build.build_prompt_batch(_dataset(spark, sf)).withColumn("prompt", _md5("prompt"))


def _pairs_sql(split: str) -> str:
    return f"""
    SELECT id, {_sql_fill(T.TRAINING_PROMPT, title="title", rating="CAST(rating AS VARCHAR)",
                          sentiment="CASE WHEN rating >= 7 THEN 'positive' ELSE 'negative' END")} AS prompt,
           trim(review_text, E' \\t\\n\\r') AS completion, {split} AS split
    FROM (SELECT * FROM dataset WHERE title IS NOT NULL AND length(review_text) BETWEEN 80 AND 1200)"""


@query("training_pairs", with_("reviews", "titles", "dataset") + _pairs_sql(
    f"CASE WHEN substr({HASH}, 1, 8) < '1999999a' THEN 'validation' ELSE 'train' END"))
def training_pairs(spark, sf):
    return build.training_pairs(_dataset(spark, sf))


@query("training_pairs_exact_split", with_("reviews", "titles", "dataset") + _pairs_sql(
    f"""CASE WHEN row_number() OVER (ORDER BY {HASH}, id) <= ceil(0.1 * count(*) OVER ())
              THEN 'validation' ELSE 'train' END"""))
def training_pairs_exact(spark, sf):
    return build.training_pairs(_dataset(spark, sf), exact=True)


@query("diversity_by_language", with_("reviews", "filled", "words", "vectors") + "," + DIVERSITY_SQL + ","
       + _knn_sql("true", "true", "g.id <> r.id") + """
    SELECT lang, count(*) AS n, round(avg(word_count), 6) AS mean_word_count,
           round(avg(d1), 6) AS distinct1_mean, round(avg(d2), 6) AS distinct2_mean,
           round(avg(rep), 6) AS trigram_repeat_mean, round(avg(mean_sim), 6) AS inter_sim_mean
    FROM div LEFT JOIN knn ON div.id = knn.id GROUP BY lang""")
def diversity_by_language(spark, sf):
    rows = evaluation.diversity_rows(t.filled(spark, sf), by="lang").select(
        "id", "lang", "word_count", "distinct_1", "distinct_2", "trigram_repeat_rate"
    )
    rows = evaluation.with_inter_similarity(rows, t.vectors(spark, sf).select("id", "embedding"), "id")
    return rounded(
        evaluation.diversity_report(rows, "lang"), "mean_word_count", "distinct1_mean",
        "distinct2_mean", "trigram_repeat_mean", "inter_sim_mean",
    )


@query("realism_rows", with_("vectors", "reviews", "filled") + r""",
    gen AS (SELECT v.id, v.v, f.generated_text FROM vectors v JOIN filled f ON f.id = v.id
            WHERE label < 5 AND len(regexp_extract_all(generated_text, '\S+')) >= 20),
    near AS (SELECT g.id, list_cosine_similarity(g.v, r.v) AS sim,
                    row_number() OVER (PARTITION BY g.id ORDER BY list_cosine_similarity(g.v, r.v) DESC) AS rn
             FROM gen g, vectors r JOIN reviews w ON w.id = r.id
             WHERE r.label >= 5 AND regexp_matches(w.review_text, '\S'))
    SELECT id, round(avg(sim), 6) AS realism_sbert_topk, round(max(sim), 6) AS nn_overlap,
           CAST(max(sim) >= 0.9 AS INT) AS nn_overlap_flag FROM near WHERE rn <= 5 GROUP BY id""")
def realism_rows(spark, sf):
    texts = t.filled(spark, sf).select("id", "method", "generated_text")
    gen = t.generated_vectors(spark, sf).select("id", "embedding").join(texts, "id")
    own = t.reviews(spark, sf).select("id", "review_text")
    real = t.real_vectors(spark, sf).select("id", "embedding").join(own, "id")
    rows = evaluation.realism_rows(gen, real)
    return rounded(
        rows.select("id", "realism_sbert_topk", "nn_overlap", "nn_overlap_flag"),
        "realism_sbert_topk", "nn_overlap",
    )


def _audit_sql(task: str, template: str, whole: bool = False) -> str:
    """The prompts' checksums; with ``whole`` the prompts themselves."""
    by, limit, where = "method, app_id", 50, "true"
    if task == "sentiment":
        by, limit, where = "method, app_id, rating", 25, "method = 'naive'"
    block = f"""string_agg('[ID: ' || rn || '] "' || {CLEAN_SQL.format('generated_text')} || '"', E'\\n' ORDER BY rn)"""
    rating = "rating" if task == "sentiment" else "CAST(NULL AS INT) AS rating"
    # The block goes in last, so nothing inside a text is taken for a place to fill.
    filled = _sql_fill(
        template, title="t.title", description="'About ' || t.title || '.'", n="CAST(n AS VARCHAR)",
        rating="CAST(coalesce(rating, 0) AS VARCHAR)",
        sentiment="CASE WHEN rating = 3 THEN 'NEGATIVE' ELSE 'POSITIVE' END", block="block",
    )
    return with_("reviews", "titles", "filled") + f"""
    SELECT method, b.app_id, {'CAST(rating AS INT)' if task == 'sentiment' else '0'} AS rating,
           CAST(b.app_id + 1 AS INT) AS seq, {filled if whole else f"md5({filled})"} AS prompt
    FROM (SELECT {by.replace(', rating', '')}, {rating}, count(*) AS n, {block} AS block
          FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {HASH}, id) AS rn FROM filled WHERE {where})
          WHERE rn <= {limit} GROUP BY {by}) b
    JOIN titles t ON t.app_id = b.app_id"""


def _audit(spark, sf, task):
    found = audit.audit_prompts(t.filled(spark, sf), t.app_meta(spark, sf), task, apps=list(range(20)))
    return found.withColumns({
        "prompt": _md5("prompt"), "rating": F.coalesce("rating", F.lit(0)),
    })


def _register_audit(task, template):
    @query(f"g15_audit_{task}", _audit_sql(task, template))
    def run(spark, sf):
        return _audit(spark, sf, task)


for _task, _template in {**audit.TASKS, "sentiment": T.AUDIT_SENTIMENT}.items():
    _register_audit(_task, _template)


# ---- round trips through files in the shared folder -----------------------------------------

@query("a1_b1_csv_round_trip", with_("reviews", "titles", "dataset") + """
    SELECT app_id, title, rating, replace(review_text, E'\\r', '') AS review_text FROM dataset""")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "dataset-csv")
    sinks.write_csv(_dataset(spark, sf).drop("id"), path, quote_all=True)
    return readers.read_reviews(spark, path)


@query("a2_b2_pairs_round_trip", with_("reviews", "titles", "dataset") + "SELECT prompt, completion, split FROM ("
       + _pairs_sql(f"CASE WHEN substr({HASH}, 1, 8) < '1999999a' THEN 'validation' ELSE 'train' END") + ")")
def pairs_round_trip(spark, sf):
    pairs = build.training_pairs(_dataset(spark, sf))
    paths = {}
    for split in ("train", "validation"):
        paths[split] = scratch_path(spark, f"pairs-{split}")
        sinks.write_pairs(pairs.filter(F.col("split") == split), paths[split])
    return readers.read_pairs(spark, paths)


def _after(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


@query("b3_prompt_files", f"""
    SELECT method, md5(string_agg(prompt || {_after(T.AFTER_PROMPT)} || chr(10), '' ORDER BY seq)) AS content
    FROM ({_audit_sql("spoiler", audit.TASKS["spoiler"], whole=True)}) GROUP BY method""")
def prompt_files(spark, sf):
    """The whole text of each method's file."""
    path = scratch_path(spark, "prompts")
    prompts = audit.audit_prompts(t.filled(spark, sf), t.app_meta(spark, sf), "spoiler", apps=list(range(20)))
    sinks.write_prompt_batches(prompts, path, "spoiler")
    files = spark.read.text(path, wholetext=True)
    return files.select("method", _md5("value").alias("content"))


@query("b4_append_summary", with_("reviews") + """
    SELECT run, app_id, n FROM (SELECT app_id, count(*) AS n FROM reviews GROUP BY app_id)
    CROSS JOIN (VALUES ('first'), ('second')) r(run)""")
def append_summary(spark, sf):
    path = scratch_path(spark, "summaries")
    summary = t.reviews(spark, sf).groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    for run in ("first", "second", "first"):  # a run that is tried again leaves one copy
        sinks.append_summary(summary, path, run)
    return spark.read.parquet(path)


@query("i3_run_batch", "SELECT doc_id, n_chars * 2 AS doubled FROM documents")
def batch_steps(spark, sf):
    """The labelled documents first, then all: the second run adds only what is missing."""
    out = scratch_path(spark, "batch-out")
    docs = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    step = lambda df: df.select("doc_id", (F.col("n_chars") * 2).alias("doubled"))
    labelled = docs.join(t.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    run_batch(spark, labelled, out, step, "doc_id")
    run_batch(spark, docs, out, step, "doc_id")
    return spark.read.parquet(out)


@query("i3_run_incremental", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def stream_steps(spark, sf):
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    step = lambda df: df.select(
        "doc_id", tx.ws_word_count(F.col("text")).cast("bigint").alias("words")
    )
    source = f"{sf}/{{documents.parquet}}"  # a pattern, so the table may be one file or a folder of files
    for _ in range(2):
        run_incremental(spark, source, t.DOCUMENTS, out, checkpoint, step)
    return spark.read.parquet(out)


@query("i3_run_once_per_id", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def stream_once_per_id(spark, sf):
    """The documents land, and land again under another name with the labelled ones first: every id is done once."""
    landing, out, checkpoint = (scratch_path(spark, x) for x in ("landing", "once-out", "once-state"))
    docs = t.table(spark, sf, "documents")
    step = lambda df: df.select("doc_id", tx.ws_word_count(F.col("text")).cast("bigint").alias("words"))
    labelled = docs.join(t.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    for rows in (labelled, docs, docs):
        rows.select("doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(landing)
        run_incremental(spark, landing, t.DOCUMENTS, out, checkpoint, step, id_col="doc_id")
    return spark.read.parquet(out)


@query("judge_report", with_("reviews", "filled") + """
    SELECT method, count(*) AS n, 0.0 AS changed_by_loading, 0.0 AS proba_off, 0.0 AS compliance_off,
           round(avg(CAST(len(list_filter(regexp_split_to_array(generated_text, '\s+'), lambda x: x <> '')) AS DOUBLE)), 6) AS mean_word_count
    FROM filled WHERE regexp_matches(generated_text, '\S') GROUP BY method""")
def judge_report(spark, sf):
    """Train, save, load, score every document, summarise. What loading changes, and what the report's
    rates differ from sums over the vocabulary's weights times the saved coefficients."""
    path = scratch_path(spark, "judge")
    rows = cut_lineage(_labelled(spark, sf), "labelled")
    model = judge.train_judge(rows, "y", text_col="text")
    judge.save_judge(model, path)
    loaded = judge.load_judge(path)
    filled = t.filled(spark, sf)
    before = evaluation.judge_generated(filled, model).select("id", F.col("pred_proba_recommended").alias("before"))
    after = cut_lineage(evaluation.judge_generated(filled, loaded), "judged")
    changed = after.join(before, "id").groupBy("method").agg(F.max(F.abs(F.col("before") - F.col("pred_proba_recommended"))).alias("changed_by_loading"))
    vocab = cut_lineage(tfidf.vocabulary(tfidf.term_totals(rows, "text"), rows.agg(F.count(F.lit(1)).alias("n_docs"))), "vocabulary")
    weights = tfidf.weigh_texts(filled.select("id", "generated_text"), vocab, "id", "generated_text")
    sums = tfidf.linear_score(filled, weights, judge.coef_table(loaded), "id", loaded.stages[-1].intercept)
    plain = sums.join(after.select("id"), "id", "left_semi").groupBy("method").agg(
        F.avg(1 / (1 + F.exp(-F.col("score")))).alias("proba"), F.avg(((F.col("score") >= 0) == (F.col("rating") >= 7)).cast("double")).alias("compliance")
    )
    report = judge_summary(after).join(changed, "method").join(plain, "method")
    off = lambda a, b: F.abs(F.round(F.col(a) - F.col(b), 9))
    return rounded(report.select(
        "method", "n", F.abs(F.round("changed_by_loading", 9)).alias("changed_by_loading"), off("mean_pred_proba", "proba").alias("proba_off"),
        off("compliance_rate", "compliance").alias("compliance_off"), "mean_word_count",
    ), "mean_word_count")


@query("a3_labels_and_accuracy", """
    SELECT count(*) AS n, round(avg(CAST(quality = toxic AS INT)), 6) AS accuracy
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def labels_and_accuracy(spark, sf):
    """Label arrays written and read again, joined to a sample and compared with its predictions."""
    path = scratch_path(spark, "label-array")
    labels = t.table(spark, sf, "labels").select(
        F.col("doc_id").cast("int").alias("id"), F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE").alias("sentiment")
    )
    sinks.write_labels(labels, path)
    read = readers.read_labels(spark, path).select("id", "sentiment")
    said = t.table(spark, sf, "labels").select(
        F.col("doc_id").cast("int").alias("id"), F.when(F.col("toxic") == 1, "POSITIVE").otherwise("NEGATIVE").alias("predicted")
    )
    documents = t.table(spark, sf, "documents").select(F.col("doc_id").cast("int").alias("id"))
    both = documents.join(read, "id").join(said, "id")
    hit = (F.col("sentiment") == F.col("predicted")).cast("int")
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")), "accuracy")
