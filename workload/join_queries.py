"""Lookups, joins and nearest neighbours: D1-D11, E3, H1-H3, I1, I2."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed_texts as T, text as tx, vectors as vx
from corpusloom.operators import embed, guards, joins, sampling, similarity, stats

from . import tables as t
from .registry import query, r6, rounded
from .stats_queries import HASH
from .tables import with_


@query("d1_attach_titles", with_("reviews", "titles") + """
    SELECT r.id, r.app_id, t.title FROM reviews r LEFT JOIN titles t ON r.app_id = t.app_id""")
def d1(spark, sf):
    return joins.attach_titles(t.reviews(spark, sf).select("id", "app_id"), t.titles(spark, sf))


@query("d2_attach_labels", with_("scored") + """
    SELECT doc_id, CASE WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS ground_truth
    FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""")
def d2(spark, sf):
    labels = t.table(spark, sf, "labels")
    sentiment = F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE")
    first = labels.select(F.col("doc_id").alias("id"), F.lit("EARLIER").alias("sentiment"), F.lit(0).alias("position"))
    last = labels.select(F.col("doc_id").alias("id"), sentiment.alias("sentiment"), F.lit(1).alias("position"))
    docs = t.table(spark, sf, "documents").select("doc_id")
    return joins.attach_labels(docs, first.unionByName(last), id_col="doc_id")


def _case_sql() -> str:
    def text(value):
        return "'" + value.replace("'", "''") + "'"

    by_app = "".join(f" WHEN app_id = {a} THEN {text(d)}" for a, d in {1: "First app.", 2: "Second app."}.items())
    by_kw = "".join(
        f" WHEN contains(lower(title), {text(k)}) THEN {text(T.DESCRIPTION_BY_APP[a])}"
        for k, a in T.APP_BY_TITLE_KEYWORD.items()
    )
    return f"CASE{by_app}{by_kw} ELSE {text(T.DEFAULT_DESCRIPTION)} END"


@query("d3_attach_description", with_("reviews", "titles") + f"""
    SELECT r.id, {_case_sql().replace('app_id', 'r.app_id')} AS description
    FROM reviews r LEFT JOIN titles t ON r.app_id = t.app_id""")
def d3(spark, sf):
    titled = joins.attach_titles(t.reviews(spark, sf).select("id", "app_id"), t.titles(spark, sf))
    return joins.attach_description(titled, {1: "First app.", 2: "Second app."}).select("id", "description")


@query("d3_keyword_table", """
    WITH hosts AS (SELECT page_id, regexp_extract(url, '//([^/]*)[.]example', 1) AS keyword FROM pages),
    k AS (SELECT lower(keyword) AS keyword, min(page_id) AS place FROM hosts WHERE trim(keyword) <> '' GROUP BY 1),
    hit AS (SELECT d.doc_id, min(place) AS place FROM documents d JOIN k ON contains(lower(trim(coalesce(d.text, ''))), k.keyword) GROUP BY d.doc_id)
    SELECT d.doc_id, coalesce('page ' || place, 'none') AS description FROM documents d LEFT JOIN hit ON d.doc_id = hit.doc_id""")
def d3_keywords(spark, sf):
    """Hosts of pages as a keyword table of the documents' texts; the page listed first wins."""
    pages = t.table(spark, sf, "pages").select(
        F.col("page_id").alias("priority"), F.regexp_extract("url", r"//([^/]*)[.]example", 1).alias("keyword"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("description"),
    )
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    return joins.attach_keyword_description(docs, pages, "text", default="none").select("doc_id", "description")


@query("d4_keep_known", with_("reviews", "titles") + """
    SELECT id, app_id FROM reviews WHERE app_id IN (SELECT app_id FROM titles)""")
def d4(spark, sf):
    return joins.keep_known(t.reviews(spark, sf).select("id", "app_id"), t.titles(spark, sf))


@query("d6_scatter_back", with_("reviews") + f"""
    SELECT r.id, CAST(s.votes_up AS DOUBLE) AS votes_up FROM reviews r
    LEFT JOIN (SELECT id, votes_up FROM reviews ORDER BY {HASH}, id LIMIT 100) s ON r.id = s.id""")
def d6(spark, sf):
    rows = t.reviews(spark, sf).select("id", F.col("votes_up").cast("double").alias("votes_up"))
    return joins.scatter_back(rows.select("id"), sampling.sample_n(rows, 100, "id"), "id")


@query("d9_anchor_classify", with_("vectors") + """
    SELECT id, round(list_cosine_similarity(v, p), 6) AS score_pos,
           round(list_cosine_similarity(v, n), 6) AS score_neg,
           CASE WHEN list_cosine_similarity(v, p) > list_cosine_similarity(v, n)
                THEN 'POSITIVE' ELSE 'NEGATIVE' END AS prediction
    FROM vectors, (SELECT v AS p FROM vectors WHERE id = 0), (SELECT v AS n FROM vectors WHERE id = 1)""")
def d9(spark, sf):
    rows = t.vectors(spark, sf)
    anchors = rows.agg(
        F.max(F.when(F.col("id") == 0, F.col("embedding"))).alias("anchor_pos"),
        F.max(F.when(F.col("id") == 1, F.col("embedding"))).alias("anchor_neg"),
    )
    found = joins.anchor_classify(rows, "embedding", anchors)
    return rounded(found, "score_pos", "score_neg").select("id", "score_pos", "score_neg", "prediction")


@query("d11_pending", """
    SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def d11(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "lang")
    return joins.pending(docs, t.table(spark, sf, "labels"), "doc_id")


# ---- vectors -------------------------------------------------------------------------------

SLOT = "CAST('0x' || substr(md5(w), 1, 6) AS INT) % 64"


@query("h1_embed", f"""
    SELECT id, slot, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 5) AS value FROM (
        SELECT doc_id AS id, {SLOT} AS slot, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS w
            FROM documents)
        GROUP BY ALL)""")
def h1(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    cells = embed.embed(docs, "text").select("id", F.posexplode("embedding").alias("slot", "value"))
    return cells.filter("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("h2_h3_normalize_and_cosine", """
    SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
           round(CAST(a.embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS first
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def h2(spark, sf):
    rows = t.table(spark, sf, "embeddings").select("vec_id", "embedding")
    later = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = rows.join(later, "vec_id")
    return pairs.select(
        F.col("vec_id").alias("id"), r6(vx.cosine(F.col("embedding"), F.col("other"))).alias("cosine"),
        r6(vx.l2_normalize(F.col("embedding"))[0]).alias("first"),
    )


def _knn_sql(left: str, right: str, cond: str) -> str:
    return f"""
    near AS (SELECT g.id, g.method, list_cosine_similarity(g.v, r.v) AS sim,
                    row_number() OVER (PARTITION BY g.id ORDER BY list_cosine_similarity(g.v, r.v) DESC) AS rn
             FROM vectors g, vectors r WHERE {left} AND {right} AND {cond}),
    knn AS (SELECT id, method, avg(sim) AS mean_sim, max(sim) AS top_sim FROM near WHERE rn <= 5 GROUP BY id, method)"""


REALISM = _knn_sql("g.label < 5", "r.label >= 5", "true")


@query("d7_knn_realism", with_("vectors") + "," + REALISM + """
    SELECT id, round(mean_sim, 6) AS realism_sbert_topk, round(top_sim, 6) AS nn_overlap,
           CAST(top_sim >= 0.4 AS INT) AS nn_overlap_flag FROM knn""")
def d7(spark, sf):
    found = similarity.knn_realism(t.generated_vectors(spark, sf), t.real_vectors(spark, sf), threshold=0.4)
    return rounded(found, "realism_sbert_topk", "nn_overlap")


@query("d7_knn_realism_cells", with_("vectors") + "," + REALISM + """
    SELECT id, round(mean_sim, 6) AS realism_sbert_topk, round(top_sim, 6) AS nn_overlap,
           CAST(top_sim >= 0.4 AS INT) AS nn_overlap_flag FROM knn""")
def d7_cells(spark, sf):
    found = similarity.knn_realism(
        t.generated_vectors(spark, sf), t.real_vectors(spark, sf), threshold=0.4, max_bytes=0, pivots=8, block=512
    )
    return rounded(found, "realism_sbert_topk", "nn_overlap")


@query("d8_knn_self_similarity", with_("vectors") + "," + _knn_sql("true", "true", "g.id <> r.id") + """
    SELECT id, round(mean_sim, 6) AS inter_review_sim_topk FROM knn""")
def d8(spark, sf):
    return rounded(similarity.knn_self_similarity(t.vectors(spark, sf)), "inter_review_sim_topk")


@query("d8_knn_self_similarity_cells", with_("vectors") + "," + _knn_sql("true", "true", "g.id <> r.id") + """
    SELECT id, round(mean_sim, 6) AS inter_review_sim_topk FROM knn""")
def d8_cells(spark, sf):
    found = similarity.knn_self_similarity(t.vectors(spark, sf), max_bytes=0, pivots=8, block=512)
    return rounded(found, "inter_review_sim_topk")


@query("d10_overlap_pairs", with_("vectors") + """,
    g AS (SELECT v, min(id) AS id, count(*) AS copies FROM vectors WHERE label < 5 GROUP BY v),
    r AS (SELECT v, min(id) AS id, count(*) AS copies FROM vectors WHERE label >= 5 GROUP BY v)
    SELECT g.id AS gen_id, r.id AS real_id, round(list_cosine_similarity(g.v, r.v), 6) AS similarity,
           g.copies AS gen_copies, r.copies AS real_copies
    FROM g, r WHERE list_cosine_similarity(g.v, r.v) >= 0.4""")
def d10(spark, sf):
    pairs = similarity.overlap_pairs(
        t.generated_vectors(spark, sf), t.real_vectors(spark, sf), 0.4, pivots=8
    )
    return rounded(pairs, "similarity")


@query("e3_realism_summary", with_("vectors") + "," + REALISM + """
    SELECT method, round(avg(mean_sim), 6) AS realism_mean,
           round(avg(CAST(top_sim >= 0.4 AS INT)), 6) AS nn_overlap_rate, round(max(top_sim), 6) AS nn_overlap_max
    FROM knn GROUP BY method""")
def e3(spark, sf):
    gen = t.generated_vectors(spark, sf)
    found = similarity.knn_realism(gen, t.real_vectors(spark, sf), threshold=0.4)
    rows = found.join(gen.select("id", "method"), "id")
    return rounded(stats.realism_summary(rows), "realism_mean", "nn_overlap_rate", "nn_overlap_max")


# ---- unions --------------------------------------------------------------------------------

@query("i1_merge_methods", with_("reviews", "filled") + """
    SELECT app_id, CAST(NULL AS VARCHAR) AS title, rating, method, md5(generated_text) AS generated_text
    FROM filled WHERE method <> 'finetuned'""")
def i1(spark, sf):
    rows = t.filled(spark, sf)
    naive = rows.filter("method = 'naive'").drop("method", "id", "lang")
    engineered = rows.filter("method = 'engineered'").drop("method").withColumn("title", F.lit(None).cast("string"))
    no_text = rows.filter("method = 'finetuned'").select("app_id", "rating")
    merged = joins.merge_methods({"naive": naive, "engineered": engineered, "finetuned": no_text})
    return merged.withColumn("generated_text", F.md5(F.col("generated_text").cast("binary")))


@query("i2_stack", """
    SELECT doc_id AS id, lang, NULL AS role FROM documents
    UNION ALL SELECT conv_id, NULL, role FROM conversations""")
def i2(spark, sf):
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    turns = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role")
    return joins.stack([docs, turns])
