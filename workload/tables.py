"""The driver's tables in the roles the operators expect, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
METHODS = ["naive", "engineered", "finetuned"]
TITLE_STEMS = ["Dota 2", "CS2 Arena", "Star Harbor", "Elden Ring"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _app_id():
    return F.substring("source", 4, 10).cast("int")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a review; documents without a quality label vote by their length."""
    docs = table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    vote = F.coalesce(F.col("quality") == 1, F.col("n_chars") % 4 != 0)
    return docs.select(
        F.col("doc_id").alias("id"), _app_id().alias("app_id"), vote.alias("recommended"),
        F.col("text").alias("review_text"), (F.col("n_chars") % 17).alias("votes_up"), "lang",
    )


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """One title per source; every fifth source has none."""
    apps = table(spark, sf, "documents").select(_app_id().alias("app_id")).distinct()
    stem = F.get(F.array(*[F.lit(s) for s in TITLE_STEMS]), (F.col("app_id") % 4).cast("int"))
    return apps.filter(F.col("app_id") % 5 != 0).select(
        "app_id", F.concat(stem, F.lit(" #"), F.col("app_id").cast("string")).alias("title")
    )


def app_meta(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).withColumn(
        "description", F.concat(F.lit("About "), "title", F.lit("."))
    )


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a generated text, the method by its id."""
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), (F.col("id") % 3).cast("int"))
    return reviews(spark, sf).select(
        "id", "app_id", F.when(F.col("recommended"), 9).otherwise(3).alias("rating"),
        method.alias("method"), F.col("review_text").alias("generated_text"), "lang",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score that plain SQL can repeat."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    joined = docs.join(table(spark, sf, "labels"), "doc_id")
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), (F.col("doc_id") % 3).cast("int"))
    score = (F.col("n_chars") % 997) / F.lit(498.5) - 1
    return joined.select(
        F.col("doc_id").alias("id"), method.alias("method"), "lang", F.col("quality").alias("y"),
        score.alias("score"), (score >= 0).cast("int").alias("p"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", F.col("label").cast("string").alias("method")
    )


def generated_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).filter("label < 5")


def real_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).filter("label >= 5")


def term_coefs(vocab: DataFrame) -> DataFrame:
    """A coefficient for every vocabulary term that plain SQL can repeat."""
    digits = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("int")
    return vocab.select("term", ((digits % 2001 - 1000) / F.lit(1000.0)).alias("coef"))


# The same roles as SQL common table expressions.
SQL = {
    "reviews": """reviews AS (
        SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS INT) AS app_id,
               coalesce(l.quality = 1, d.n_chars % 4 <> 0) AS recommended,
               d.text AS review_text, d.n_chars % 17 AS votes_up, d.lang
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "titles": """titles AS (
        SELECT app_id, CASE app_id % 4 WHEN 0 THEN 'Dota 2' WHEN 1 THEN 'CS2 Arena'
                       WHEN 2 THEN 'Star Harbor' ELSE 'Elden Ring' END || ' #' || app_id AS title
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS app_id FROM documents)
        WHERE app_id % 5 <> 0)""",
    "filled": """filled AS (
        SELECT id, app_id, CASE WHEN recommended THEN 9 ELSE 3 END AS rating,
               CASE id % 3 WHEN 0 THEN 'naive' WHEN 1 THEN 'engineered' ELSE 'finetuned' END AS method,
               review_text AS generated_text, lang
        FROM reviews)""",
    "dataset": """dataset AS (
        SELECT u.id, u.app_id, t.title, CASE WHEN u.recommended THEN 9 ELSE 3 END AS rating, u.review_text
        FROM (SELECT *, row_number() OVER (PARTITION BY app_id, review_text ORDER BY id) AS rn
              FROM reviews WHERE length(review_text) >= 30) u
        LEFT JOIN titles t ON u.app_id = t.app_id WHERE rn = 1)""",
    "scored": """scored AS (
        SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'naive' WHEN 1 THEN 'engineered'
                               ELSE 'finetuned' END AS method, d.lang, l.quality AS y,
               (d.n_chars % 997) / 498.5 - 1 AS score,
               CAST((d.n_chars % 997) / 498.5 - 1 >= 0 AS INT) AS p
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "vectors": """vectors AS (
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, CAST(label AS VARCHAR) AS method
        FROM embeddings)""",
    "words": """words AS (
        SELECT id, method, lang, generated_text,
               regexp_extract_all(generated_text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?') AS t
        FROM filled)""",
    "terms": r"""tok AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)),
            lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
    vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term
              HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 50000),
    raw AS (SELECT doc_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
            FROM tf JOIN vocab ON tf.term = vocab.term),
    tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw),
    coefs AS (SELECT term, (CAST('0x' || substr(md5(term), 1, 4) AS INT) % 2001 - 1000) / 1000.0 AS coef
              FROM vocab)""",
}


def with_(*roles: str) -> str:
    return "WITH " + ",\n".join(SQL[r] for r in roles) + "\n"
