"""A training corpus from raw documents: judged, deduplicated, decontaminated, sanitised, encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads
them for the next one, so a lost executor never costs more than a stage's own tasks.

Columns beyond those of ``documents`` are left out by the first stage, so none can clash; each
operator's module states its own cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.decontamination import contamination
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.pieces import default_model, encode_checked
from corpusloom.llm.private_data import sanitise
from corpusloom.llm.quality import keep_good
from corpusloom.session import cut_lineage
from corpusloom.sizing import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 1_000  # rows of an Arrow batch; texts are wide, and a batch stands in memory on both sides
NEAR_PERCENT = 80  # shared part of two documents' five-word shingles from which they are near duplicates


def _narrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _with_key(docs: DataFrame) -> DataFrame:
    filled = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_text_key", F.concat_ws("-", F.xxhash64(filled), F.octet_length(filled)))


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    gone = cut_lineage(gone.select(keys).distinct(), "dropped")
    return docs.join(broadcast_if_small(gone), keys, "left_anti").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model."""
    _narrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(COLUMNS), "text", labels, "doc_id", "quality", "doc_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; null ids come last.

    Rows are told apart by a number of their own, so null and shared ids neither save nor drop a row.
    """
    _narrow_batches(spark)
    rows = cut_lineage(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = near_duplicates(rows, "_row", "text", percent=NEAR_PERCENT).select("_row", "component_id")
    parts = cut_lineage(parts.join(rows.select("_row", "doc_id"), "_row"), "parts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stays = parts.groupBy("component_id").agg(first.alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = parts.join(stays.select("component_id", F.col("x._row").alias("_stays")), "component_id").filter("_row <> _stays")
    return _without(rows, gone, ["_row"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item; known by their text, so ids may be null or shared."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _with_key(docs)
    gone = contamination(docs, "_text_key", "text", items, "item_id", "text").filter("contaminated")
    return _without(docs, gone, ["_text_key"])


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data and terms that disclose it replaced or taken out."""
    _narrow_batches(spark)
    clean = sanitise(docs, "text", ["doc_id", "lang", "source"])
    return clean.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("bigint").alias("n_chars")
    )


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the checksum of the text they decode to."""
    _narrow_batches(spark)
    coded = encode_checked(docs.select("doc_id", "lang", "source", "text"), "text", default_model())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "text_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("private_data", private_data),
    ("sentencepiece", encode_pieces),
]

# A fitted model's verdict and the pieces' best path are no SQL; tests compare the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
