"""Writers (B1-B5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_texts import AFTER_PROMPT, AFTER_SENTIMENT_PROMPT


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "error") -> None:
    """B1: header, quotes doubled; NULL and '' are both written as an empty field."""
    df.write.mode(mode).csv(
        path, header=True, quoteAll=quote_all, quote='"', escape='"', emptyValue="",
        lineSep="\n",
    )


def write_pairs(df: DataFrame, path: str, mode: str = "error") -> None:
    """B2: JSONL, non-ASCII letters as they are."""
    df.select("prompt", "completion").write.mode(mode).json(path)


def write_prompt_batches(prompts: DataFrame, path: str, task: str, mode: str = "error") -> None:
    """One text folder per method, prompts in app order with their separators.

    The audit samples bound a method's prompts to apps x sample size, hence one task per method.
    """
    after = F.lit(AFTER_PROMPT)
    if task == "sentiment":
        last = F.col("rating") == 9
        after = F.when(last, F.lit(AFTER_SENTIMENT_PROMPT + AFTER_PROMPT)).otherwise(
            F.lit(AFTER_SENTIMENT_PROMPT)
        )
    (
        prompts.repartition("method")
        .sortWithinPartitions("method", "seq", "rating")
        .select("method", F.concat("prompt", after).alias("value"))
        .write.mode(mode).partitionBy("method").option("lineSep", "\n").text(path)
    )


def append_summary(df: DataFrame, path: str, run: str) -> None:
    """A summary under its run name, next to those of other runs.

    Every run has a folder of its own, which the write replaces as a whole: a run that is tried again
    after a failure, or twice, leaves one copy. A summary without rows leaves what is there.
    """
    rows = df.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_metrics(table: DataFrame, path: str) -> None:
    """Metric rows of a judge."""
    table.write.mode("append").parquet(path)


LABELS_PER_FILE = 1 << 15


def write_labels(labels: DataFrame, path: str, mode: str = "error") -> None:
    """Files of one JSON array each, of at most ``LABELS_PER_FILE`` (id, sentiment) rows, below ``path``."""
    part = F.shiftright(F.monotonically_increasing_id(), LABELS_PER_FILE.bit_length() - 1)  # counts on within a task
    arrays = labels.select(part.alias("part"), F.struct("id", "sentiment").alias("label")).groupBy("part").agg(
        F.to_json(F.collect_list("label")).alias("value")
    )
    arrays.write.mode(mode).partitionBy("part").text(path)
