"""Audit batches for an outside judge and its verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_texts as T
from ..functions.prompts import fill
from ..functions.text import clean_text, percent_value, snippet
from ..session import cut_lineage
from ..sizing import broadcast_if_small
from .sampling import SEED, sample_order, sample_per_group, stratified

TASKS = {
    "hallucination": T.AUDIT_HALLUCINATION,
    "structure": T.AUDIT_STRUCTURE,
    "spoiler": T.AUDIT_SPOILER,
}


def _joined(position: str, line: str, glue: str):
    """Lines of a sampled group in order; the sample size bounds the list."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(line))))
    return F.array_join(F.transform(lines, lambda s: s[line]), glue)


def numbered_block(
    df: DataFrame, by: Sequence[str], text_col: str, id_col: str, n: int = 50, seed: int = SEED
) -> DataFrame:
    """Per group a sample of n texts as ``[ID: i] "text"`` lines, and their number."""
    known = df.filter(F.col(text_col).isNotNull())
    picked = sample_per_group(known, by, n, id_col, seed)
    numbered = picked.withColumn("_i", F.row_number().over(sample_order(by, id_col, seed)))
    lines = numbered.withColumn(
        "_line",
        F.concat(F.lit("[ID: "), F.col("_i").cast("string"), F.lit('] "'), clean_text(F.col(text_col)), F.lit('"')),
    )
    return lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _joined("_i", "_line", "\n").alias("block")
    )


def audit_prompts(
    df: DataFrame, meta: DataFrame, task: str, text_col: str = "generated_text", id_col: str = "id",
    methods: Sequence[str] | None = None, apps: Sequence[int] = T.AUDITED_APPS,
    n: int | None = None, seed: int = SEED,
) -> DataFrame:
    """(method, app_id, rating, seq, prompt) of one task, in app order.

    ``meta`` holds (app_id, title, description); apps without it get no prompt. The sentiment
    task looks at the naive method and both ratings, 25 texts each; the others at 50 texts of
    every method.
    """
    if task not in TASKS and task != "sentiment":
        raise ValueError(f"unknown task {task}")
    methods = methods or (["naive"] if task == "sentiment" else T.METHODS)
    n = n or (25 if task == "sentiment" else 50)
    by = ["method", "app_id"]
    rows = df.filter(F.col("app_id").isin(list(apps)) & F.col("method").isin(list(methods)))
    if task == "sentiment":
        by = by + ["rating"]
        rows = rows.filter(F.col("rating").isin(3, 9))
    blocks = numbered_block(rows, by, text_col, id_col, n, seed)
    known = meta.filter(F.col("app_id").isin(list(apps))).select("app_id", "title", "description")
    joined = blocks.join(broadcast_if_small(known.dropDuplicates(["app_id"])), "app_id")
    values = {"title": F.col("title"), "description": F.col("description"), "n": F.col("n"),
              "block": F.col("block")}
    seq = F.array_position(F.array(*[F.lit(a) for a in apps]), F.col("app_id")).cast("int")
    rating = F.lit(None).cast("int")
    template = TASKS.get(task, T.AUDIT_SENTIMENT)
    if task == "sentiment":
        rating = F.col("rating")
        values["rating"] = rating
        values["sentiment"] = F.when(rating == 3, "NEGATIVE").otherwise("POSITIVE")
    return joined.select(
        "method", "app_id", rating.cast("int").alias("rating"), seq.alias("seq"),
        fill(template, **values).alias("prompt"),
    )


def judge_sample(
    df: DataFrame, text_col: str = "generated_text", id_col: str = "id",
    methods: Sequence[str] = T.METHODS, n: int = 100, seed: int = SEED,
) -> DataFrame:
    """N rows per method, numbered from 0 as ``temp_id``."""
    known = df.filter(F.col(text_col).isNotNull())
    return stratified(known, "method", n, id_col, methods, seed)


def judge_block(sample: DataFrame, text_col: str = "generated_text") -> DataFrame:
    """The sample as JSON-like lines of 300 cleaned characters, one row, and the prompt."""
    lines = sample.select(
        F.col("temp_id").alias("_i"),
        F.concat(
            F.lit('{ "id": '), F.col("temp_id").cast("string"), F.lit(', "text": "'),
            snippet(F.col(text_col), 300), F.lit('" }'),
        ).alias("_line"),
    )
    return lines.agg(
        F.count(F.lit(1)).alias("n"), _joined("_i", "_line", ",\n").alias("block")
    ).withColumn("prompt", fill(T.JUDGE_PROMPT, n=F.col("n"), block=F.col("block")))


def normalise_verdicts(objects: DataFrame) -> DataFrame:
    """One row shape for all tasks from the parsed objects in ``v`` and the columns task, approach.

    The failure count goes by several names; a sentiment verdict gives the successes instead, in
    number and in percent, and both are turned into failures: ``declared`` is always the stated
    share of failures.
    """
    v = lambda name: F.col(f"v.{name}")
    failed = F.coalesce(
        v("hallucination_count"), v("structure_failure_count"), v("fake_spoiler_count"),
        v("spoiler_count"), v("total_reviews_checked") - v("correct_sentiment_count"),
    )
    pct = F.coalesce(
        v("hallucination_percentage"), v("structure_failure_percentage"),
        v("fake_spoiler_percentage"), v("spoiler_percentage"), v("accuracy_percentage"),
    )
    declared = F.coalesce(
        percent_value(v("hallucination_percentage")), percent_value(v("structure_failure_percentage")),
        percent_value(v("fake_spoiler_percentage")), percent_value(v("spoiler_percentage")),
        1 - percent_value(v("accuracy_percentage")),
    )
    ids = F.coalesce(
        v("hallucinated_ids"), v("failed_ids"), v("fake_spoiler_ids"), v("spoiler_ids")
    )
    return objects.select(
        v("game").alias("game"), "task", "approach",
        v("total_reviews_checked").alias("checked"), failed.alias("failed"), pct.alias("pct"), declared.alias("declared"),
        ids.alias("ids"), v("analysis").alias("analysis"),
        v("target_rating").alias("target_rating"), v("expected_sentiment").alias("expected"),
    )


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    """Per task, approach and game: checked, failed, rate, declared share of failures and
    whether every record lists as many ids as it declares. Rows without a game carry the means over
    games; ``pooled`` is failed over checked of the row's own counts."""
    games = verdicts.groupBy("task", "approach", "game").agg(
        F.sum("checked").cast("bigint").alias("checked"),
        F.sum("failed").cast("bigint").alias("failed"),
        (F.sum("failed") / F.sum("checked")).alias("rate"),
        F.avg("declared").alias("declared"),
        F.bool_and(F.coalesce(F.size("ids"), F.lit(0)) == F.col("failed")).alias("ids_match"),
    )
    means = games.groupBy("task", "approach").agg(
        F.lit(None).cast("string").alias("game"),
        F.sum("checked").cast("bigint").alias("checked"),
        F.sum("failed").cast("bigint").alias("failed"),
        F.avg("rate").alias("rate"),
        F.avg("declared").alias("declared"),
        F.bool_and("ids_match").alias("ids_match"),
    )
    return games.unionByName(means).withColumn("pooled", F.col("failed") / F.col("checked"))


def failed_ids(verdicts: DataFrame) -> DataFrame:
    """One row per failed id."""
    return verdicts.select("task", "approach", "game", "target_rating", F.explode("ids").alias("id"))
