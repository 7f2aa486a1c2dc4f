"""Judging, diversity and realism of a generated table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions import flags, text as tx
from ..operators import guards, judge, metrics, sampling, similarity, stats, tfidf
from ..operators.joins import scatter_back
from ..session import cut_lineage
from ..sizing import spread


def generation_rows(scored: DataFrame, text_col: str = "generated_text") -> DataFrame:
    """Target, compliance and length flags next to a prediction."""
    return spread(scored).withColumns({
        "target_label": flags.target(F.col("rating"), "at_least_7"),
        "word_count": tx.ws_word_count(F.col(text_col)),
    }).withColumns({
        "compliant": flags.equal_flag(F.col("pred_label"), F.col("target_label")),
        "length_ok_100_140": flags.range_flag(F.col("word_count"), 100, 140),
    })


def judge_generated(filled: DataFrame, model: PipelineModel, text_col: str = "generated_text") -> DataFrame:
    """Score the filled rows with a trained judge."""
    guards.require_columns(filled, ["rating", "method", text_col])
    used = guards.non_blank(guards.clean_text_col(filled, text_col), text_col)
    return generation_rows(judge.score(used, model, text_col), text_col)


def diversity_rows(
    df: DataFrame, text_col: str = "generated_text", by: str = "method", lower: bool = False,
    min_words: int = 1,
) -> DataFrame:
    """Word count, distinct-1, distinct-2 and trigram repeat rate per text: one narrow stage."""
    guards.require_columns(df, [text_col])
    used = guards.non_blank(
        guards.clean_text_col(guards.ensure_column(df, by), text_col), text_col
    )
    if min_words >= 1:
        # Any word at all: found without making the tokens, so the rest can be spread first.
        used = used.filter(F.col(text_col).rlike("[A-Za-z0-9]"))
    words, held = F.col("word_count"), F.col("_held")
    grams = lambda n: F.greatest(words - (n - 1), F.lit(0))
    rows = (
        spread(used).withColumn("_tokens", tx.word_tokens(F.col(text_col), lower))
        .withColumns({"word_count": F.size("_tokens"), "_held": tfidf.distinct_grams(F.col("_tokens"), 3)})
        .withColumns({
            "distinct_1": tx.safe_ratio(held[0], words),
            "distinct_2": tx.safe_ratio(held[1], grams(2)),
            "trigram_repeat_rate": tx.safe_ratio(grams(3) - held[2], grams(3)),
        })
        .drop("_tokens", "_held")
    )
    return rows.filter(F.col("word_count") >= min_words) if min_words > 1 else rows


def with_inter_similarity(
    rows: DataFrame, vectors: DataFrame, id_col: str, k: int = 5, max_samples: int = 0,
    seed: int = sampling.SEED,
) -> DataFrame:
    """kNN similarity over all groups together, of a sample if asked; other rows keep NULL."""
    part = sampling.sample_n(vectors, max_samples, id_col, seed)
    sims = cut_lineage(similarity.knn_self_similarity(part, k, id_col))  # measured, then joined
    return scatter_back(rows, sims, id_col)


def diversity_report(rows: DataFrame, by: str = "method") -> DataFrame:
    if "inter_review_sim_topk" not in rows.columns:
        rows = rows.withColumn("inter_review_sim_topk", F.lit(None).cast("double"))
    return stats.diversity_summary(rows, by)


def realism_rows(
    gen: DataFrame, real: DataFrame, gen_text: str = "generated_text", real_text: str = "review_text",
    by: str = "method", id_col: str = "id", k: int = 5, threshold: float = 0.9, min_words: int = 20,
    max_real: int = 0, seed: int = sampling.SEED,
) -> DataFrame:
    """Similarity of generated rows to real ones; both sides carry an ``embedding``."""
    guards.require_columns(gen, [gen_text])
    guards.require_columns(real, [real_text])
    gen = guards.clean_text_col(guards.ensure_column(gen, by), gen_text)
    used = guards.min_words(guards.non_blank(gen, gen_text), gen_text, min_words, "ws")
    kept = guards.non_blank(guards.clean_text_col(real, real_text), real_text)
    kept = sampling.sample_n(kept, max_real, id_col, seed)
    sims = similarity.knn_realism(used, kept, k, id_col, threshold=threshold)
    words = used.drop("embedding").withColumn("word_count", tx.ws_word_count(F.col(gen_text)))
    return words.join(sims, id_col)


def fit_eval(
    train: DataFrame, val: DataFrame, text_col: str, rating_col: str = "rating", id_col: str = "id",
    **options,
) -> tuple[PipelineModel, DataFrame]:
    """H7: train on one table, score another; target is rating > 5."""
    def prepared(df):
        return guards.clean_text_col(df, text_col).withColumn(
            "y", flags.target(F.col(rating_col), "above_5")
        )

    model = judge.train_judge(prepared(train), "y", text_col=text_col, **options)
    scored = judge.score(prepared(val), model, text_col).select(id_col, "y", "score", "pred_label")
    return model, cut_lineage(scored)  # four narrow columns, read by every metric


def fit_report(scored: DataFrame, model_name: str) -> DataFrame:
    """Metrics of scored validation rows."""
    return metrics.metrics_table(scored, "y", "pred_label", "score", model_name)
