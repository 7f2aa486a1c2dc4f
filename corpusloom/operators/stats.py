"""Summaries and distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.flags import range_flag
from ..sizing import local_if_small, spread


def _share(flag: str | Column) -> Column:
    return F.avg(F.col(flag).cast("double") if isinstance(flag, str) else flag.cast("double"))


def judge_summary(df: DataFrame, by: str = "method") -> DataFrame:
    """Largest group first; a NULL group is a group."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            _share("compliant").alias("compliance_rate"),
            F.avg("pred_proba_recommended").alias("mean_pred_proba"),
            _share("length_ok_100_140").alias("length_ok_rate"),
            F.avg("word_count").alias("mean_word_count"),
        )
        .orderBy(F.desc("n"), by)
    )


def diversity_summary(df: DataFrame, by: str = "method") -> DataFrame:
    """NULL similarities are skipped in the mean and counted in n."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("word_count").alias("mean_word_count"),
            F.avg("distinct_1").alias("distinct1_mean"),
            F.avg("distinct_2").alias("distinct2_mean"),
            F.avg("trigram_repeat_rate").alias("trigram_repeat_mean"),
            F.avg("inter_review_sim_topk").alias("inter_sim_mean"),
        )
        .orderBy(F.desc("n"), by)
    )


def realism_summary(df: DataFrame, by: str = "method") -> DataFrame:
    """E3."""
    return df.groupBy(by).agg(
        F.avg("realism_sbert_topk").alias("realism_mean"),
        _share("nn_overlap_flag").alias("nn_overlap_rate"),
        F.max("nn_overlap").alias("nn_overlap_max"),
    )


def label_distribution(df: DataFrame, label: str, dataset: str) -> DataFrame:
    """Count and share of every label; the total is one broadcast row."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "label", "count", (F.col("count") / F.col("_total")).alias("proportion"),
        F.lit(dataset).alias("dataset"),
    )


def proportions(df: DataFrame, by: str, label: str) -> DataFrame:
    """E5: share of each 0/1 class per group; an absent class is 0."""
    return df.groupBy(by).agg(
        _share(F.col(label) == 0).alias("not_recommended"),
        _share(F.col(label) == 1).alias("recommended"),
    )


BRACKET_ROWS = 20_000  # rows left around a rank that are counted by value
ACCURACY = 2_000  # of the sketch that narrows a bracket, about 4 / ACCURACY of whose rows stay in it
QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, c: str, approximate: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum, as one row.

    Exact quartiles come from ``quantiles`` and run its jobs when called; ``approximate`` is one lazy
    aggregate.
    """
    figures = [
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
    ]
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if approximate:
        found = df.agg(*figures, F.percentile_approx(c, list(QUARTILES), accuracy).alias("_q"))
        return found.select(*[F.col("_q")[i].alias(n) for i, n in enumerate(names[4:7])], *names[:4], "max").select(names)
    found = quantiles(df, c, QUARTILES)
    return df.agg(*figures).select(*names[:4], *[F.lit(v).cast("double").alias(n) for v, n in zip(found, names[4:7])], "max")


def quantiles(df: DataFrame, c: str, shares: Sequence[float]) -> list[float | None]:
    """Exact interpolated quantiles of a numeric column, NULL left out; None without values.

    A rank is enclosed ever closer: one pass counts the rows below and inside every rank's bracket
    and sketches the inside, whose quantiles around the rank are the next bracket. The counts are
    exact, so a bracket that misses its rank is noticed and its other side taken. When few rows are
    left in a bracket they are counted by value. No buffer or task holds more than a sketch or
    ``BRACKET_ROWS`` values, however many distinct values there are, and a value with any share of
    the rows is a bracket of its own.
    """
    values = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v"))
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = whole["n"]
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    known: dict[int, float] = {}
    open_ranks = {r: (whole["lo"], whole["hi"], 0, n) for p in places for r in {math.floor(p), math.ceil(p)}}
    while open_ranks:
        known |= {r: lo for r, (lo, hi, _, _) in open_ranks.items() if lo == hi or math.isnan(lo)}
        open_ranks = {r: x for r, x in open_ranks.items() if r not in known}
        few = {r: x for r, x in open_ranks.items() if x[3] <= BRACKET_ROWS}
        if few:
            known |= _by_value(values, few)
            open_ranks = {r: x for r, x in open_ranks.items() if r not in few}
        if open_ranks:
            open_ranks = _narrowed(values, open_ranks)
    out = []
    for p in places:
        lo, hi = math.floor(p), math.ceil(p)
        out.append(known[lo] if lo == hi else (hi - p) * known[lo] + (p - lo) * known[hi])
    return out


def _inside(lo: float, hi: float) -> Column:
    return (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))


def _narrowed(values: DataFrame, ranks: dict) -> dict:
    """Brackets (lowest, highest, rows below, rows inside) around ranks, each closer than before or split at one value."""
    listed = sorted(ranks)
    sketch = []
    for r in listed:
        lo, hi, below, n = ranks[r]
        at = (r - below) / n
        share = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
        sketch.append(F.percentile_approx(F.when(_inside(lo, hi), F.col("v")), share, ACCURACY))
    cuts = values.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketch)]).first()
    pieces = {}
    for i, r in enumerate(listed):
        lo, hi, _, _ = ranks[r]
        a, b = cuts[f"s{i}"]
        # below a, a itself, between, b itself, above b: one of them holds the rank
        pieces[r] = [
            (lo, a, (F.col("v") >= F.lit(lo)) & (F.col("v") < F.lit(a))), (a, a, F.col("v") == F.lit(a)),
            (a, b, (F.col("v") > F.lit(a)) & (F.col("v") < F.lit(b))), (b, b, (F.col("v") == F.lit(b)) & (F.lit(b) > F.lit(a))),
            (b, hi, (F.col("v") > F.lit(b)) & (F.col("v") <= F.lit(hi))),
        ]
    figures = []
    for i, r in enumerate(listed):
        for j, (_, _, held) in enumerate(pieces[r]):
            v = F.when(held, F.col("v"))
            figures += [F.count(v).alias(f"n{i}_{j}"), F.min(v).alias(f"lo{i}_{j}"), F.max(v).alias(f"hi{i}_{j}")]
    row = values.agg(*figures).first()
    out = {}
    for i, r in enumerate(listed):
        below = ranks[r][2]
        for j in range(5):
            n = row[f"n{i}_{j}"]
            if below <= r < below + n:
                out[r] = (row[f"lo{i}_{j}"], row[f"hi{i}_{j}"], below, n)
                break
            below += n
    return out


def _by_value(values: DataFrame, ranks: dict) -> dict[int, float]:
    """The values at ranks whose brackets hold few rows."""
    frames = [
        values.filter(_inside(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("rank"), F.lit(below).alias("below"), "v", "n")
        for r, (lo, hi, below, _) in sorted(ranks.items())
    ]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("rank").orderBy("v"))
    rows = both.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy("rank").agg(F.min("v").alias("v")).collect()
    return {r["rank"]: r["v"] for r in rows}


def mean_of(df: DataFrame, **columns: Column) -> DataFrame:
    """One row with the mean of every given value or flag."""
    return df.agg(*[F.avg(c.cast("double")).alias(name) for name, c in columns.items()])


def top_words(df: DataFrame, c: str, n: int = 20) -> DataFrame:
    """Most frequent lower-cased white-space tokens; ties by word."""
    words = spread(df.select(c)).select(F.explode(tx.ws_tokens(F.lower(c))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(n)


def histogram(df: DataFrame, c: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal bins over each group's own range; the maximum belongs to the last bin.

    A single-valued group gets a range of one unit around its value. Empty bins are kept.
    """
    keys = [by] if by else []
    df = df.filter(F.col(c).isNotNull())
    lo, hi = F.min(c).cast("double"), F.max(c).cast("double")
    spans = df.groupBy(*keys).agg(
        F.when(lo < hi, lo).otherwise(lo - 0.5).alias("lo"),
        F.when(lo < hi, hi).otherwise(hi + 0.5).alias("hi"),
    ).filter("lo is not null")
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    place = F.floor((F.col(c) - F.col("lo")) * (F.lit(bins) / (F.col("hi") - F.col("lo"))))
    if by:
        spans = local_if_small(spans.withColumnRenamed(by, "_g"))
        placed = df.join(spans, df[by].eqNullSafe(spans["_g"]), "inner")
    else:
        placed = df.crossJoin(F.broadcast(spans))
    counts = placed.select(
        *[F.col(k).alias("_k") for k in keys],
        F.least(place, F.lit(bins - 1)).cast("int").alias("_bin"),
    ).groupBy(*["_k" for _ in keys], "_bin").agg(F.count(F.lit(1)).alias("_n"))
    match = F.col("bin") == F.col("_bin")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col("_k"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, match, "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """E20."""
    return df.select(c).distinct()


def generation_check(df: DataFrame, c: str = "generated_text") -> DataFrame:
    """Rows, mean white-space words, share inside 100..140 words."""
    words = tx.ws_word_count(tx.as_text(F.col(c)))
    return df.select(words.alias("_w")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("_w").alias("mean_words"),
        _share(range_flag(F.col("_w"), 100, 140)).alias("share_100_140"),
    )


def prompt_counts(
    df: DataFrame, cap: int = 1000, by: Sequence[str] = ("app_id", "title", "rating")
) -> DataFrame:
    """min(cap, size) numbered prompt slots per group; only the group sizes are needed."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    slots = F.sequence(F.lit(1), F.least(F.lit(cap), F.col("_n")).cast("int"))
    return sizes.select(*by, F.explode(slots).alias("slot"))


