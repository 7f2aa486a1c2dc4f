"""Operator 10: licence scans by a positional rare-token index, in Spark expressions only.

Every template is a fixed sequence of words with a mandatory key phrase. Its words are ranked by
inverse document frequency over the scanned corpus. The index holds the rarest word of each template
with its position. A document word met there lays the template against the document; the next
rarest words must stand at their relative positions, then the key phrase is compared word by word. The templates are a fixed list of the caller's, so the index is bounded by it.

Defined cases: a null or wordless text has no places and no labels; a template whose words do not
occur in the corpus is found nowhere; overlapping and repeated places all count; rows that share a
document id share its places; null ids are an id of their own; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .native_words import ascii_lower, lookup_key, word_rows, words, words_at

RARE_WORDS = 3


@dataclass(frozen=True)
class Template:
    """Words in lower case, separated by single spaces; ``phrase`` is the part that must be found
    word by word (default: all)."""

    label: str
    text: str
    phrase: str = ""
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split(" ")

    def phrase_place(self) -> tuple[int, list[str]]:
        every, part = self.words(), (self.phrase or self.text).split(" ")
        for at in range(len(every)):
            if every[at : at + len(part)] == part:
                return at, part
        raise ValueError(f"phrase {self.phrase!r} is not in template {self.text!r}")


def document_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents with each word of a fixed vocabulary."""
    keys = F.array(*[F.lit(w) for w in sorted(set(vocabulary))])
    present = docs.select(F.explode(F.array_intersect(words(F.lower(F.col(text))), keys)).alias("w"))
    return {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_order(template: Template, frequency: dict[str, int]) -> list[int]:
    """Positions of the template's words, highest inverse document frequency first."""
    every = template.words()
    return sorted(range(len(every)), key=lambda i: (frequency.get(every[i], 0), i))


def _index(spark: SparkSession, templates: list[Template], frequency: dict[str, int]) -> DataFrame:
    """One row for each template under its rarest word."""
    rows = []
    for n, t in enumerate(templates):
        every, order, (at, part) = t.words(), rare_order(t, frequency), t.phrase_place()
        rare = [order[min(i, len(order) - 1)] for i in range(RARE_WORDS)]
        rows.append((every[rare[0]], n, *rare, *[every[i] for i in rare], at, len(part), " ".join(part), every))
    at = ", ".join(f"_at{i} INT" for i in range(RARE_WORDS))
    word = ", ".join(f"_w{i} STRING" for i in range(RARE_WORDS))
    index = spark.createDataFrame(
        rows, f"_w STRING, _template INT, {at}, {word}, _phrase_at INT, _phrase_size INT, _phrase STRING, _every ARRAY<STRING>"
    )
    return index.withColumn("_key", lookup_key(F.col("_w"))).drop("_w")


def find_places(docs: DataFrame, doc_id: str, text: str, templates: list[Template]) -> DataFrame:
    """_doc, _template (number in the list), _start, _score: every verified place of a template.

    The score is the share of the template's words that stand at their place.
    """
    frequency = document_frequency(docs, text, [w for t in templates for w in t.words()])
    met = word_rows(docs, doc_id, text).join(F.broadcast(_index(docs.sparkSession, templates, frequency)), "_key")
    start = F.col("_pos") - F.col("_at0")
    near = start >= 0
    for i in range(RARE_WORDS):  # relative positions of the rarest words
        near = near & (ascii_lower(F.get("_words", start + F.col(f"_at{i}"))) == F.col(f"_w{i}"))
    said = words_at(start + F.col("_phrase_at"), F.col("_phrase_size")) == F.col("_phrase")
    there = words_at(start, F.size("_every"))
    held = met.filter(near & said).select("_doc", "_template", start.alias("_start"), there.alias("_there"), "_every").distinct()
    # Past the shuffle rows hold the place only, not the document's words.
    fits = F.zip_with(F.split("_there", " "), "_every", lambda a, b: F.coalesce(a == b, F.lit(False)))
    score = F.size(F.filter(fits, lambda x: x)) / F.size("_every")
    return held.select("_doc", "_template", "_start", score.alias("_score"))


def scan_licenses(docs: DataFrame, doc_id: str, text: str, templates: list[Template]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted lists), score."""
    places = find_places(docs, doc_id, text, templates)
    facts = docs.sparkSession.createDataFrame(
        [(n, t.label, t.base) for n, t in enumerate(templates)], "_template INT, _label STRING, _base BOOLEAN"
    )
    base = F.col("_base")
    per_doc = places.join(F.broadcast(facts), "_template").groupBy("_doc").agg(
        F.sum(base.cast("bigint")).alias("n_base"),
        F.min(F.when(base, F.col("_start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("_start"))).cast("bigint").alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("_label")))).alias("base_labels"),
        F.sort_array(F.collect_set("_label")).alias("labels"),
        F.max("_score").alias("score"),
    )
    counted = docs.select(F.col(doc_id).alias(doc_id), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(per_doc, F.col(doc_id).eqNullSafe(F.col("_doc")), "left").select(
        doc_id, "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
