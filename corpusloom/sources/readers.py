"""Readers with explicit schemas and payload flattening."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import udtf

from .. import schemas
from ..functions.fixed_texts import MISSING_WORDS
from ..functions.text import strip_tags
from ..session import cut_lineage


def read_reviews(spark: SparkSession, path, schema: str = schemas.DATASET, whole_files: bool = False) -> DataFrame:
    """A1: CSV with header, quotes and line breaks inside quotes; missing-value words are NULL.

    Large files are cut anywhere and read by many tasks (``csv_records``). That needs fields with a
    quote in them to be quoted, as ``write_csv`` and most writers do; ``whole_files`` reads files
    with bare quotes inside of unquoted fields, one task each.
    """
    if whole_files:
        df = spark.read.schema(schema).csv(path, header=True, multiLine=True, **CSV)
    else:
        # a line break of its own kind, which the parser would write anew, goes through as it is
        kept = csv_records(spark, path).select(F.translate("record", "\r\n", _CR + _LF).alias("r"))
        parsed = kept.select(F.from_csv("r", schema, CSV).alias("c")).select("c.*")
        df = parsed.withColumns({
            f.name: F.translate(f.name, _CR + _LF, "\r\n") for f in parsed.schema.fields if f.dataType.simpleString() == "string"
        })
    texts = {
        f.name: F.when(~F.col(f.name).isin(MISSING_WORDS), F.col(f.name))
        for f in df.schema.fields if f.dataType.simpleString() == "string"
    }
    return df.withColumns(texts) if texts else df


CSV = {"quote": '"', "escape": '"', "encoding": "UTF-8"}
_CR, _LF = "\U0010fffe", "\U0010ffff"  # no characters, so in no text


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(record) of quoted CSV files, one row per record without the header, files cut at any byte.

    Every part of a file counts its quotes. Summed over the parts before, they tell whether a part
    begins inside of a quoted field, and from there each line whether it begins a record. Records
    inside a part are put together there; only what reaches over a part's ends, two pieces of a
    part at most, is shuffled and joined.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    parts = lines.groupBy("file", "part").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = cut_lineage(parts.select("file", "part", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside")), "csv-parts")
    # One row of three figures for each part of the input; lines must keep their order, so no shuffle will do.
    cut = lines.join(F.broadcast(begins), ["file", "part"]).select("file", "part", "inside", "value")
    pieces = cut_lineage(cut.mapInArrow(_records, "file BIGINT, part BIGINT, kind INT, header BOOLEAN, text STRING"), "csv-pieces")
    # A piece that begins a record and does not end it opens a new group of its file.
    order = Window.partitionBy("file").orderBy("part", "kind")
    broken = pieces.filter(F.col("kind") != WHOLE).withColumn("open", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    joined = broken.groupBy("file", "open").agg(
        F.sort_array(F.collect_list(F.struct("part", "kind", "text"))).alias("p"), F.bool_or("header").alias("header")
    ).select("header", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    found = pieces.filter(F.col("kind") == WHOLE).select("header", "text").unionByName(joined).filter("NOT header")
    # Where records end in CR LF, so do the lines inside of fields, which are read as LF.
    plain = F.when(F.endswith("text", F.lit("\r")), F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    return found.select(plain.alias("record")).filter("record <> ''")


HEAD, OPEN, WHOLE = 0, 1, 2  # ends a record begun before; begins one that goes on; a whole one


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, part, kind, header, text) of the records, and pieces of them, of consecutive lines."""
    place, inside, begun, held, out = None, False, False, [], []

    def close(kind: int) -> None:
        nonlocal header
        out.append((*place, kind if begun else HEAD, header and begun, "\n".join(held)))
        header = False
        held.clear()

    header = False  # of the record that is held, or of the next one to begin
    for batch in batches:
        for file, part, start, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (file, part) != place:
                if held:
                    close(OPEN if inside else WHOLE)
                place, inside, begun, header = (file, part), start, False, part == 0
            if not inside:
                if held:
                    close(WHOLE)
                begun = True
            held.append(value)
            inside ^= value.count('"') % 2 == 1
        yield _piece_batch(out)
        out.clear()
    if held:
        close(OPEN if inside else WHOLE)
    yield _piece_batch(out)


def _piece_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    columns = list(zip(*out)) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "part", "kind", "header", "text"])


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns


def read_pairs(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """A2: JSONL prompt/completion files, one per named split."""
    frames = [
        spark.read.schema(schemas.PAIRS).json(path).withColumn("split", F.lit(name))
        for name, path in splits.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A3: a file with a JSON array of labels, or a folder of such files; ``position`` is in file order."""
    df = spark.read.schema(schemas.LABELS).json(path, multiLine=True, recursiveFileLookup=True)
    return df.withColumn("position", F.monotonically_increasing_id())


@udtf(returnType="pos INT, object STRING")
class SplitObjects:
    """The JSON objects written one after another in one text, as they stand."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        decoder = json.JSONDecoder()
        at, pos = 0, 0
        while text:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            if at >= len(text):
                return
            start = at
            try:
                _, at = decoder.raw_decode(text, at)
            except ValueError:  # what is left is one object that ``from_json`` reads as NULL
                at = len(text)
            yield pos, text[start:at]
            pos += 1


def split_json_objects(df: DataFrame, text_col: str) -> DataFrame:
    """A4: one row per object of a text that holds several, with its place in the text."""
    return df.lateralJoin(SplitObjects(F.col(text_col).outer()))


def parse_verdicts(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """A4: objects of ``text_col`` parsed to the verdict fields in ``v``; other columns stay."""
    keep = [c for c in texts.columns if c != text_col]
    return split_json_objects(texts, text_col).select(
        *keep, "pos", F.from_json("object", schemas.VERDICT).alias("v")
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A4: verdict files named <task>_<approach>.json, each with several objects."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("_name")
    )
    named = files.select(
        "value",
        F.regexp_replace("_name", "_[^_]*$", "").alias("task"),
        F.regexp_extract("_name", "([^_]+)$", 1).alias("approach"),
    )
    return parse_verdicts(named)


def flatten_review_pages(pages: DataFrame, payload: str = "value") -> DataFrame:
    """A5: page payloads to review rows; ``pos`` is the place on the page."""
    keep = [c for c in pages.columns if c != payload]
    parsed = pages.select(*keep, F.from_json(payload, schemas.REVIEW_PAGE).alias("_p"))
    rows = parsed.select(*keep, F.posexplode("_p.reviews").alias("pos", "_r"))
    return rows.select(
        *keep, "pos", F.col("_r.voted_up").alias("recommended"),
        F.coalesce("_r.review", F.lit("")).alias("review_text"),
        F.col("_r.votes_up").alias("votes_up"),
    )


def flatten_app_details(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """App payloads keyed by id to (app_id, title, description), successful ones only."""
    entries = payloads.select(
        F.explode(F.from_json(payload, schemas.APP_PAYLOAD)).alias("_id", "_app")
    )
    return entries.filter("_app.success").select(
        F.col("_id").cast("int").alias("app_id"),
        F.coalesce("_app.data.name", F.lit("")).alias("title"),
        strip_tags(F.coalesce("_app.data.short_description", F.lit(""))).alias("description"),
    )
