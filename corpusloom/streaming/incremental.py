"""Work that can stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import pending

Step = Callable[[DataFrame], DataFrame]


def run_batch(spark: SparkSession, source: DataFrame, out: str, step: Step, id_col: str) -> None:
    """I3, batch: apply ``step`` to rows whose id is not in ``out`` yet and append the result."""
    try:
        todo = pending(source, spark.read.parquet(out), id_col)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = source
    step(todo).write.mode("append").parquet(out)


def run_incremental(
    spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, step: Step,
    files_per_batch: int | None = None, fmt: str = "parquet", name_filter: str | None = None, id_col: str | None = None,
) -> None:
    """I3, stream: take what is new in a folder, append the result, stop.

    The checkpoint holds which files are done and the file sink commits a batch once, so a run
    that was cut off neither repeats nor skips rows. With ``id_col`` the stream also keeps the ids
    that are done as keyed state, spread over the shuffle partitions of the first run: a row whose
    id came before, under whatever file name, adds nothing, and of rows that share an id the first
    one met stays. Rows without an id are no repeats of each other and go by file. State grows with
    the ids; ``build_session`` keeps it outside of the heap. ``files_per_batch`` is the flush
    interval; ``name_filter`` picks files by a glob of their own names. ``source`` may be a glob itself,
    of files or of folders of files.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.load(source)
    if id_col:
        known = rows.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        rows = known.unionByName(rows.filter(F.col(id_col).isNull()))
    query = (
        step(rows)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
