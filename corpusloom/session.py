"""Session set-up and the shared folder for cut lineage and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; anything in ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _own_folders:
        _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
    return _own_folders[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def narrow_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of the session has at most about ``BATCH_BYTES``, or one row.

    A batch stands in memory on both sides, and buffers on their way to it once more; Spark's own bound is
    for one task's memory and not for that of all tasks of an executor. A smaller setting is left.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut_lineage(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Written once to the shared folder, by these writer's options, and read back by every later use.

    The table outlives lost executors, and being columnar lets each use read only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
