"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch in the jobs that written() and cut() run: a batch stands in memory on both sides.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 20
_paths: list[str] = []
_sessions: list[SparkSession] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Local sessions that name none (tests) get a temporary one; on a
    cluster that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyvine-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses; release() or the end of the process removes what is put there."""
    if not _sessions:
        atexit.register(_at_exit)
    _sessions[:] = [spark]
    _paths.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def set_batches(spark: SparkSession) -> dict[str, str]:
    """From now on the session's Arrow batches have at most BATCH_ROWS rows and BATCH_BYTES bytes; returns what was set before."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    return before


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes while a job runs."""
    before = set_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which keeps df's partitioning."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        done = df.checkpoint(eager=True)
    file = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        fresh_path(df.sparkSession, "cut")
        _paths[-1] = file.get()
    return done


def mark() -> int:
    """The place in the list of intermediate tables from which release() may start."""
    return len(_paths)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Removes the intermediate tables made since a mark, except the one that `keep` reads."""
    kept = keep.inputFiles()[:1] if keep is not None else []
    stay = [p for p in _paths[since:] if any(p.rsplit("/", 1)[-1] in f for f in kept)]
    for path in _paths[since:]:
        if path not in stay:
            _delete(spark, path)
    _paths[since:] = stay


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release(_sessions[0])
