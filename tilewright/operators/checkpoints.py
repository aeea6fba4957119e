"""Reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a temporary folder.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind; what they wrote elsewhere stays."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read on from there; its shuffles are dropped."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    with shuffles_dropped(frame.sparkSession):
        return frame.select("*").checkpoint()


def new_folder(frame: DataFrame, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read on from there; this cuts its lineage and drops its shuffles."""
    folder = new_folder(frame, name)
    with shuffles_dropped(frame.sparkSession):
        frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def drop_stored(frame: DataFrame) -> None:
    """Delete the files of a stored frame that nothing reads any more."""
    spark = frame.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
