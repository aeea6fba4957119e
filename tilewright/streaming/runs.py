"""Run a stream over the files that are there and read the result back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tilewright.operators.checkpoints import shared_folder


def work_folder(frame: DataFrame, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input, write Parquet and return what was written."""
    return _written(stream, _run(stream, name, mode))


def run_with_state(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """What ``run_available`` returns, and the state an aggregation goes on with: ``key`` and ``value`` of each group."""
    folder = _run(stream, name, mode)
    return _written(stream, folder), stream.sparkSession.read.format("statestore").load(f"{folder}/state")


def _run(stream: DataFrame, name: str, mode: str) -> str:
    folder = work_folder(stream, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return folder


def _written(stream: DataFrame, folder: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
