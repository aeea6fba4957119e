"""Reading small tables with all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 256 << 20  # estimated size up to which a table may be dealt out again


def use_all_cores(frame: DataFrame) -> DataFrame:
    """Deal out a small table before its rows are multiplied.

    A table of a few files or one row group is read by one task, which then
    expands every row alone. Larger tables have enough splits and are left as
    they are: the optimizer's size estimate decides, nothing is read.
    """
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_BYTES:
        return frame
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)
