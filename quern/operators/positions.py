"""Row numbers over a whole frame without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources import scratch


def numbered_table(df: DataFrame, order: list[Column] | None = None, name: str = "position") -> tuple[DataFrame, str]:
    """df with a running number from 0, by `order` if given, and the folder of the table it was written to.

    Rows are ranged and sorted in parallel and written with their partition and their place in it. Range bounds are sampled and may differ
    from run to run, so it is this table that is counted and numbered, not the plan. Only the row count of each partition comes
    to the driver; each row adds its partition's start to its place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    id_ = F.monotonically_increasing_id()
    table, path = scratch.written(ranged.withColumn("_part", F.shiftright(id_, 33).cast("int")).withColumn("_place", id_.bitwiseAND(F.lit((1 << 33) - 1))))
    total, starts = 0, []
    for part, n in sorted(table.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += n
    # a row for each partition: small, however many rows there are
    begin = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return table.join(F.broadcast(begin), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start"), path


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = "position") -> DataFrame:
    """numbered_table() for results that outlive the call; the table stays until the shared folder is cleared."""
    return numbered_table(df, order, name)[0]
