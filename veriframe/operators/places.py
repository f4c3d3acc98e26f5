"""Places of rows within groups, without a task that gets a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.shared import written


def placed(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """Adds at, the place of a row within its group (from 0) in the order of ``by``.

    One sort by ranges of (group, by): a hot group is spread over as many tasks as its size asks for. The sorted rows are written, since
    ranges are drawn from a sample and places have to fit one deal; the rows that precede in a group are then counted by task.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    parts = written(parts.withColumn("__part", F.spark_partition_id()).withColumn("__nth", inside))
    runs = parts.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.min("__nth").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__shift", F.coalesce(before, F.lit(0)) - F.col("__first"))
    both = parts.join(runs, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return both.select(*rows.columns, (F.col("__nth") + F.col("__shift")).alias("at"))
