"""The folder that the driver and all executors share, and what is written there."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="veristream-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add column ``name``, a row's number from 0 within its group.  A group may be larger than a task: rows are sorted by
    ranges, numbered within each, and moved on by what the group has in the ranges before."""
    dealt = checkpointed(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_at", within).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_g", "_p", "_before")
