"""Steps that must end before the next begins: checkpoints in the folder that the cluster shares, and dense numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local session without the setting gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(d: DataFrame) -> DataFrame:
    """``d`` written as Parquet to the shared folder and read from there: it is worked out once, lineage ends, and lost executors
    cost nothing before it."""
    path = f"{shared_folder(d.sparkSession)}/step-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def ordinals(d: DataFrame, *order: str, out: str = "ord") -> DataFrame:
    """``d`` with ``out``: its place in the order, from 0, without gaps. Ranges are sorted side by side; only their counts meet."""
    d = checkpointed(d.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    base = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    d = d.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return d.join(F.broadcast(base), "__p").withColumn(out, F.col("__base") + F.col("__k") - 1).drop("__p", "__k", "__base")


def first_row(d: DataFrame, *order: str) -> DataFrame:
    """The first row in an order, or none."""
    return d.orderBy(*order).limit(1)
