"""Work that is spread by ranges: a shared folder for what several steps read, and dense numbers without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors both can write, below spark.checkpoint.dir.

    Where that is unset a local master gets a temporary folder; a cluster is refused, as its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: no later step recomputes it or depends on an executor."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], start: int = 0, column: str = "_seq") -> DataFrame:
    """df with dense numbers from start in the given order, which must tell all rows apart.

    Rows are range-partitioned by order and sorted in their partitions, where each gets its partition and its place in it; a
    partition's first number is the sum of the counts before it, one number for each partition. So there is one shuffle, no task
    sees all rows, and one value of the first columns may have any share of them. What comes back is a scan of the shared folder.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = kept(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(2**33 - 1)
    sizes = dict(ranged.groupBy(part).agg(F.max(place) + 1).collect())
    starts = [start]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    return ranged.select(*df.columns, (F.get(F.lit(starts).cast("array<bigint>"), part) + place).alias(column))
