"""Helpers that several operators share: the shared work folder, word rules and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and \t \n \v \f \r.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000

#: The column of row numbers, for steps that must not rely on doc_id.
ROW = "__row"

#: The columns of a row's content key.
K1, K2 = "__k1", "__k2"

#: At most so many copies of one row are made by a task.
SPREAD = 1000


_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the folder that driver and executors share.

    Where the session names none and its master is local (tests, a laptop) it is below a temporary folder, one for each
    application. A cluster without the setting is refused, as executors would lose what they write to their own disks.
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


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor depend on any executor."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rows(df: DataFrame) -> DataFrame:
    """df with a number for each row in ROW, not dense; written to the shared folder, so that a row keeps its number."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def row_keys(df: DataFrame) -> dict[str, Column]:
    """K1 and K2, a 128-bit hash of a row of df. Equal rows have equal keys wherever they lie, so no row numbers are needed."""
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    parts = [x for c in plain for x in (c.isNull(), c)]
    return {K1: F.xxhash64(F.lit(1), *parts), K2: F.xxhash64(F.lit(2), *parts)}


def repeated_rows(df: DataFrame, copies: str, number: str | None = None) -> DataFrame:
    """Each row as often as its column copies (1 or more) says, without that column; number counts the copies from 0.

    df has K1 and K2. Rows of over SPREAD copies are dealt out first, so that no task makes more than SPREAD of one.
    """
    name, c, part = number or "__nth", F.col(copies).cast("long"), F.col("__part")
    few = df.filter(c <= SPREAD).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), c - 1)))
    many = df.filter(c > SPREAD).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c - 1) / SPREAD)))).repartition(K1, K2, "__part")
    many = many.withColumn(name, F.explode(F.sequence(part * SPREAD, F.least(c, (part + 1) * SPREAD) - 1))).drop("__part")
    return few.unionByName(many).drop(copies, *([] if number else ["__nth"]))


def numbered(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """df with dense numbers from 0 in column; order must tell all rows apart. Of each partition its count alone meets the others'."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    sizes, start, rows = sorted((r["__p"], r["count"]) for r in ranged.groupBy("__p").count().collect()), 0, []
    for p, n in sizes:
        rows.append((p, start))
        start += n
    table = df.sparkSession.createDataFrame(rows, "__p int, __start long")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__place", place).join(F.broadcast(table), "__p").select(*df.columns, (F.col("__start") + F.col("__place") - 1).alias(column))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], values: list[str], weight: str, total: int) -> DataFrame:
    """Left join of df with table, which has one row for each key, where one key may hold a third of df's rows.

    weight is table's column with the key's number of rows in df; total is the number of rows of df. Keys of more
    than total / HOT_SHARE rows are at most HOT_SHARE, so they are broadcast; their rows take no part in the
    shuffled join, where a spread negative salt keeps them apart. Other keys are small and meet by a shuffle.
    """
    least = max(total // HOT_SHARE, 1)
    hot = table.filter(F.col(weight) > least).select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    # 0 for each row, in a form that isn't folded: a literal would drop out of the join's keys and leave hot rows together
    zero = F.least(F.col(weight), F.lit(0)).cast("int")
    cold = table.filter(F.col(weight) <= least).select(*keys, zero.alias("_salt"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    spread = F.when(F.col("_hot"), -1 - F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 20))).otherwise(0).cast("int")
    joined = df.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).join(cold, [*keys, "_salt"], "left")
    return joined.select(*df.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
