"""Shared helpers: scratch tables in the cluster's shared folder and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which the right side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows up to which a key's rows are left to one task.
HOT_ROWS = 1_000
#: A null id sorts before every other id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a session within one process may do without; it gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="seriesmith-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{path}")
        path = f"file://{path}"
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``place``, its rows' numbers from 0 in the order given; no task sees more than its range of rows."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = stage(held, name)
    part = F.shiftright("at", 33)  # the id's high bits are the partition
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    # One row for each partition.
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    return held.join(starts, part == F.col("part")).withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).drop("at", "part", "before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The text's bytes; null counts as empty."""
    return F.encode(text_or_empty(name), "UTF-8")


def in_row(df: DataFrame, keep: list[str] | None = None, **more: Column) -> DataFrame:
    """df's columns (or those of keep) as fields of one column ``row``, so that no name of theirs meets one of an operator's; more: columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), *[c.alias(n) for n, c in more.items()])


def others(columns: list[str], added: list[str]) -> list[str]:
    """The columns that added ones do not replace; Spark's names know no case."""
    return [c for c in columns if c.lower() not in added]


def from_row(columns: list[str], row: str = "row") -> list[Column]:
    """The columns that in_row packed."""
    return [F.col(f"{row}.`{c}`") for c in columns]


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, counted: DataFrame | None = None) -> DataFrame:
    """Join with narrow rows: the right side is broadcast if its rows, or those of counted (a written table that it groups), allow."""
    few = (right if counted is None else counted).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on, how)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], name: str, how: str = "inner") -> DataFrame:
    """Join of a written table with one that has one row a key, where a key may hold any share of the left rows; how: inner or left.

    Keys of more than ``HOT_ROWS`` rows, or of more than one in ``BROADCAST_ROWS`` of all rows,
    are joined by broadcast: there can't be more than ``BROADCAST_ROWS`` of them. The others
    shuffle.
    """
    least = max(HOT_ROWS, ceil(left.count() / BROADCAST_ROWS))
    hot = stage(left.groupBy(*on).agg(F.count("*").alias("rows")).where(F.col("rows") > least).select(*on), name)
    if not hot.limit(1).count():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    many = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
    return many.unionByName(left.join(hot, on, "left_anti").join(right, on, how))
