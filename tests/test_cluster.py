"""What a cluster and a stream need."""

import os
import subprocess
import sys

from seriesmith.sources.tables import bars, read_table
from seriesmith.streaming.bars import stream_bars

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def ordered(df):
    return sorted(tuple(r[c] for c in ("k", "bar", "o", "h", "l", "c", "v")) for r in df.collect())


def test_bars_of_a_stream(spark, tmp_path):
    events = read_table(spark, SF, "events")
    want = ordered(bars(events))
    # Four files in the order of time, one a batch.
    by_time = events.orderBy("ts").collect()
    for i in range(4):
        part = by_time[i * len(by_time) // 4 : (i + 1) * len(by_time) // 4]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    made = stream_bars(stream)
    query = made.writeStream.format("memory").queryName("streamed_bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination()
    assert ordered(spark.table("streamed_bars")) == want


def test_bars_break_ties(spark):
    rows = [("a", "2024-01-01 00:00:00", 3.0), ("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:59:00", 2.0), ("a", "2024-01-01 00:59:00", 5.0)]
    events = spark.createDataFrame(rows, "event_type string, ts string, value double").selectExpr("event_type", "CAST(ts AS TIMESTAMP) AS ts", "value")
    r = bars(events).first()
    assert (r["o"], r["h"], r["l"], r["c"], r["v"]) == (1.0, 5.0, 1.0, 5.0, 4.0)


def test_workers_get_the_package(tmp_path):
    """In a session whose workers can't find the package by themselves."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import seriesmith
from seriesmith.functions.series import Series
from seriesmith.operators.recur import Spec, with_recurrences
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
seriesmith.ship(spark)
df = spark.range(50).selectExpr("1 AS k", "id AS pos", "double(id) AS x")
assert with_recurrences(df, Series(["k"], ["pos"]), {{"e": Spec("ema", ("x",), (5,))}}).where("e IS NOT NULL").count() == 46
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
