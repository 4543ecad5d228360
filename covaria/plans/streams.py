"""Queries that replay a table as a stream and read what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.plans.registry import query, table
from covaria.streaming.online import event_samples, online


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local one only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found or 'file:///tmp/checkpoints'}/covaria/stream-{uuid.uuid4().hex}"


def replayed(samples: DataFrame, step, delay: str, least: int) -> DataFrame:
    """What `online` gives for samples that arrive in two parts, and then time that goes on past the delay."""
    spark = samples.sparkSession
    at = work_folder(spark)
    first, last = samples.agg(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
    late = F.unix_micros("t") > (first + last) // 2 if last is not None else F.lit(False)
    end = samples.sparkSession.range(1).select(F.lit("").alias("key"), (F.timestamp_micros(F.lit(last or 0)) + F.expr("interval 1000 days")).alias("t"), F.array(F.lit(0.0), F.lit(0.0)).alias("re"), F.lit(None).cast("array<double>").alias("im"))
    for part in (samples.where(~late), samples.where(late), end):
        part.write.mode("append").parquet(f"{at}/in")
        stream = online(spark.readStream.schema(samples.schema).parquet(f"{at}/in"), step, delay, least)
        run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("key string, t timestamp, n_dates int, stat double").parquet(f"{at}/out")


_EVENTS = "(SELECT event_type AS key, date_trunc('day', ts) AS t, (value - 50.0) / 30.0 AS x0, (user_id % 17 - 8.0) / 5.0 AS x1 FROM events) x"
_DATES = f"(SELECT key, t, avg(x0 * x0) AS a, avg(x0 * x1) AS b, avg(x1 * x1) AS c FROM {_EVENTS} GROUP BY key, t HAVING count(*) > 2) y"
_OVER = "OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("e02_stream_update", f"SELECT key, strftime(t, '%Y-%m-%d') AS day, n AS n_dates, round(n * ln(ma * mc - mb * mb) - l, 5) + 0.0 AS stat FROM (SELECT key, t, count(*) {_OVER} AS n, avg(a) {_OVER} AS ma, avg(b) {_OVER} AS mb, avg(c) {_OVER} AS mc, sum(ln(a * c - b * b)) {_OVER} AS l FROM {_DATES}) z")
def _(spark, d):
    """The events as a stream, one key a type, one date a day: the running Gaussian statistic."""
    got = replayed(event_samples(table(spark, d, "events")), det.gaussian_step, "2 days", 3)
    return got.select("key", F.date_format("t", "yyyy-MM-dd").alias("day"), F.col("n_dates").cast("long").alias("n_dates"), (F.round("stat", 5) + 0.0).alias("stat"))


query("e10_stream_compound")(lambda spark, d: replayed(event_samples(table(spark, d, "events")), lambda s, x: det.compound_step(s, x, iter_max=20), "2 days", 3))
