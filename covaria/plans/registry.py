"""Every query of the reference's operators by name, with its SQL where SQL can express it.

Samples come from `embeddings` (group: label), image time series from `lineitem` (group: supplier, date:
year), streams from `events`, scalar statistics from `orders` and `customer`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"two queries named {name}")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """Rounded to six digits, without a negative zero."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return col.alias(name or c) if isinstance(c, str) or name else col


def samples(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    """g, n, x0 .. x(p-1): the first p embedding dimensions by label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("g"), F.col("vec_id").alias("n"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(p)))


def samples_sql(p: int) -> str:
    return "(SELECT label AS g, vec_id AS n, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(p)) + " FROM embeddings)"


def observations(spark: SparkSession, sf_dir: str, p: int, complex_: bool = False) -> DataFrame:
    """obs(g, t, n, re, im) of the embeddings: dimensions 0 .. p-1 and, if complex, 32 .. 32+p-1."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.transform(F.slice("embedding", k + 1, p), lambda v: v.cast("double"))
    return e.select(F.col("label").alias("g"), F.lit(0).alias("t"), F.col("vec_id").cast("int").alias("n"), part(0).alias("re"), (part(32) if complex_ else F.lit(None).cast("array<double>")).alias("im"))


def spread(spark: SparkSession, sf_dir: str, complex_: bool = True, p: int = 4, dates: int = 5) -> DataFrame:
    """obs(g, t, n, re, im): labels as pixels, all samples of each spread over the dates by order of vec_id; sizes differ by one at most."""
    from pyspark.sql import Window

    by = Window.partitionBy("g")
    o = observations(spark, sf_dir, p, complex_).drop("t").withColumn("k", F.row_number().over(by.orderBy("n")) - 1).withColumn("c", F.count("*").over(by))
    o = o.withColumn("t", F.expr(f"cast(k * {dates} div c as int)"))
    return o.select("g", "t", F.expr(f"cast(k - (t * c + {dates - 1}) div {dates} as int)").alias("n"), "re", "im")


#: g, t, n, x0, x1: the same in SQL, for two real features and five dates.
SPREAD = f"(SELECT g, t, k - (t * c + 4) // 5 AS n, x0, x1 FROM (SELECT *, k * 5 // c AS t FROM (SELECT g, x0, x1, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY g) AS c FROM {samples_sql(2)} x) y) z)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, t, x0, x1, x2: line items by supplier and year, features about standardised."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        (F.col("l_suppkey") % 4).alias("g"),
        F.year("l_shipdate").alias("t"),
        ((F.col("l_quantity") - 25.5) / 14.5).alias("x0"),
        ((F.col("l_discount") - 0.05) / 0.03).alias("x1"),
        ((F.col("l_tax") - 0.04) / 0.025).alias("x2"),
    )


SERIES = "(SELECT l_suppkey % 4 AS g, year(l_shipdate) AS t, (l_quantity - 25.5) / 14.5 AS x0, (l_discount - 0.05) / 0.03 AS x1, (l_tax - 0.04) / 0.025 AS x2 FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, row, col, v: a 12 x 12 image for each year, each pixel the mean quantity of its line items."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.year("l_shipdate").alias("t"), (F.col("l_orderkey") % 12).cast("int").alias("row"), (F.col("l_partkey") % 12).cast("int").alias("col")).agg(F.avg("l_quantity").alias("v"))


PIXELS = "(SELECT year(l_shipdate) AS t, (l_orderkey % 12)::INT AS row, (l_partkey % 12)::INT AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
