"""Monte-Carlo and decision statistics over a long table of statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(keys: list[str], prefix: str) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys), F.lit(True))


def threshold_at_pfa(h0: DataFrame, pfa: float, keys: list[str] = (), stat: str = "stat", accuracy: int = 100_000) -> DataFrame:
    """keys, threshold: the exact (1 - pfa) quantile, linear between values; null statistics are left out.

    A sketch of ranks, which combines before its shuffle, names a range that holds the two values in question;
    those below it are counted, and only distinct values inside it, about 4 / accuracy of all, are put in order.
    """
    keys, q, e = list(keys), 1 - pfa, 2 / accuracy
    rows = h0.where(F.col(stat).isNotNull()).select(*keys, F.col(stat).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [max(0.0, q - e), min(1.0, q + e)], accuracy).alias("_ends"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # the sketch names values whose ranks are off by one at most beyond its accuracy: few values are all taken
    few = F.col("_n") <= accuracy
    ends = ends.select(*(F.col(k).alias(f"e_{k}") for k in keys), "_n", F.when(few, F.col("_least")).otherwise(F.get("_ends", F.lit(0))).alias("_lo"), F.when(few, F.col("_most")).otherwise(F.get("_ends", F.lit(1))).alias("_hi"))
    placed = rows.join(ends, _on(keys, "e_")).where("_v <= _hi")
    counted = placed.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"))  # null: below
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_k").over(w))
    rank = (F.col("_n") - 1) * F.lit(q)
    value = lambda more: F.min(F.when(F.col("_upto") > F.floor(rank) + more, F.col("_v")))
    found = upto.groupBy(*keys).agg(F.first(rank - F.floor(rank)).alias("_part"), value(0).alias("_a"), value(1).alias("_b"))
    return found.select(*keys, (F.col("_a") + F.col("_part") * (F.coalesce("_b", "_a") - F.col("_a"))).alias("threshold"))


def exceeding(stats: DataFrame, thresholds: DataFrame, keys: list[str], name: str, stat: str = "stat") -> DataFrame:
    """keys of thresholds, threshold, name: the share of statistics strictly above it; null statistics are left out.

    A statistic counts for all thresholds below it, so it is placed among its key's sorted thresholds, and shares
    are sums of the counts of places: statistics are not multiplied by thresholds.
    """
    lists = thresholds.groupBy(*keys).agg(F.array_sort(F.collect_set("threshold")).alias("_ts")).select(*(F.col(k).alias(f"t_{k}") for k in keys), "_ts")
    value = F.col(stat)
    placed = stats.where(value.isNotNull()).select(*keys, value.alias("_v")).join(lists, _on(keys, "t_"))
    counts = placed.groupBy(*keys, F.size(F.filter("_ts", lambda t: t < F.col("_v"))).alias("_place")).agg(F.count("*").alias("_c"))
    each = lists.select(*(F.col(f"t_{k}") for k in keys), F.posexplode("_ts").alias("_at", "threshold"))
    share = F.sum(F.when(F.col("_place") > F.col("_at"), F.col("_c")).otherwise(0)) / F.sum("_c")
    return counts.join(each, _on(keys, "t_")).groupBy(*keys, "threshold").agg(share.alias(name))


def pfa_curve(h0: DataFrame, n: int = 500, stat: str = "stat", keys: list[str] = ()) -> DataFrame:
    """keys, threshold, pfa on an even grid from a key's least to its largest statistic: running sums over counts by bucket."""
    keys = list(keys)
    ends = h0.groupBy(*keys).agg(F.min(stat).alias("_lo"), F.max(stat).alias("_hi")).where("_lo is not null")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_lo") + k * (F.col("_hi") - F.col("_lo")) / (n - 1))
    grid = ends.select(*(F.col(k).alias(f"g_{k}") for k in keys), "_lo", "_hi", at.alias("_ts"))
    placed = h0.where(F.col(stat).isNotNull()).join(grid, _on(keys, "g_"))
    step = (F.col("_hi") - F.col("_lo")) / (n - 1)
    guess = F.when(step > 0, F.ceil((F.col(stat) - F.col("_lo")) / F.nullif(step, F.lit(0.0)))).otherwise(0).cast("int")
    point = lambda k: F.get("_ts", k)
    # the number of grid points strictly below the statistic; the guess is off by one at most
    below = F.when(point(guess) < F.col(stat), guess + 1).when((guess > 0) & (point(guess - 1) >= F.col(stat)), guess - 1).otherwise(guess)
    counts = placed.select(*keys, below.alias("_place")).groupBy(*keys, "_place").agg(F.count("*").alias("_c"))
    each = grid.select(*(F.col(f"g_{k}") for k in keys), F.posexplode("_ts").alias("_at", "threshold"))
    share = F.sum(F.when(F.col("_place") > F.col("_at"), F.col("_c")).otherwise(0)) / F.sum("_c")
    return counts.join(each, _on(keys, "g_")).groupBy(*keys, "_at", "threshold").agg(share.alias("pfa")).drop("_at")


def pd_by(h0: DataFrame, h1: DataFrame, pfa: float, by: list[str], stat: str = "stat") -> DataFrame:
    """by, threshold, pd: detection rates under H1 at the threshold that H0 gives; one threshold for all."""
    return h1.crossJoin(F.broadcast(threshold_at_pfa(h0, pfa, stat=stat))).groupBy(*by, "threshold").agg(F.avg((F.col(stat) > F.col("threshold")).cast("double")).alias("pd"))


def power(h0: DataFrame, h1: DataFrame, pfa: float, keys: list[str], stat: str = "stat") -> DataFrame:
    """keys, threshold, power: each key (such as date and mode) with its own threshold."""
    return h1.join(threshold_at_pfa(h0, pfa, keys, stat), keys).groupBy(*keys, "threshold").agg(F.avg((F.col(stat) > F.col("threshold")).cast("double")).alias("power"))


def compare(online: DataFrame, offline: DataFrame, keys: list[str]) -> DataFrame:
    """T, and means and population deviations of online, offline and absolute difference, matched by keys and T."""
    both = online.select(*keys, "T", F.col("stat").alias("a")).join(offline.select(*keys, "T", F.col("stat").alias("b")), [*keys, "T"])
    each = lambda c, name: (F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"))
    return both.withColumn("d", F.abs(F.col("a") - F.col("b"))).groupBy("T").agg(*each("a", "online"), *each("b", "offline"), *each("d", "diff"))


def compare_modes(stats: DataFrame, keys: list[str]) -> DataFrame:
    """compare() of the rows of mode online and offline of one table, read once."""
    one = lambda m: F.max(F.when(F.col("mode") == m, F.col("stat"))).alias(m)
    both = stats.groupBy(*keys, "T").agg(one("online"), one("offline")).where("online is not null and offline is not null").withColumn("diff", F.abs(F.col("online") - F.col("offline")))
    return both.groupBy("T").agg(*(f(c).alias(f"{c}_{s}") for c in ("online", "offline", "diff") for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def chunk_ranges(trials: int, chunk: int) -> Column:
    """The first trial of each chunk, as an array."""
    return F.sequence(F.lit(0), F.lit(max(0, trials - 1)), F.lit(chunk))
