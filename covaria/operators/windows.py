"""Sliding windows, tiles and frame order of image time series given as pixel rows (t, row, col, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unfold(pixels: DataFrame, k: int, height: int, width: int, stride: int = 1) -> DataFrame:
    """pixels and wrow, wcol: one row for every valid k x k window that a pixel is in (window position = first pixel)."""
    def places(x: str, size: int) -> Column:
        low, high = F.greatest(F.ceil((F.col(x) - (k - 1)) / stride), F.lit(0)), F.least(F.floor(F.col(x) / stride), F.lit((size - k) // stride))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = pixels.withColumn("wrow", F.explode(places("row", height)))
    return rows.withColumn("wcol", F.explode(places("col", width)))


def filled(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """pixels with a row for every place of every date; the values of absent pixels are null."""
    grid = pixels.select("t").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(pixels, ["t", "row", "col"], "left")


def box_sums(pixels: DataFrame, k: int, height: int, width: int, values: list[str]) -> DataFrame:
    """t, wrow, wcol and the sums of values over every valid k x k window, by two range frames instead of k^2 copies.

    Images must have every pixel (see filled); null values count as nothing.
    """
    down = Window.partitionBy("t", "col").orderBy("row").rangeBetween(0, k - 1)
    across = Window.partitionBy("t", "wrow").orderBy("col").rangeBetween(0, k - 1)
    tall = pixels.select("t", F.col("row").alias("wrow"), "col", *(F.sum(v).over(down).alias(v) for v in values)).where(F.col("wrow") <= height - k)
    return tall.select("t", "wrow", F.col("col").alias("wcol"), *(F.sum(v).over(across).alias(v) for v in values)).where(F.col("wcol") <= width - k)


def tile_ranges(height: int, width: int, rows: int, cols: int, window: int) -> list[tuple[int, int, int, int]]:
    """(row from, row to, col from, col to) of a grid of tiles that overlap by half a window on each inner side."""
    def cut(size: int, n: int) -> list[tuple[int, int]]:
        step, half = size // n, window // 2
        return [(max(0, i * step - half), size if i == n - 1 else min(size, (i + 1) * step + half)) for i in range(n)]

    return [(a, b, c, d) for a, b in cut(height, rows) for c, d in cut(width, cols)]


def tiled(pixels: DataFrame, side: int, k: int) -> DataFrame:
    """pixels and trow, tcol: each pixel once in its tile, and again as halo in the tiles before it whose windows reach it.

    Window positions stay global, so results do not depend on the tiling.
    """
    tiles = lambda x: F.sequence(F.greatest(F.floor((x - (k - 1)) / side), F.lit(0)).cast("int"), F.floor(x / side).cast("int"))
    return pixels.withColumn("trow", F.explode(tiles(F.col("row")))).withColumn("tcol", F.explode(tiles(F.col("col"))))


def auto_splits(need_mb: float, free_mb: float) -> tuple[int, int]:
    """Rows and columns of a tile grid whose tiles take a fifth of the free memory at most."""
    n = int(need_mb / (0.2 * free_mb)) + 1
    rows = int(n**0.5)
    return rows, -(-n // rows)


def palindrome_frame(k: Column, frames: int) -> Column:
    """The frame shown at step k: 0 .. T-1, T-2 .. 1, again and again."""
    if frames < 2:
        return F.lit(0)
    period = 2 * frames - 2
    return F.when(k % period < frames, k % period).otherwise(period - k % period)


def palindrome(pixels: DataFrame, frames: int, repeat: int) -> DataFrame:
    """pixels over repeat * frames dates: an index of dates joined to the frames."""
    spark = pixels.sparkSession
    index = spark.range(repeat * frames).select(F.col("id").cast("int").alias("new_t"), palindrome_frame(F.col("id"), frames).cast("int").alias("t"))
    return pixels.join(index, "t").drop("t").withColumnRenamed("new_t", "t")
