"""NumPy files as a source, and results with their provenance as a sink."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, t int, row int, col int, re array<double>, im array<double>"


def read_npy(spark: SparkSession, path: str, time_first: bool = True) -> DataFrame:
    """Pixel rows of .npy image series: (T, H, W, p) or, with time_first False, (H, W, p, T).

    Files are read by Spark's binaryFile source, one task each; an array that is not four-dimensional is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content))
                if a.ndim != 4:
                    raise ValueError(f"{name}: four axes expected, {a.ndim} found")
                a = a if time_first else np.moveaxis(a, -1, 0)
                for t, frame in enumerate(a):
                    h, w, p = frame.shape
                    flat = frame.reshape(-1, p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (h * w)), pa.array(np.full(h * w, t, np.int32)), pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h)), pa.array(list(flat.real.astype(float)), pa.list_(pa.float64())), pa.array(list(flat.imag.astype(float)) if np.iscomplexobj(flat) else [None] * (h * w), pa.list_(pa.float64()))],
                        ["path", "t", "row", "col", "re", "im"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)


def crop(pixels: DataFrame, rows: int = 100, cols: int = 100) -> DataFrame:
    """The first rows and columns; the filter reaches a Parquet scan."""
    return pixels.where((F.col("row") < rows) & (F.col("col") < cols))


def write_time_first(pixels: DataFrame, path: str) -> None:
    """Pixel rows by date: a reader of some dates opens only their folders."""
    pixels.repartition("t").write.mode("overwrite").partitionBy("t").parquet(path)


def export(df: DataFrame, path: str, **provenance) -> None:
    """df as Parquet, and beside it one row of JSON: the arguments, the columns and the number of rows."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    done = df.sparkSession.read.parquet(f"{path}/data")
    facts = json.dumps({"arguments": provenance, "columns": dict(done.dtypes), "rows": done.count()}, default=str, sort_keys=True)
    df.sparkSession.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")
