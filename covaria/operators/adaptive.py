"""Adaptive detection: each trial's primary sample meets the covariance of its own secondary samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.functions.detectors import Sonar
from covaria.operators.groups import estimate


def _complex(batch: pa.RecordBatch, re: str, im: str) -> np.ndarray:
    part = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return part(re) + 1j * part(im)


def split(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """primary(trial, re, im) and secondary(trial, t, n, re, im) of obs(trial, t, n, re, im): each trial's first sample by n, and the others.

    One row a trial is primary, also where rows share an n: then the least by re and im, in any layout, and the
    rest of them stay secondary. A null n comes last.
    """
    ranked = obs.select("trial", "t", "n", "re", "im", F.row_number().over(Window.partitionBy("trial").orderBy(F.asc_nulls_last("n"), "re", "im")).alias("rank"))
    return ranked.where("rank = 1").select("trial", "re", "im"), ranked.where("rank > 1").select("trial", "t", "n", "re", "im")


def adaptive(primary: DataFrame, secondary: DataFrame | None, sonar: Sonar, estimator, names: tuple[str, ...] = ("glrt", "rao", "independent", "array1", "array2", "matched")) -> DataFrame:
    """trial and a column a statistic. primary(trial, re, im), secondary(trial, t, n, re, im).

    Both sides are keyed by trial; the aggregated side has one row a trial, so Spark joins without
    multiplying rows. A trial without secondary samples has no result; null statistics if its primary
    sample is null.
    """
    if secondary is None:
        raise ValueError("an adaptive detector needs secondary samples")
    joined = primary.select("trial", "re", "im").join(estimate(secondary, ["trial"], estimator), "trial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("re").is_valid()
            whole, missing = batch.filter(known), batch.filter(pc.invert(known))
            if whole.num_rows:
                x, cov = _complex(whole, "re", "im"), _complex(whole, "sigma_re", "sigma_im")
                stats = sonar.all(x, cov.reshape(len(x), x.shape[1], x.shape[1]), adaptive=True)
                yield pa.RecordBatch.from_arrays([whole.column("trial"), *(pa.array(stats[n], pa.float64()) for n in names)], ["trial", *names])
            if missing.num_rows:
                yield pa.RecordBatch.from_arrays([missing.column("trial"), *(pa.nulls(missing.num_rows, pa.float64()) for _ in names)], ["trial", *names])

    return joined.mapInArrow(run, "trial long, " + ", ".join(f"{n} double" for n in names))


def unpivoted(stats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, detector, stat."""
    return stats.unpivot(keys, names, "detector", "stat").where(F.col("stat").isNotNull())
