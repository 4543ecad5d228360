"""Simulated trials: drawn, estimated and decided in one task, so that only statistics leave it and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covaria.functions.detectors import Sonar
from covaria.sources.generate import sonar_trial

#: Bytes of samples that a task draws at a time.
MOST = 1 << 24

Kernel = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def simulate(spark: SparkSession, cases: int, trials: int, kernel: Kernel, out: str, size: int, parts: int | None = None) -> DataFrame:
    """case, trial and the columns `out` that the kernel returns for each of `trials` trials of each case.

    kernel(cases, trials) gets the numbers of the trials that it draws together, about MOST bytes of them if
    one takes `size` bytes. As long as a trial's samples depend on its numbers alone, any layout of partitions,
    and any retry, gives the same rows. No cases or no trials give an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out))
    step = max(1, MOST // max(1, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), step):
                case, trial = np.divmod(ids[at : at + step], trials)
                got = kernel(case, trial)
                columns = [pa.array(v.tolist() if isinstance(v := got[f.name], np.ndarray) else v, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(case.astype(np.int32)), pa.array(trial), *columns], ["case", "trial", *arrow.names])

    return spark.range(0, cases * trials, 1, parts or 4 * spark.sparkContext.defaultParallelism).mapInArrow(run, f"case int, trial long, {out}")


def sonar_kernel(sonar: Sonar, cov: np.ndarray, detectors: dict[str, tuple], signal: Callable[[int], np.ndarray] | None = None, k: int | None = None, seed: int = 0, shape: float = 1.0, scale: float = 1.0) -> Kernel:
    """A kernel that draws a primary and k secondary samples a trial (2m times 2 if k is None) and returns a column a detector.

    detectors: name to (statistic of Sonar, estimator), the estimator None where the covariance is known.
    signal(case) is added to the primary sample; both come from streams of (seed, case, trial).
    """
    k = 4 * sonar.m if k is None else k
    root = np.linalg.cholesky(cov)
    estimators = {e for _, e in detectors.values() if e is not None}

    def kernel(cases: np.ndarray, trials: np.ndarray) -> dict[str, np.ndarray]:
        drawn = np.stack([sonar_trial((seed, int(c), int(j)), k + 1, root, None, shape, scale) for c, j in zip(cases, trials, strict=True)])
        x, secondary = drawn[:, 0], drawn[:, 1:]
        if signal is not None:
            added = {c: signal(c) for c in np.unique(cases).tolist()}
            x = x + np.stack([added[c] for c in cases.tolist()])
        found = {e: e(secondary) for e in estimators}
        return {name: getattr(sonar, statistic)(x, cov if e is None else found[e]) for name, (statistic, e) in detectors.items()}

    return kernel


def sonar_trials(spark: SparkSession, cases: int, trials: int, kernel: Kernel, detectors: dict[str, tuple], m: int, k: int | None = None, parts: int | None = None) -> DataFrame:
    """case, trial, detector, stat of a `sonar_kernel`."""
    columns = ", ".join(f"`{name}` double" for name in detectors)
    wide = simulate(spark, cases, trials, kernel, columns, (4 * m if k is None else k) * 2 * m * 16, parts)
    return wide.unpivot(["case", "trial"], list(detectors), "detector", "stat")
