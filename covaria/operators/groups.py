"""Batched kernels over groups: samples are dealt by key, sorted, and handed to NumPy many groups at a time.

One exchange by the group key, one sort within partitions; an Arrow stream is cut where the key changes,
and groups of equal shape are stacked, so that a million small groups cost a few array operations. Only
one group and one Arrow batch are held at a time; a group too large for that belongs to `moments`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OBS = ("t", "n", "re", "im")
#: Bytes of samples that a task holds of one group.
MOST = 1 << 30


def _samples(table: pa.Table) -> np.ndarray:
    re = table.column("re").combine_chunks()
    x = re.flatten().to_numpy(zero_copy_only=False).reshape(len(re), -1).astype(float)
    if "im" in table.column_names and table.column("im").null_count == 0:
        return x + 1j * table.column("im").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
    return x


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]]) if table.num_rows else np.array([0])


def _run(table: pa.Table, keys: list[str], kernel: Callable, names: list[str], schema: pa.Schema, uneven: bool = False) -> pa.RecordBatch:
    edges, x = _edges(table, keys), _samples(table)
    t = table.column("t").combine_chunks().to_numpy(zero_copy_only=False)
    shapes: dict[tuple[int, ...], list[int]] = defaultdict(list)  # by the dates' sizes
    for g, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        sizes = tuple(np.diff([0, *(np.flatnonzero(np.diff(t[i:j])) + 1), j - i]).tolist())
        if uneven or len(set(sizes)) == 1:
            shapes[sizes].append(g)
    out: dict[str, list] = {name: [None] * (len(edges) - 1) for name in names}
    for sizes, groups in shapes.items():
        stack = np.stack([x[edges[g] : edges[g + 1]] for g in groups])
        stack = stack.reshape(len(groups), len(sizes), sizes[0], -1) if len(set(sizes)) == 1 else np.split(stack, np.cumsum(sizes)[:-1], 1)
        for name, values in kernel(stack).items():
            values = np.asarray(values)
            flat = values.tolist() if values.ndim == 1 else values.reshape(len(groups), -1).tolist()
            for g, v in zip(groups, flat, strict=True):
                out[name][g] = v
    firsts = pa.array(edges[:-1])
    columns = [table.column(k).combine_chunks().take(firsts) for k in keys] + [pa.array(out[name], schema.field(name).type) for name in names]
    return pa.RecordBatch.from_arrays(columns, [*keys, *names])


def by_group(obs: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]], out: str, uneven: bool = False, most: int = MOST) -> DataFrame:
    """One row a group of obs(keys, t, n, re[, im]): the keys and the columns `out` that the kernel returns.

    The kernel gets (groups, dates, samples, features) and returns an array a column, first axis groups. A
    group whose dates have unequal numbers of samples has null results, or, if uneven, is given to the kernel
    as a list of its dates, each (groups, samples, features). Rows with a null re are left out; a
    null key is a group of its own; a null im means real data. An empty table gives an empty result. A group
    of more than `most` bytes is an error, not a lost executor: it belongs to `moments`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = obs.where("re is not null")
    rows = rows.select(*keys, *(c for c in OBS if c in rows.columns)).repartition(*keys).sortWithinPartitions(*keys, "t", "n")
    columns = StructType.fromDDL(out)
    names, arrow = columns.names, to_arrow_schema(columns)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the group that is being read

        def done(more: list[pa.Table]) -> pa.RecordBatch:
            return _run(pa.concat_tables([*held, *more]), keys, kernel, names, arrow, uneven)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if held and len(_edges(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys)) > 2:
                yield done([])
                held = []
            edges = _edges(table, keys)
            if len(edges) > 2:
                yield done([table.slice(0, int(edges[-2]))])
                held, table = [], table.slice(int(edges[-2]))
            held.append(table)
            if sum(t.nbytes for t in held) > most:
                raise ValueError(f"a group holds more than {most} bytes: use moments for it, or raise `most`")
        if held:
            yield done([])

    return rows.mapInArrow(run, schema)


def flat(m: np.ndarray, prefix: str = "sigma") -> dict[str, np.ndarray]:
    """Row-major real and imaginary parts of (groups, p, p)."""
    rows = m.reshape(len(m), -1)
    return {f"{prefix}_re": rows.real, f"{prefix}_im": rows.imag if np.iscomplexobj(rows) else np.zeros(rows.shape)}


def estimate(obs: DataFrame, keys: list[str], estimator: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, sigma_re, sigma_im: an estimator of (..., N, p) over all samples of a group."""
    kernel = lambda x: flat(estimator(x.reshape(len(x), -1, x.shape[-1])))
    return by_group(obs, keys, kernel, "sigma_re array<double>, sigma_im array<double>")


def detect(obs: DataFrame, keys: list[str], statistic: Callable[[np.ndarray], np.ndarray], name: str = "stat", uneven: bool = False) -> DataFrame:
    """keys, stat: a statistic of (..., T, N, p) for each group."""
    return by_group(obs, keys, lambda x: {name: statistic(x)}, f"{name} double", uneven)


def running(obs: DataFrame, keys: list[str], step: Callable, uneven: bool = False) -> DataFrame:
    """keys, stats: an online statistic after each date of a group, as an array over its dates."""
    from covaria.functions.detectors import fold

    return by_group(obs, keys, lambda x: {"stats": fold(x, step)}, "stats array<double>", uneven)
