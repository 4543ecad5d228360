"""What the text operators share: reading, the shared folder, hashes, fixed-size tables, components.

Every function takes and returns DataFrames. Intermediate results that are used more than once are
written as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``, so that a lost
executor costs a re-read, never the job. Operators delete the tables that their result does not read;
release() deletes what is left once results have been read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the word definition [^\x20\x09-\x0D]+ has it.
SPACE = " \t\n\x0b\x0c\r"
LOCAL_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one all executors share; a local one only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found or 'file://' + LOCAL_DIR}/covaria/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written once to the shared folder, in folders by the values of column `by`, and read back: cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def removed(*tables: DataFrame, folder: str = "") -> None:
    """Deletes stored tables that no later step reads, or one folder of them."""
    for df in tables:
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if path.endswith(folder):
                _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all stored tables of this application; results that have not been read yet are lost."""
    _delete(spark, shared_dir(spark))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _lean(run, rows: int):
    """run over slices of at most `rows` rows, after which a reused Python worker gives its free memory back to the system."""

    def wrapped(batches):
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def arrow_map(df: DataFrame, run, schema: str | StructType, rows: int = 1000) -> DataFrame:
    """df.mapInArrow(run, schema) in slices of at most `rows` rows, as texts can be long; for DataFrame.transform.

    Spark bounds the bytes of a batch by itself (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    return df.mapInArrow(_lean(run, rows), schema)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def multiple(k: int, odd: int | np.uint64) -> np.uint64:
    """k * odd modulo 2^64."""
    return np.uint64(k * int(odd) & (1 << 64) - 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACE.encode())] = False
_CHUNK, _BASE = 1 << 20, 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of texts, A-Z in lower case, by array operations over whole columns.

    A word's hash is a polynomial in its bytes, each first replaced by a random 64-bit number; sums over
    all bytes give every word's value as a difference, a bijection then scrambles it. A text of any
    length is read in chunks, and a word across chunks is put together again from their sums.
    """

    def __init__(self):
        self.codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and for each row how many it has; null has none."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or offsets[-1] == offsets[0]:
            return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        breaks = offsets - offsets[0]
        out, begins, held, size, first = [], [], np.uint64(0), 0, 0
        for a in range(0, len(data), _CHUNK):
            x = _LOWER[data[a : a + _CHUNK]]
            word = _IN_WORD[x]
            edge = np.empty(len(x) + 1, bool)  # whether a word may not go on from the byte before
            edge[1:-1] = ~word[:-1]
            edge[0], edge[-1] = size == 0, True
            cut = breaks[(breaks >= a) & (breaks < a + len(x))] - a
            edge[cut] = True
            if size and (edge[0] or not word[0]):  # the word held from the chunk before has ended there
                out.append(self._scrambled(np.array([held]), np.array([size])))
                begins.append(np.array([first]))
                held, size = np.uint64(0), 0
            starts = np.flatnonzero(word & edge[:-1])
            if size:
                starts = np.concatenate([[0], starts])
            last = np.empty(len(x), bool)
            last[:-1] = ~word[1:] | edge[1:-1]
            last[-1] = True
            ends = np.flatnonzero(word & last) + 1
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(self.codes[x] * self.up[: len(x)], dtype=np.uint64, out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            n, at = ends - starts, starts + a
            if size and len(h):
                h[0] = (int(held) + int(h[0]) * pow(_BASE, size, 1 << 64)) & (1 << 64) - 1
                n[0] += size
                at[0] = first
            if len(ends) and ends[-1] == len(x):  # may go on in the next chunk
                held, size, first = h[-1], int(n[-1]), int(at[-1])
                h, n, at = h[:-1], n[:-1], at[:-1]
            else:
                held, size = np.uint64(0), 0
            out.append(self._scrambled(h, n))
            begins.append(at)
        if size:
            out.append(self._scrambled(np.array([held]), np.array([size])))
            begins.append(np.array([first]))
        return np.concatenate(out), np.diff(np.searchsorted(np.concatenate(begins), breaks))

    @staticmethod
    def _scrambled(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix64(h + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def counter_table(rows: DataFrame, slots: int, chunk: int = 1 << 15) -> np.ndarray:
    """Sum the partial counters in rows (chunk_no int, counters binary of zlib'ed uint32) to their 8-bit logarithms, uint8[slots].

    Partial counters of a chunk meet in one task that adds them one after the other.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                total[k] = total[k] + part if k in total else part
        levels = [np.round(6 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["chunk_no", "counters"])

    parts = max(1, min(slots // chunk, 64))
    summed = rows.repartition(parts, "chunk_no").transform(arrow_map, add, "chunk_no int, counters binary")
    out = np.zeros(slots, np.uint8)
    for k, blob in summed.collect():
        out[k * chunk : (k + 1) * chunk] = np.frombuffer(blob, np.uint8)
    return out


def counter_rows(counts: np.ndarray, chunk: int = 1 << 15) -> Iterator[tuple[int, bytes]]:
    """The non-empty chunks of a task's counters, as counter_table takes them."""
    for k in range(0, len(counts), chunk):
        part = counts[k : k + chunk]
        if part.any():
            yield k // chunk, zlib.compress(part.astype(np.uint32).tobytes(), 1)


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is n or more, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, root), root the smallest reachable id.

    Alternates the large-star and small-star steps of Kiveris et al. until no edge changes. A hub's
    neighbours are never gathered: a step is a grouped minimum, which combines before the shuffle, and
    a join back that adaptive execution may split. Each step is written to the shared folder.
    """
    ab = edges.where("a <> b")
    now = stored(ab.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        then = stored(large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        removed(now)
        now = then
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).groupBy("id").agg(F.min("root").alias("root"))
