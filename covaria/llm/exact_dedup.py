"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable row.

DataFrame functions only. The grouping key of the one shuffle that carries texts is (hash, text): rows
meet only if their bytes are equal, so a collision of the hash separates into two groups. Copies are
combined before that shuffle, so a group of any size sends each task's copies as one row. Rows are then
joined to the groups of two or more by narrow keys; adaptive execution may split a hot key there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import SPACE, table, whole

_IDS = 2**63 - 1


def _decimal(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")



def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(whole(text), SPACE, "")


def _rank(chars: Column, doc_id: Column) -> Column:
    """A decimal that is larger for more code points, then for a smaller id; a null id comes last."""
    return chars.cast("decimal(10,0)") * _decimal(2**64) + (_decimal(_IDS) - F.coalesce(doc_id, F.lit(_IDS)).cast("decimal(19,0)"))


def exact_dedup(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (identical after white space is deleted), the row with the most code points in the
    original text stays, then the smallest doc_id. Null and empty texts are one group. A null doc_id
    is kept only if no other row of its group has an id (kept is then true, keep_id null). Rows that
    repeat an id are counted in group_size and share its verdict. Other columns are ignored. An empty
    table gives an empty result. hash_bits narrows the hash, for tests of collisions.
    """
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(text).alias("norm"),
        F.length(whole(text)).alias("chars"),
    )
    key = F.substring(F.md5(F.col("norm").cast("binary")), 1, hash_bits // 4)
    exact = base.select(F.unhex(key).alias("h"), "norm", _rank(F.col("chars"), F.col("doc_id")).alias("rank")).groupBy("h", "norm").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    left = (_decimal(_IDS) - F.col("rank") % _decimal(2**64)).cast("long")
    groups = exact.where("n > 1").select(
        F.col("h").alias("g_h"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("g_s"),
        F.col("n").alias("g_n"),
        F.nullif(left, F.lit(_IDS)).alias("g_keep"),
    )
    rows = base.select("doc_id", F.unhex(key).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(groups, (rows["h"] == groups["g_h"]) & (F.unhex(rows["text_sha256"]) == groups["g_s"]), "left")
    keep = F.when(F.col("g_n").isNull(), F.col("doc_id")).otherwise(F.col("g_keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("g_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
