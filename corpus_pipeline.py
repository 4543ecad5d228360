"""A training-text pipeline over documents: language ID, quality rules, exact dedup, n-gram join, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns they got, whatever their names, without the rows that
they reject; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import remainder, stored, table
from covaria.llm.exact_dedup import exact_dedup, normalised
from covaria.llm.language_id import UNKNOWN, identify, reference_texts
from covaria.llm.ngram_join import ngram_components
from covaria.llm.packing import pack
from covaria.llm.quality_rules import quality_rules


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1, ... so that no name can clash with an operator's, and the new names."""
    new = {n: f"c{k}" for k, n in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: null texts and those without any letter.

    That is also all that goes where no labelled row is there to learn from. Repeated rows share their verdict.
    """
    references = reference_texts(docs.where(remainder(F.col("doc_id"), 5) != 0))
    plain, new = _plain(docs)
    if references:
        found = identify(plain, references, text=new["text"]).where(F.col("lang_pred") != UNKNOWN)
    else:
        found = plain.where(F.col(new["text"]).rlike(r"\p{L}"))
    return found.select(*(F.col(c).alias(n) for n, c in new.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a rule rejects; null and empty texts have no words and go. Repeated rows share their verdict."""
    return quality_rules(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), keep="row").where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts; null counts as empty.

    A row is known by its doc_id and its normalised text, so an id that other texts share does not take
    them with it; of rows that repeat both, one stays. A null doc_id stays only if its group has no id.
    """
    dropped = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("d_id"), F.col("text_sha256").alias("d_text")).distinct()
    plain, new = _plain(docs)
    rows = plain.withColumn("k_id", F.col(new["doc_id"]).cast("long")).withColumn("k_text", F.sha2(normalised(F.col(new["text"])).cast("binary"), 256))
    left = rows.join(dropped, F.col("k_id").eqNullSafe(F.col("d_id")) & (F.col("k_text") == F.col("d_text")), "left_anti")
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("r_id")).count().where("count > 1").select("r_id")
    if not ids.isEmpty():  # only rows whose id repeats have to be compared
        again = F.col("k_id").eqNullSafe(F.col("r_id"))
        left = left.join(ids, again, "left_anti").union(left.join(ids, again, "left_semi").dropDuplicates(["k_id", "k_text"]))
    return left.select(*(F.col(c).alias(n) for n, c in new.items()))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group that n-gram links connect.

    Texts without words, null ones among them, are linked with nothing and stay, as do rows with a null
    doc_id. Rows that share a doc_id are one document and share its verdict.
    """
    dropped = ngram_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("d_id")).distinct()
    plain, new = _plain(docs)
    left = plain.join(dropped, F.col(new["doc_id"]).cast("long") == F.col("d_id"), "left_anti")
    return left.select(*(F.col(c).alias(n) for n, c in new.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece. Null text is its end id alone; repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("packing", packing)]

#: SQL cannot express language ID or tokens; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "_"))
    return docs
