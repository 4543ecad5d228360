"""Quality rules: a threshold table compiled into one projection of ratios; no user functions.

RULES has one row per rule: a numerator, a denominator (both counts below) and the closed range in which
their ratio must lie. compile_rules turns any such table into a Column, so that the whole verdict is
evaluated by Spark's own expressions over the whole text in the scan's stage, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import SPACE, table, whole

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its not of on or that the they this to was were which with "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour que qui se sur un une vous "
    "auf aus das dem den der die ein eine er es für ist mit nicht sich sie und von war wie wir zu "
    "al como con del el ella ellos esta este fue la las lo los más no o para pero por que se si sin su sus un una y"
).split()
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: (name, numerator, denominator, least, most); counts are columns of `counts`.
RULES = (
    ("word_length", "word_chars", "n_words", 2.0, 16.0),
    ("symbols", "n_symbols", "n_words", 0.0, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)
_WORD = r"[\x20\x09-\x0D]+"


def _once(x: Column) -> Column:
    """x, computed once a row: the optimizer copies no expression that it holds to be nondeterministic, and so neither
    inlines an array into the lambda functions that index it nor pushes a filter on the verdict below it."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def counts(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """doc_id, the column `keep` if one is named, and, for each whole text, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words and n_stop_words; null text has no words."""
    text = whole(F.col("text"))
    kept = [keep] if keep else []
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *kept,
        _once(F.filter(F.split(text, _WORD), lambda w: w != "")).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    w = lambda i: F.get("w", i)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = first.select("*", _once(F.transform(at, lambda i: F.concat(w(i), F.lit(" "), w(i + 1), F.lit(" "), w(i + 2)))).alias("v"))
    # Where a window occurs twice, each gets its number, so that sorting brings equal ones together without losing their places.
    numbered = F.transform("v", lambda x, i: F.concat(x, F.lit(" "), F.lpad(i.cast("string"), 10, "0")))
    again = F.size(F.array_distinct("v")) < F.size("v")
    second = windows.select("*", _once(F.when(again, F.sort_array(numbered)).otherwise(F.array().cast("array<string>"))).alias("s"))
    third = second.select("*", _once(F.transform("s", lambda x: x.substr(F.lit(1), F.length(x) - 10))).alias("g"))
    g = lambda i: F.get("g", i)
    twice = F.filter(
        F.transform("s", lambda x, i: F.when((g(i) == g(i - 1)) | (g(i) == g(i + 1)), x.substr(F.length(x) - 9, F.lit(10)).cast("int"))),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    stop = F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))
    return third.select(
        "doc_id",
        *kept,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )


def compile_rules(rules=RULES) -> Column:
    """True where every rule's ratio lies in its range; a ratio over nothing is outside."""
    out = F.lit(True)
    for _, top, bottom, least, most in rules:
        ratio = F.col(top) / F.nullif(F.col(bottom), F.lit(0))
        out = out & F.coalesce(ratio.between(least, most), F.lit(False))
    return out


def quality_rules(docs: DataFrame, rules=RULES, min_words: int = MIN_WORDS, keep: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the column `keep` if one is named, the counts, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows give repeated results, a null doc_id
    stays null, other columns are ignored; an empty table gives an empty result.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = counts(docs, keep).withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    return " AND ".join(f"coalesce({top} / nullif({bottom}::DOUBLE, 0) BETWEEN {least} AND {most}, false)" for _, top, bottom, least, most in RULES)


_SPACED = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACED}', '', 'g') <> '') AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) a) b
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range(0, 3)) AS k) s WHERE n > 1 GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACED}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""
