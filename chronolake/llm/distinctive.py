"""Problem 2: how distinctive each term is for its record, by smoothed language-model divergence.

A record's language model is its term counts smoothed towards the collection with a Dirichlet prior of mu words,
p(t|d) = (tf + mu p(t|C)) / (|d| + mu). A term's score is its share of the relative entropy of the record against the
collection, p(t|d) ln(p(t|d) / p(t|C)): about zero or below for a word that every record uses, high for one that few share.
A term found in fewer than min_df records is taken for noise of the collection and scores exactly 0.

Plan: records are made distinct by one exchange of the texts on their key; the count of a term within its record then needs no
further exchange, since the rows already lie by record. Collection counts are pre-aggregated in each task. Terms of more than
a 1/HOT_TERMS share of all (record, term) pairs, of which there can be no more than HOT_TERMS, are broadcast; only if the
vocabulary is larger are the other terms joined by an exchange, where no key then has more than that share.

Cases: NULL, empty and wordless texts give no rows; NULL ids are a record id of their own; exact duplicates count once; two
texts under one id are two records; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.session import cut

WORD = r"[\p{L}\p{N}_]+"
#: At most so many terms are broadcast (about 60 bytes each).
HOT_TERMS = 100_000
MU = 1000.0
MIN_DF = 2


def term_counts(records: DataFrame) -> DataFrame:
    """source_table, record_id, text -> one row per record and term with tf and the record's length."""
    one = records.filter(F.col("text").rlike(WORD)).select(
        "source_table", "record_id", F.xxhash64("text").alias("text_key"), "text"
    )
    one = one.groupBy("source_table", "record_id", "text_key").agg(F.first("text").alias("text"))
    terms = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    key = ["source_table", "record_id", "text_key"]
    rows = one.select(*key, terms.alias("terms")).select(*key, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    return rows.groupBy(*key, "n_terms", "term").agg(F.count("*").alias("tf"))


def distinctive_terms(records: DataFrame, mu: float = MU, min_df: int = MIN_DF, hot_terms: int = HOT_TERMS) -> DataFrame:
    """One row per record and term: source_table, record_id, term, tf, score."""
    counts = term_counts(records)
    vocabulary = cut(counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")))
    whole = vocabulary.agg(F.sum("cf").alias("words"), F.sum("df").alias("pairs"), F.count("*").alias("terms")).first()
    words = float(whole["words"] or 0)

    def scored(rows: DataFrame) -> DataFrame:
        background = F.col("cf") / F.lit(words)
        own = (F.col("tf") + F.lit(mu) * background) / (F.col("n_terms") + F.lit(mu))
        score = F.when(F.col("df") >= min_df, F.round(own * F.ln(own / background), 6)).otherwise(F.lit(0.0))
        return rows.select("source_table", "record_id", "term", "tf", score.alias("score"))

    if whole["terms"] <= hot_terms:
        return scored(counts.join(F.broadcast(vocabulary), "term"))
    least = whole["pairs"] / hot_terms
    hot = F.broadcast(vocabulary.filter(F.col("df") > least))
    rare = vocabulary.filter(F.col("df") <= least)
    found = counts.join(hot, "term")
    rest = counts.join(hot.select("term"), "term", "left_anti").join(rare.hint("shuffle_hash"), "term")
    return scored(found).unionByName(scored(rest))


def legal_records(provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The provisions' contents and the retrieved chunks' texts as one collection."""
    return provisions.select(
        F.lit("silver_provisions").alias("source_table"), F.col("provision_id").alias("record_id"), F.col("content").alias("text")
    ).unionByName(
        chunks.select(F.lit("naive_q100").alias("source_table"), F.col("chunk_id").alias("record_id"), "text")
    )


#: The same over the registered tables; mu and the cutoff as above.
SQL = r"""
WITH records AS (
  SELECT DISTINCT source_table, record_id, text FROM (
    SELECT 'silver_provisions' AS source_table, provision_id AS record_id, content AS text FROM silver_provisions
    UNION ALL SELECT 'naive_q100', chunk_id, text FROM naive_q100)),
words AS (
  SELECT source_table, record_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS terms FROM records),
counts AS (
  SELECT source_table, record_id, text, len(terms) AS n_terms, term, count(*) AS tf
  FROM (SELECT *, unnest(terms) AS term FROM words) GROUP BY ALL),
vocabulary AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM counts GROUP BY term),
modelled AS (
  SELECT c.*, df, cf / (SELECT sum(cf) FROM vocabulary)::DOUBLE AS background FROM counts c JOIN vocabulary USING (term)),
own AS (SELECT *, (tf + 1000.0::DOUBLE * background) / (n_terms + 1000.0::DOUBLE) AS p FROM modelled)
SELECT source_table, record_id, term, tf,
       CASE WHEN df >= 2 THEN round(p * ln(p / background), 6) ELSE 0.0::DOUBLE END AS score
FROM own
"""
