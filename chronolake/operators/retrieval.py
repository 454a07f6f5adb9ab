"""Ranking of texts for whole batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.text import tokens
from chronolake.operators.ranking import rank
from chronolake.session import blocks

#: Query vectors that are compared with all rows at once.
BLOCK = 4096


def postings(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, term, tf: one row per text and term."""
    rows = texts.select(*keep, tokens(F.col("text")).alias("terms"))
    each = rows.select(*keep, F.size("terms").alias("n_words"), F.explode("terms").alias("term"))
    return each.groupBy(*keep, "n_words", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, id_column: str) -> DataFrame:
    best = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.asc_nulls_last(id_column))
    return scored.filter("score > 0").withColumn("rank_no", F.row_number().over(best)).filter(F.col("rank_no") <= k)


def bm25(texts: DataFrame, queries: DataFrame, k: int, id_column: str) -> DataFrame:
    """sample_id, id, score, rank_no of the k best texts by BM25 over the whole collection."""
    return rank(texts.withColumnRenamed(id_column, "id"), queries, k, dated=False).withColumnRenamed("id", id_column)


def asof_bm25(texts: DataFrame, queries: DataFrame, k: int, id_column: str) -> DataFrame:
    """As bm25, but with each question's statistics over only the texts valid at its date t."""
    return rank(texts.withColumnRenamed(id_column, "id"), queries, k, least_mean=1.0).withColumnRenamed("id", id_column)


def phrases(texts: DataFrame, queries: DataFrame, k: int, id_column: str) -> DataFrame:
    """sample_id, id, score, rank_no of the k best texts by phrase_bonus, without the pairs of questions and texts in between."""
    return rank(texts.withColumnRenamed(id_column, "id"), queries, k, dated=False, words=False, phrases=True).withColumnRenamed("id", id_column)


def phrase_counts(texts: DataFrame, id_column: str, n: int) -> DataFrame:
    """In how many texts each n-gram stands."""
    return _phrases(texts, id_column, "text", n).groupBy("phrase").agg(F.count("*").alias("df"))


def _phrases(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """key, phrase: each distinct n-gram of a text. Words become rows with their successors, so none is tokenised twice."""
    words = rows.select(key, tokens(F.col(column)).alias("words"))
    parts = F.arrays_zip(*(F.slice("words", i + 1, F.greatest(F.size("words") - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)))
    each = words.select(key, F.explode(parts).alias("g"))
    return each.select(key, F.concat_ws(" ", *(F.col("g").getField(f"w{i}") for i in range(n))).alias("phrase")).distinct()


def phrase_bonus(texts: DataFrame, queries: DataFrame, id_column: str) -> DataFrame:
    """sample_id, id, bonus: 1.0 of a shared two-word and 1.4 of a shared three-word phrase's idf; each phrase counts once."""
    n = texts.agg(F.count("*").alias("n"))
    found = None
    for size, weight in ((2, 1.0), (3, 1.4)):
        asked = _phrases(queries, "sample_id", "question", size)
        own = _phrases(texts, id_column, "text", size).join(asked.select("phrase").distinct(), "phrase", "left_semi")
        df = own.groupBy("phrase").agg(F.count("*").alias("df"))
        part = own.join(df, "phrase").crossJoin(F.broadcast(n)).join(asked, "phrase").select("sample_id", id_column, (weight * idf(F.col("n"), F.col("df"))).alias("bonus"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("sample_id", id_column).agg(F.sum("bonus").alias("bonus"))


def best_of_group(ranked: DataFrame, group: Column, id_column: str) -> DataFrame:
    """The best text of each group for each question."""
    w = Window.partitionBy("sample_id", group).orderBy(F.desc("score"), F.asc_nulls_last(id_column))
    return ranked.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def _nearest(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = queries.value
        best: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            scores = np.round(asked @ (vectors / np.where(norms == 0, 1.0, norms)).T, 6)
            own = np.broadcast_to(batch.column(0).to_numpy(), scores.shape)
            if best is not None:
                scores, own = np.concatenate([best[0], scores], axis=1), np.concatenate([best[1], own], axis=1)
            order = np.lexsort((own, -scores), axis=1)[:, :k]
            best = np.take_along_axis(scores, order, 1), np.take_along_axis(own, order, 1)
        if best is not None:
            width = best[0].shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, width)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["sample_id", "vec_id", "score"]
            )

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k rows of greatest cosine for each query vector, exactly: blocks of queries against all rows, k kept per task."""
    spark, found = vectors.sparkSession, None
    for part in blocks(queries, "vec_id", block):
        ids = np.array([r["vec_id"] for r in part], np.int64)
        asked = np.array([r["embedding"] for r in part], np.float64)
        norms = np.linalg.norm(asked, axis=1, keepdims=True)
        told = spark.sparkContext.broadcast((ids, asked / np.where(norms == 0, 1.0, norms)))
        one = vectors.select("vec_id", "embedding").mapInArrow(_nearest(told, k), "sample_id long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "sample_id long, vec_id long, score double, rank_no int")
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k)
