"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import bpe, distinctive, near, packing, pages, personal, split, unify
from chronolake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.found_lines(pages.read_pages(table(spark, folder, "silver_pages"), repair=False))


def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    return pages.repaired_pages(pages.read_pages(table(spark, folder, "silver_pages")))


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    records = distinctive.legal_records(table(spark, folder, "silver_provisions"), table(spark, folder, "naive_q100"))
    return distinctive.distinctive_terms(records)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(split.provision_texts(table(spark, folder, "silver_provisions")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(p3_pieces(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = near.legal_texts(table(spark, folder, "silver_provisions"), table(spark, folder, "naive_q100"))
    return near.id_pairs(*near.similar_texts(texts))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    texts = near.legal_texts(table(spark, folder, "silver_provisions"), table(spark, folder, "naive_q100"))
    members, pairs = near.similar_texts(texts)
    return near.id_groups(members, near.groups(pairs))


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return unify.page_and_provision_texts(table(spark, folder, "silver_pages"), table(spark, folder, "silver_provisions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return unify.found_kinds(_written(spark, folder))


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    return unify.unified(_written(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), ["doc_id"])


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found_mentions(personal.protect(table(spark, folder, "documents")))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    return personal.protect(table(spark, folder, "documents")).select("doc_id", "redacted")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_texts": p8_texts,
}

#: Problems whose result SQL can express; the others are tested against brute force on small fixtures.
SQL: dict[str, str] = {
    "p2_terms": distinctive.SQL,
}
