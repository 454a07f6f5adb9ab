"""Places for what is not Spark's: page readers, header readers, encoders, retrievers, contract gates, answer writers.

Each is a callable over Arrow batches or pandas frames, or from DataFrame to DataFrame, registered under its kind and name; a hook
may be told as "module:name" and is then imported when it is first asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PageReader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
PAGES = "logical_doc_id string, physical_file_id string, file_path string, part_no int, physical_page int, raw_text string, markdown_content string, tables_json string"


class ContractGate(Protocol):
    """Adds codes and status_code to rows."""

    def __call__(self, rows: DataFrame, checkpoint: str) -> DataFrame: ...


class Retriever(Protocol):
    """The k best chunks of each question: sample_id, rank_no, chunk_id, score and more."""

    def __call__(self, chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame: ...


class AnswerWriter(Protocol):
    """Answers (sample_id, answer) from prompts (sample_id, prompt)."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


_registered: dict[tuple[str, str], Callable | str] = {}


def register(kind: str, name: str, hook: Callable | str) -> None:
    _registered[kind, name] = hook


def hook(kind: str, name: str) -> Callable:
    try:
        found = _registered[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; known are {sorted(n for k, n in _registered if k == kind)}") from None
    if isinstance(found, str):
        module, _, attribute = found.partition(":")
        found = _registered[kind, name] = getattr(import_module(module), attribute)
    return found


register("retriever", "temporal", "chronolake.operators.ranking:temporal")
register("contract_gate", "contracts", "chronolake.operators.contracts:named_checkpoint")


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5, name: str = "temporal") -> DataFrame:
    """The registered retriever of that name on these chunks and questions."""
    return hook("retriever", name)(chunks, questions, k)


def encode(texts: DataFrame, name: str, size: int) -> DataFrame:
    """id, embedding of the texts by a registered encoder over pandas frames; a vector of another length is an error."""
    found = texts.mapInPandas(hook("encoder", name), "id string, embedding array<float>")
    return found.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has another length"))))


def read_pages(files: DataFrame, reader: PageReader, fallback: PageReader | None = None, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages of binary files by a reader. Files that it gives no page for, or whose pages `also` names (path) as not to be used, such
    as those without an article or with a rule that finds no target, are the fallback's."""
    pages = files.mapInPandas(reader, PAGES)
    if fallback is None:
        return pages
    done = pages.select(F.col("file_path").alias("path")).distinct()
    if also is not None:
        bad = also(pages).select("path").distinct()
        done, pages = done.join(bad, "path", "left_anti"), pages.join(bad.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*pages.columns)
    return pages.unionByName(files.join(done, "path", "left_anti").mapInPandas(fallback, PAGES))


# The wording that answers are asked for with.
RULES = (
    "Chỉ trả lời dựa trên CONTEXT. Nếu không đủ, hãy trả lời đúng: \"Không đủ thông tin trong tài liệu.\"\n"
    "Ngày ban hành cho biết văn bản đã có hay chưa; khoảng hiệu lực cho biết quy định có được áp dụng hay không.\n"
    "Kết thúc bằng một dòng riêng: Nguồn: DOCUMENT_ID."
)


def _dated(b: Column) -> Column:
    """A context's dates, status and basis; nothing where it has no basis."""
    date = lambda c, otherwise: F.coalesce(b[c].cast("string"), F.lit(otherwise))
    state = F.when(b["in_force"], "in force at t_event").when(~b["in_force"], "not in force at t_event").otherwise("effectivity at t_event unknown")
    line = F.concat(
        F.lit("Issued: "), date("issued_date", "unknown"), F.lit("; effective: "), date("effective_from", "unknown"), F.lit(" to "), date("effective_to", "open-ended"),
        F.lit("; status: "), state, F.lit("; retrieval basis: "), b["date_basis"], F.lit(".\n"),
    )
    return F.coalesce(line, F.lit(""))


def prompts(ranked: DataFrame, k: int = 5) -> DataFrame:
    """One prompt per question from its k best chunks in order, each with document, article, provision, page and dates.

    ranked: sample_id, question, rank_no, chunk_id, logical_doc_id, article_id, provision_path, global_page, text, issued_date,
    effective_from, effective_to, in_force, date_basis."""
    fields = ["rank_no", "chunk_id", "logical_doc_id", "article_id", "provision_path", "global_page", "text", "issued_date", "effective_from", "effective_to", "in_force", "date_basis"]
    best = ranked.filter(F.col("rank_no") <= k).groupBy("sample_id", "question").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"))
    said = lambda c, otherwise="unknown": F.coalesce(c.cast("string"), F.lit(otherwise))
    block = lambda b, i: F.concat(
        F.lit("[Context "), (i + 1).cast("string"), F.lit("]\nDocument: "), said(b["logical_doc_id"]), F.lit("\nArticle: "), said(b["article_id"]), F.lit("\nProvision: "), said(b["provision_path"]),
        F.lit("\nPage: "), said(b["global_page"]), F.lit("\n"), _dated(b), F.lit("\n"), said(b["text"], ""),
    )
    context = F.array_join(F.transform("blocks", block), "\n\n")
    return best.select("sample_id", F.concat(F.lit(RULES + "\n\nCONTEXT\n"), context, F.lit("\n\nQUESTION\n"), F.col("question"), F.lit("\n\nANSWER\n")).alias("prompt"))


def write_answers(asked: DataFrame, name: str) -> DataFrame:
    """sample_id, answer of the prompts by a registered writer."""
    return asked.select("sample_id", "prompt").mapInPandas(hook("answer_writer", name), "sample_id string, answer string")


def extractive_answers(ranked: DataFrame) -> DataFrame:
    """The stub that answers with the first sentence of the best chunk and names its document."""
    first = F.regexp_extract("text", r"^([^.]*\.?)", 1)
    return ranked.filter("rank_no = 1").select("sample_id", F.concat(first, F.lit("\nNguồn: "), F.col("logical_doc_id")).alias("answer")).distinct()
