"""Executable data contracts: expressions that give the codes of what a row breaks, and the split by them.

Four layers (schema, temporal, quality, provenance) are arrays of codes; a named checkpoint is a choice of layers. A row with any
code is quarantined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import quality
from chronolake.operators.chunking import chunk_hash


@dataclass(frozen=True)
class Limits:
    """Fixed values of the contracts."""

    null_ratio: float = 0.05
    diacritic_density: float = 0.10
    noise_ratio: float = 0.02
    broken_cells: float = 0.05
    require_headers: bool = True
    check_merged_cells: bool = True
    doc_id: str = r"^(?:[0-9]+/[0-9]{4}/(?:NĐ-CP|TT-[A-Z]+|QH[0-9]+|QĐ-[A-Za-z]+|NQ-[A-Z]+)|DOC-[0-9a-f]{24})$"
    required: tuple[str, ...] = ("doc_id", "title", "issued_date", "effective_from")
    doc_types: tuple[str, ...] = ("Nghị định", "Thông tư", "Luật", "Quyết định", "Nghị quyết")
    starts_after_issue: bool = True
    ends_after_start: bool = True
    hash_algorithm: str = "sha256"
    require_storage_path: bool = True
    require_document_hash: bool = True
    require_chunk_page: bool = True
    require_chunk_hash: bool = True
    require_provision_id: bool = True

    @classmethod
    def read(cls, path: str) -> Limits:
        """Limits from a JSON file; names it lacks keep their values, names that are unknown are an error."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if unknown := set(told) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown limits: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def codes(*issues: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(condition, code) for condition, code in issues)), lambda c: c.isNotNull())


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.regexp_replace(F.col(c).cast("string"), r"(?U)\s", "") == "")


def schema_codes(limits: Limits = Limits()) -> Column:
    """SCHEMA_VIOLATION: a required field is NULL or empty (the title: blank), the number has no known form, the type is not one of
    the kinds (NULL is allowed)."""
    missing = F.lit(False)
    for c in limits.required:
        missing = missing | (blank(c) if c == "title" else F.col(c).isNull() | (F.col(c).cast("string") == ""))
    number = ~F.coalesce(F.col("doc_id"), F.lit("")).rlike(limits.doc_id)
    kind = F.col("doc_type").isNotNull() & ~F.col("doc_type").isin(*limits.doc_types) if limits.doc_types else F.lit(False)
    return codes((missing | number | kind, "SCHEMA_VIOLATION"))


def field_codes(required: list[str], number: str = "logical_doc_id", limits: Limits = Limits()) -> Column:
    """As the schema layer, but with a code for each missing field."""
    missing = [(blank(c), f"MISSING_{c.upper()}") for c in required]
    return codes(*missing, (~F.coalesce(F.col(number), F.lit("")).rlike(limits.doc_id), "DOC_ID_INVALID"))


def temporal_codes(limits: Limits = Limits()) -> Column:
    return codes(
        ((F.col("effective_from") < F.col("issued_date")) & F.lit(limits.starts_after_issue), "INVALID_START_DATE"),
        ((F.col("effective_to") <= F.col("effective_from")) & F.lit(limits.ends_after_start), "INVALID_END_DATE"),
    )


def quality_codes(text: str, tables: str, limits: Limits = Limits()) -> Column:
    m = quality.metrics(F.col(text), F.col(tables))
    return codes(
        (m["null_ratio"] > limits.null_ratio, "NULL_RATIO_EXCEEDED"),
        (m["diacritic_density"] < limits.diacritic_density, "DIACRITIC_DENSITY_LOW"),
        (m["ocr_noise_ratio"] > limits.noise_ratio, "OCR_NOISE_EXCEEDED"),
        (m["broken_cells_ratio"] > limits.broken_cells, "TABLE_INTEGRITY_FAILED"),
        (m["missing_table_headers"] & F.lit(limits.require_headers), "TABLE_HEADER_MISSING"),
        ((m["merged_cell_issues"] > 0) & F.lit(limits.check_merged_cells), "MERGED_CELL_ISSUE"),
    )


def with_file_hashes(documents: DataFrame, files: DataFrame) -> DataFrame:
    """The documents with source_found and source_hash of the file at their storage_path. files: path, file_hash; a file that could
    not be hashed has a NULL hash."""
    one = files.groupBy(F.col("path").alias("storage_path")).agg(F.max("file_hash").alias("source_hash"), F.lit(True).alias("_found"))
    return documents.join(one, "storage_path", "left").withColumn("source_found", F.coalesce("_found", F.lit(False))).drop("_found")


def document_provenance_codes(limits: Limits = Limits()) -> Column:
    """One of: no path, no file, no hash of the file, no hash told, another hash told. Needs source_found and source_hash."""
    path, told = F.coalesce(F.col("storage_path"), F.lit("")), F.coalesce(F.col("doc_version_hash"), F.lit(""))
    code = (
        F.when(path == "", F.when(F.lit(limits.require_storage_path), "STORAGE_PATH_MISSING"))
        .when(~F.col("source_found"), "SOURCE_FILE_NOT_FOUND")
        .when(F.col("source_hash").isNull(), "SOURCE_HASH_FAILED")
        .when(F.lit(limits.require_document_hash) & (told == ""), "DOCUMENT_HASH_MISSING")
        .when(F.lit(limits.require_document_hash) & (F.lower(told) != F.col("source_hash")), "DOCUMENT_HASH_MISMATCH")
    )
    return F.array_compact(F.array(code))


def chunk_codes(limits: Limits = Limits()) -> Column:
    """Codes of one chunk beside its document (doc_id, source_hash): a chunk with a missing field or a page below 1 has that code
    alone, since nothing else of it can be told."""
    if not limits.require_chunk_page:
        return F.array().cast("array<string>")
    absent = F.lit(False)
    for c in ("chunk_id", "chunk_doc_id", "text", "chunk_hash", "chunk_version"):
        absent = absent | F.col(c).isNull()
    invalid = absent | F.col("page_number").isNull() | (F.col("page_number") < 1)
    expected = chunk_hash(F.col("chunk_id"), F.col("chunk_version"), F.col("text"))
    hashed = F.lit(limits.require_chunk_hash)
    found = codes(
        (F.col("chunk_doc_id") != F.col("doc_id"), "CHUNK_DOC_ID_MISMATCH"),
        (F.lit(limits.require_provision_id) & (F.coalesce(F.col("provision_id"), F.lit("")) == ""), "PROVISION_ID_MISSING"),
        (hashed & ~F.coalesce(F.lower("chunk_version") == F.col("source_hash"), F.lit(False)), "CHUNK_DOCUMENT_HASH_MISMATCH"),
        (hashed & (F.lower("chunk_hash") != expected), "CHUNK_HASH_MISMATCH"),
    )
    return F.when(invalid, F.array(F.lit("CHUNK_PROVENANCE_INVALID"))).otherwise(found)


def chunk_provenance(documents: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, chunk_issues: the distinct codes of a document's chunks; one without chunks has CHUNKS_MISSING.

    documents: doc_id, source_hash; chunks: of_doc (the document they are checked with), chunk_id, chunk_doc_id, provision_id,
    page_number, text, chunk_hash, chunk_version. Codes are made distinct before they meet, so a document's chunks are never gathered."""
    one = documents.select("doc_id", "source_hash").distinct()
    if not limits.require_chunk_page:
        return one.select("doc_id", F.array().cast("array<string>").alias("chunk_issues"))
    met = one.join(chunks, F.col("doc_id") == F.col("of_doc"))
    each = met.select("doc_id", F.explode_outer(chunk_codes(limits)).alias("code")).distinct()
    found = each.groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("found"))
    return one.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.array(F.lit("CHUNKS_MISSING"))).alias("chunk_issues"))


#: Which layers make which checkpoint.
CHECKPOINTS = {
    "pre_parse": ("schema", "document_provenance"),
    "bronze": ("schema", "document_provenance"),
    "silver": ("schema", "temporal", "quality"),
    "gold": ("schema", "document_provenance", "chunk_provenance"),
    "post_parse": ("schema", "temporal", "quality", "document_provenance", "chunk_provenance"),
}


def checkpoint(df: DataFrame, **layers: Column) -> DataFrame:
    """Adds each layer's codes, all of them, and whether the row passes or is quarantined."""
    checked = df.withColumns(layers)
    every = F.concat(*(F.col(name) for name in layers))
    return checked.withColumn("codes", F.sort_array(every)).withColumn("status_code", F.when(F.size(every) == 0, "PASSED").otherwise("QUARANTINE"))


def named_checkpoint(df: DataFrame, name: str, text: str = "text", tables: str = "tables_json", limits: Limits = Limits()) -> DataFrame:
    """A checkpoint by its name. Layers behind a violated schema are not looked at: the row's fields can't be trusted. The chunk
    layer needs the column chunk_issues of chunk_provenance."""
    made = {
        "schema": lambda: schema_codes(limits),
        "temporal": lambda: temporal_codes(limits),
        "quality": lambda: quality_codes(text, tables, limits),
        "document_provenance": lambda: document_provenance_codes(limits),
        "chunk_provenance": lambda: F.coalesce("chunk_issues", F.array().cast("array<string>")),
    }
    broken = F.size(schema_codes(limits)) > 0
    none = F.array().cast("array<string>")
    layers = {layer: made[layer]() if layer == "schema" else F.when(broken, none).otherwise(made[layer]()) for layer in CHECKPOINTS[name]}
    return checkpoint(df, **layers).withColumn("checkpoint", F.lit(name))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("status_code = 'PASSED'"), checked.filter("status_code = 'QUARANTINE'")


def quarantine_reports(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """checkpoint, report_name, and the report as JSON, of each quarantined row; names keep letters, digits, "_", "." and "-"."""
    _, bad = split(checked)
    name = F.regexp_replace(F.coalesce(F.col(key), F.lit("unknown")), r"[^\p{L}\p{N}_.-]+", "_")
    return bad.select("checkpoint", name.alias("report_name"), F.to_json(F.struct(F.col(key).alias("doc_id"), "checkpoint", "status_code", "codes")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """By checkpoint, so that a later one doesn't overwrite an earlier one's."""
    reports.write.mode("overwrite").partitionBy("checkpoint").json(path)
