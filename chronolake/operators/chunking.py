"""Page-aware chunks with deterministic ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.text import space_tokens, strip_space, windows

SIZE, OVERLAP = 512, 64
SEGMENTS = "array<struct<physical_file_id:string,file_path:string,part_no:int,physical_page:int,global_page:int,text:string>>"


def chunk_hash(chunk_id: Column, version: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.lit("chunk_id="), chunk_id, F.lit("\ndoc_version_hash="), version, F.lit("\ntext="), text), 256)


def metadata(*columns: str) -> Column:
    """What a chunk inherits of its provision, as JSON; NULL fields are left out."""
    return F.to_json(F.struct(*columns))


def json_list(parsed: Column) -> Column:
    """JSON of a list; an empty one is [] and a missing one NULL."""
    return F.to_json(parsed)


def segments(provisions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page segment with text; text that is no JSON list of segments is an error, NULL is an empty list.

    segment_no is the place in the list; page_order orders a provision's segments by page, those without a page last."""
    parsed = F.from_json("page_segments_json", SEGMENTS, {"mode": "FAILFAST"})
    rows = provisions.select("provision_id", "logical_doc_id", *keep, F.posexplode(parsed).alias("segment_no", "s"))
    ordered = F.struct(F.col("s.global_page").isNull().alias("pageless"), F.col("s.global_page").alias("page"), "segment_no")
    return rows.select(
        "provision_id", "logical_doc_id", *keep, "segment_no", "s.physical_file_id", "s.physical_page", "s.global_page", strip_space(F.col("s.text")).alias("text"), ordered.alias("page_order"),
    ).filter("text <> ''")


def checked_provisions(provisions: DataFrame, document: str | None = None) -> DataFrame:
    """The provisions, refused where one has no id or, if a document is told, belongs to another."""
    wrong = F.coalesce(F.col("provision_id"), F.lit("")) == ""
    if document is not None:
        wrong = wrong | ~F.coalesce(F.col("logical_doc_id") == document, F.lit(False))
    return provisions.withColumn("provision_id", F.when(~wrong, F.col("provision_id")).otherwise(F.raise_error(F.lit("a provision has no id or is of another document"))))


def chunks(provisions: DataFrame, size: int = SIZE, overlap: int = OVERLAP, inherit: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping windows of each page segment, numbered within provision and page so that no two share an id; with the columns
    of inherit as they are in the provision, and as JSON in metadata_json."""
    if not 0 <= overlap < size:
        raise ValueError("it must hold that 0 <= overlap < size")
    words = segments(provisions.dropDuplicates(["provision_id"]), inherit).withColumn("words", space_tokens(F.col("text")))
    cut = words.select("*", F.posexplode(windows(F.col("words"), size, overlap)).alias("chunk_index", "piece"))
    page = F.coalesce(F.col("global_page").cast("string"), F.lit("unknown"))
    chunk_id = F.concat_ws(":", "logical_doc_id", "provision_id", page, "segment_no", "chunk_index")
    kept = [*inherit, metadata(*inherit).alias("metadata_json")] if inherit else []
    return cut.select(
        chunk_id.alias("chunk_id"), "provision_id", "logical_doc_id", "physical_file_id", "global_page", "chunk_index", "page_order",
        F.col("piece").alias("text_content"), chunk_hash(chunk_id, F.coalesce("physical_file_id", F.lit("")), F.col("piece")).alias("chunk_hash"), *kept,
    )


def provenance_issues(made: DataFrame) -> DataFrame:
    """Chunks whose hash isn't that of their own id, version and text, or that lack a provision or a page."""
    expected = chunk_hash(F.col("chunk_id"), F.coalesce("physical_file_id", F.lit("")), F.col("text_content"))
    codes = F.filter(
        F.array(
            F.when(F.col("provision_id").isNull() | (F.col("provision_id") == ""), "PROVISION_ID_MISSING"),
            F.when(F.coalesce(F.col("chunk_hash"), F.lit("")) != expected, "CHUNK_HASH_MISMATCH"),
            F.when(F.col("global_page").isNull() | (F.col("global_page") < 1), "CHUNK_PROVENANCE_INVALID"),
        ),
        lambda c: c.isNotNull(),
    )
    return made.select("chunk_id", codes.alias("codes")).filter(F.size("codes") > 0)
