"""Files as tables: contents with hashes, JSON with a schema, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", algorithm: str = "sha256") -> DataFrame:
    """path, length and content hash of every file that matches, none of them read by the driver."""
    how = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in how:
        raise ValueError(f"unknown algorithm {algorithm}")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", how[algorithm](F.col("content")).alias("file_hash"))


def incoming(spark: SparkSession, folder: str, pattern: str = "*.pdf", algorithm: str = "sha256") -> DataFrame:
    """The files to take in, in the order of their paths; none at all is an error."""
    rows = hashed_files(spark, folder, pattern, algorithm)
    if rows.select("path").isEmpty():
        raise ValueError(f"no file {pattern} in {folder}")
    return rows.orderBy("path")


# The JSON inputs, as schemas for json_records.
PROVISION_REF = "struct<logical_doc_id:string,provision_id:string,provision_path:string>"
SAMPLES = (
    f"samples array<struct<id:string,query:string,t_event:string,date_basis:string,difficulty:string,category:string,gold_doc_ids:array<string>,"
    f"gold_provisions:array<{PROVISION_REF}>,gold_chunk_ids:array<string>,gold_answer:string,gold_citation_doc_ids:array<string>>>"
)
CONTRACT_RESULTS = "results array<struct<id:string,mutation_type:string,expected:string,actual:string>>"
SUPERSESSION_RULES = (
    "supersession_rules array<struct<target_logical_doc_id:string,target_chunk_id:string,target_provision_id:string,target_provision_path:string,effective_to:date>>"
)
CACHED_ANSWER = "sample_id string, model string, version int, answer string, latency_ms double, chunks array<struct<chunk_id:string,text:string,score:double>>"


def json_records(spark: SparkSession, path: str, schema: T.StructType | str, explode: str | None = None) -> DataFrame:
    """Records of a JSON file, or of the array it holds under a name; a malformed file is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode(explode).alias("one")).select("one.*") if explode else rows


def snapshot(spark: SparkSession, path: str, required: set[str], schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, refused if a required column is missing."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if missing := required - set(df.columns):
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return df
