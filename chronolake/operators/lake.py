"""Keyed tables: newest row wins, references checked, lineage joined, snapshots written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.session import cut


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the last by the given order. A key's copies meet in one task, which an upsert's history bounds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows without those whose key comes again, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def required(df: DataFrame, *columns: str, says: str = "a required field is missing") -> DataFrame:
    """The rows, refused (when they are read) where one of the columns is NULL or empty."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.withColumn(columns[0], F.when(~gone, F.col(columns[0])).otherwise(F.raise_error(F.lit(says))))


def with_parent(child: DataFrame, parent: DataFrame, keys: list[str], column: str, says: str = "the parent is missing") -> DataFrame:
    """The child rows with a column of their parent; a child without one is an error."""
    one = parent.select(*keys, F.col(column).alias("_of_parent"), F.lit(True).alias("_there"))
    joined = child.join(one, keys, "left")
    return joined.withColumn(column, F.when(F.col("_there"), F.col("_of_parent")).otherwise(F.raise_error(F.lit(says)))).drop("_of_parent", "_there")


def bronze_path(root: str) -> Column:
    """Where a part is copied to: document, part number, the hash's beginning and the file's name."""
    name = F.regexp_extract("file_path", r"([^/\\\\]*)$", 1)
    safe = F.regexp_replace("logical_doc_id", r"[^\p{L}\p{N}_.-]+", "_")
    return F.concat(F.lit(root.rstrip("/") + "/"), safe, F.lit("/part_"), F.lpad(F.col("part_no").cast("string"), 3, "0"), F.lit("_"), F.substring("physical_file_id", 1, 12), F.lit("_"), name)


def upsert_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bronze: the newest load of each (document, part)."""
    keys = ["logical_doc_id", "part_no"]
    return upsert(old, latest(required(new, *keys, "physical_file_id"), keys, F.desc("ingested_at"), F.asc("physical_file_id")), keys)


def upsert_pages(old: DataFrame, new: DataFrame, parts: DataFrame) -> DataFrame:
    """Silver pages with their file's path from Bronze; a page without its part is an error."""
    keys = ["logical_doc_id", "part_no", "physical_page"]
    found = with_parent(new.drop("file_path"), parts, ["logical_doc_id", "part_no"], "file_path", "a page has no part in Bronze")
    return upsert(old, latest(found, keys, F.desc("created_at")).select(*old.columns), keys)


def refuse(df: DataFrame, issues: DataFrame, says: str) -> DataFrame:
    """The rows, refused when they are read if there is any issue; issues are counted once, no row of them is sent anywhere."""
    found = issues.limit(1).agg(F.count("*").alias("_issues"))
    return df.crossJoin(F.broadcast(found)).filter(F.when(F.col("_issues") == 0, True).otherwise(F.raise_error(F.lit(says)))).drop("_issues")


def upsert_gold(old: DataFrame, new: DataFrame, provisions: DataFrame) -> DataFrame:
    """Gold chunks: all that is needed is there, the mode is known, and each chunk's provision is in Silver."""
    whole = required(new, "chunk_id", "logical_doc_id", "doc_version_hash", "chunk_hash", "physical_file_id", "global_page", "text_content", "provision_id")
    known = F.coalesce(F.col("effectivity_mode").isin("inherit", "explicit_date", "external_trigger", "unknown"), F.lit(False))
    moded = whole.withColumn("effectivity_mode", F.when(known, F.col("effectivity_mode")).otherwise(F.raise_error(F.lit("unknown mode of effect"))))
    checked = refuse(moded, orphans(new, provisions, ["provision_id"]), "a chunk's provision is not in Silver")
    return upsert(old, latest(checked, ["chunk_id"], F.asc("chunk_hash")), ["chunk_id"])


def aliased(df: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """The named columns, each the first non-NULL of its aliases that are there, else its default."""
    there, defaults = set(df.columns), defaults or {}
    columns = []
    for name, others in aliases.items():
        own = [F.col(c) for c in [name, *others] if c in there]
        columns.append(F.coalesce(*own, F.lit(defaults.get(name))).alias(name))
    return df.select(*columns)


def contract_chunks(gold: DataFrame) -> DataFrame:
    """Gold as the contracts know chunks; a chunk without a page is an error."""
    page = F.when(F.col("global_page").isNotNull(), F.col("global_page")).otherwise(F.raise_error(F.lit("a chunk has no page")))
    return gold.select("chunk_id", "article_id", F.col("logical_doc_id").alias("doc_id"), F.col("text_content").alias("text"), page.alias("page_number"), "provision_id", "chunk_hash")


def listing(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in the order of the keys, missing ones last."""
    return df.orderBy(*(F.asc_nulls_last(k) for k in keys))


def columns_of(df: DataFrame) -> DataFrame:
    """position, name, type, nullable of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    if missing := needed - set(df.columns):
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return df


def sorted_values(df: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Each key's distinct values in order."""
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias(name))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the two has, and which."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(
        y.join(x, key, "left_anti").withColumn("only_in", F.lit("right"))
    )


def merge_sets(source: DataFrame, old: DataFrame, key: str, kept: list[str], fresh: list[str] | None = None) -> DataFrame:
    """Full outer merge by key: the old values win, except in the fresh columns; rows that only the old set has stay."""
    fresh = fresh or []
    a, b = source.alias("a"), old.alias("b")
    first = lambda c: ("a", "b") if c in fresh else ("b", "a")
    columns = [F.coalesce(*(F.col(f"{side}.{c}") for side in first(c))).alias(c) for c in [*kept, *(c for c in fresh if c not in kept)]]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *columns)


CACHE_VERSION = 9


def not_cached(samples: DataFrame, cache: DataFrame, model: str, version: int = CACHE_VERSION) -> DataFrame:
    """The samples that have no answer of this model in this version of the cache."""
    held = cache.filter((F.col("model") == model) & (F.col("version") == version)).select("sample_id")
    return samples.join(held.distinct(), "sample_id", "left_anti")


def cached(cache: DataFrame, answers: DataFrame, model: str, version: int = CACHE_VERSION) -> DataFrame:
    """The cache with these answers, each in the place of an earlier one of its model and sample."""
    new = answers.withColumn("model", F.lit(model)).withColumn("version", F.lit(version)).select(*cache.columns)
    return upsert(cache, latest(new, ["model", "sample_id"], F.asc("sample_id")), ["model", "sample_id"])


def result_rows(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """part, body: the summary's and the samples' rows as JSON, for one file of results."""
    body = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("body"))
    return body(summary, "summary").unionByName(body(scored, "sample"))


def lineage(chunks: DataFrame, provisions: DataFrame, parts: DataFrame) -> DataFrame:
    """chunk -> article -> provision -> physical part by document and part number. Each build side has one row a key before it is
    joined, and the articles are chosen before the join."""
    own = provisions.select("provision_id", F.col("title").alias("provision_title"), "start_global_page").dropDuplicates(["provision_id"])
    articles = provisions.filter("level = 'article'").groupBy("article_id").agg(F.min("title").alias("article_title"))
    files = latest(parts, ["logical_doc_id", "part_no"], F.desc("ingested_at")).select("logical_doc_id", "part_no", F.col("physical_file_id").alias("part_file"), "file_path")
    return chunks.join(articles, "article_id", "left").join(own, "provision_id", "left").join(files, ["logical_doc_id", "part_no"], "left")


def rule_key(*columns: str) -> Column:
    """SHA-256 of the fields by line; a NULL is an empty field."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def export(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_all(tables: dict[str, DataFrame], folder: str, work: Callable[[], None] | None = None) -> None:
    """Snapshots of all tables, written also if the work before them fails, whose error is then raised."""
    try:
        if work:
            work()
    finally:
        for name, df in tables.items():
            export(df, f"{folder.rstrip('/')}/{name}.parquet")


def export_vectors(df: DataFrame, path: str, size: int, expected: int | None = None) -> None:
    """The vectors as a table, refused where one has another length or, if a number is told, there are more or fewer."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} vectors where {expected} are expected")
    checked = df.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has another length"))))
    export(checked, path)


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted table with their places from 0: counts of the partitions before, and places within each.

    Only one number per partition goes through the driver."""
    held = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    held = cut(held)
    sizes = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    start, before = 0, {}
    for p in sorted(sizes):
        before[p], start = start, start + sizes[p]
    if not before:
        return held.select(*ordered.columns, F.lit(0).cast("long").alias(name))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return held.select(*ordered.columns, (offset[F.col("_p")] + F.col("_at")).cast("long").alias(name))
