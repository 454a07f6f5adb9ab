"""Point-in-time operators over half-open intervals [effective_from, effective_to); a NULL end is open."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(at, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Pushes down to Parquet for a literal date."""
    at = F.lit(at) if isinstance(at, (str, datetime.date)) else at
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def issued_by(df: DataFrame, at) -> DataFrame:
    """Rows issued by a date, whether in force or not."""
    return df.filter(F.col("issued_date") <= at)


def as_of(df: DataFrame, at, docs: DataFrame | None = None) -> DataFrame:
    """Rows valid at a date, of the given documents only if any are given."""
    found = df.filter(valid_at(at))
    return found.join(docs, "logical_doc_id", "left_semi") if docs is not None else found


def superseded(provisions: DataFrame, rules: DataFrame, at) -> DataFrame:
    """Each provision's end as its own rule, or its document's, may bring it forward; valid at the date."""
    ends = rules.filter("effective_to is not null").groupBy("logical_doc_id", "target_path").agg(F.min("effective_to").alias("rule_end"))
    own = ends.filter("target_path <> '*'").withColumnRenamed("target_path", "provision_path").withColumnRenamed("rule_end", "own_end")
    whole = ends.filter("target_path = '*'").select("logical_doc_id", F.col("rule_end").alias("doc_end"))
    joined = provisions.join(own, ["logical_doc_id", "provision_path"], "left").join(whole, "logical_doc_id", "left")
    end = F.least("effective_to", "own_end", "doc_end")
    at = F.lit(at)
    return joined.withColumn("valid_to", end).filter((F.col("effective_from") <= at) & (end.isNull() | (at < end)))


def versions(df: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Validity intervals of a key's versions: each ends where the next begins."""
    order = Window.partitionBy(key).orderBy(start, tie)
    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(order))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, bucket_days: int = 64) -> DataFrame:
    """Each left row with the right version valid at its time: an equi join on key and time bucket.

    A version is repeated for each bucket it touches, so a long-lived key meets no more versions than one bucket holds; the open
    end is closed by the latest time asked for.
    """
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / bucket_days)
    last = left.agg(F.max(at).alias("latest"))
    spans = right.crossJoin(F.broadcast(last)).withColumn(
        "bucket", F.explode(F.sequence(day(F.col("valid_from")), F.greatest(day(F.col("valid_from")), day(F.coalesce("valid_to", "latest")))))
    ).drop("latest")
    asked = left.withColumn("bucket", day(F.col(at)))
    return asked.join(spans, [key, "bucket"]).filter((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))).drop("bucket")


def counts_at(df: DataFrame, dates: DataFrame, measure: Column | None = None) -> DataFrame:
    """For every date how many rows are valid (and the sum of measure), by a sweep over starts and ends instead of a join.

    The window runs over one row per distinct date of change, which calendars bound, not over the rows.
    """
    measure = F.lit(0) if measure is None else measure
    known = df.filter("effective_from is not null and (effective_to is null or effective_to > effective_from)")
    change = known.select(F.col("effective_from").alias("t"), F.lit(1).alias("n"), measure.alias("m")).unionByName(
        known.filter("effective_to is not null").select(F.col("effective_to").alias("t"), F.lit(-1).alias("n"), (-measure).alias("m"))
    )
    asked = dates.select(F.col("t"), F.lit(0).alias("n"), F.lit(0).alias("m")).distinct().withColumn("asked", F.lit(True))
    daily = change.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("t").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("asked").alias("asked")
    )
    run = Window.orderBy("t")
    return daily.select("t", "asked", F.sum("n").over(run).alias("n_valid"), F.sum("m").over(run).alias("total")).filter("asked").drop("asked")
