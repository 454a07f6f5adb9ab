"""Session defaults and small helpers that every plan shares."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "chronolake") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHRONOLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where it is unset a local session gets a temporary one; a cluster's
    executors could not see that, so there it is an error."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not told and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = told or tempfile.mkdtemp(prefix="chronolake-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks(rows: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """The rows in blocks of about `size` in the order of their key, one at a time on the driver; rows of one key stay together.
    For query sets, which go block by block against all rows. Rows without a key ask nothing."""
    last = None
    while True:
        rest = rows.filter(F.col(key).isNotNull() if last is None else F.col(key) > last)
        part = rest.orderBy(key).limit(size).collect()
        if not part:
            return
        full, last = len(part) == size, part[-1][key]
        if full:
            part = [r for r in part if r[key] != last] + rows.filter(F.col(key) == last).collect()
        yield part
        if not full:
            return


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores where the files make fewer tasks than that, before costly work on each row.

    For plans that only scan: behind an exchange the question for the number of partitions would already run it.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= width:
        return df
    return df.repartition(width, *keys)
