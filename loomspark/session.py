"""Session helpers: table access, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it (as in tests) gets a
    folder of its own; a cluster must name one, as a folder of one machine would lose tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/loomspark-{spark.conf.get('spark.app.id', 'scratch')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application has materialized; its DataFrames that read them end with it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *makes: Callable[[], DataFrame], side: int = 3) -> list[DataFrame]:
    """What the functions make, `side` of them in threads at a time, so that their jobs run side by side. More of them
    add to the driver's memory and wait for each other."""
    with ThreadPoolExecutor(side) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]
        return [r.result() for r in running]


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer computes once: filters on them are not copied below their definition."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
