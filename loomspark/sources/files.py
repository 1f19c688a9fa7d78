"""Documents from files, and tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import dates, doc_id, lead

MOST_BYTES = 10 << 20
#: Path parts that are never read (fixed values).
BLOCKED = ("/etc/", "/proc/", "/sys/", "/dev/", "/.ssh/", "/.aws/", "/.gnupg/", "/.env")


def allowed(path: str | Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), "/+", "/")
    return ~F.exists(F.array(*map(F.lit, BLOCKED)), lambda b: F.contains(plain, b))


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, title, body) of readable files: not blocked, not empty, at most `most_bytes`; wrong UTF-8 is replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.where((F.col("length") > 0) & (F.col("length") <= most_bytes) & allowed("path"))
    body = F.decode("content", "UTF-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("title"), body.alias("body"))


def documents_from(rows: DataFrame, corpus: str, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, corpus, body, l0, dates): ids by content, one row each, without those already known (doc_id)."""
    made = rows.where(F.trim("body") != "").select(doc_id("body").alias("doc_id"), F.lit(corpus).alias("corpus"), "body", lead("body").alias("l0"), dates("body").alias("dates")).dropDuplicates(["doc_id"])
    return made if known is None else made.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
