"""Tables that change together: versioned folders and one log entry per change.

Every change writes its rows to new folders and is nothing until its entry stands in the log: a single file, so it is there whole or not
at all. Readers take of every key the newest version in the log. A change that failed halfway leaves folders that nobody reads. There is
one writer per root."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, change_id string, key string"


def log(spark: SparkSession, root: str) -> DataFrame:
    """``version, change_id, key``: the keys each change replaced, and a row without a key for the change itself."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LOG)
        raise


def change(root: str, change_id: str, tables: dict[str, DataFrame], keys: DataFrame, key: str = "area_id") -> bool:
    """Replaces the rows of all ``keys`` (one column, ``key``) in all ``tables`` at once; a key without rows in a table loses those it had.

    Rows of other or null keys are not written. A ``change_id`` that is in the log already changes nothing (false), so a repeated batch is harmless."""
    if "log" in tables:
        raise ValueError("no table may be named log")
    spark = keys.sparkSession
    before = log(spark, root)
    last = before.agg(F.max("version").alias("v"), F.max(F.col("change_id") == change_id).alias("known")).first()
    if last.known:
        return False
    version = (last.v or 0) + 1
    named = keys.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    for name, rows in tables.items():
        kept = rows.join(named.withColumnRenamed("key", key), key, "left_semi")
        kept.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    entry = named.unionByName(spark.createDataFrame([(None,)], "key string"))
    entry = entry.select(F.lit(version).cast("long").alias("version"), F.lit(change_id).alias("change_id"), "key")
    # Names of the keys of one change only: one file is what makes the change atomic.
    entry.coalesce(1).write.mode("append").parquet(f"{root}/log")
    return True


def read(spark: SparkSession, root: str, name: str, key: str = "area_id", keys: DataFrame | None = None) -> DataFrame:
    """Rows of the table ``name`` as the changes in the log left it, of ``keys`` only if given."""
    newest = log(spark, root).filter("key IS NOT NULL").groupBy("key").agg(F.max("version").alias("version")).withColumnRenamed("key", key)
    if keys is not None:
        newest = newest.join(keys.select(key).distinct(), key, "left_semi")
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.join(newest, [key, "version"], "left_semi").drop("version")
