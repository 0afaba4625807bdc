"""Layer tables on storage, one folder per area."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def write_layer(df: DataFrame, path: str, areas: DataFrame | None = None) -> None:
    """Replace the areas present in ``df`` and leave every other area's files alone (dynamic partition overwrite). An area whose import failed is
    simply not in ``df``, so its data stays as it was. Rows of one area are spread over as many files as tasks hold them: a hot area
    is never pulled into one writer.

    ``areas`` (``area_id``) names the areas that were imported; one of them without rows loses its folder."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area_id").parquet(path)
    if areas is not None:
        _drop_folders(df.sparkSession, path, areas.select("area_id").distinct().join(df.select("area_id").distinct(), "area_id", "left_anti"))


def _drop_folders(spark: SparkSession, path: str, emptied: DataFrame) -> None:
    """Removes the folders of areas without rows, through the file system that holds them."""
    gone = {r["area_id"] for r in emptied.toLocalIterator()}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if gone and files.exists(root):
        for entry in files.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith("area_id=") and unquote(name.removeprefix("area_id=")) in gone:
                files.delete(entry.getPath(), True)


def read_layer(spark: SparkSession, path: str, area_ids: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(df["area_id"].isin(area_ids)) if area_ids else df
