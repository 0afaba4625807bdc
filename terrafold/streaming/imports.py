"""Continuous import of payload files and a feedback stream, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrafold.functions import rules
from terrafold.operators import ingest
from terrafold.operators.imports import import_run
from terrafold.session import settle
from terrafold.sources import layers, osm, versions


def payload_stream(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Payload files as they arrive; the area is the file's name."""
    raw = spark.readStream.schema(osm.PAYLOAD).option("multiLine", multi_line).json(path)
    area = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("area_id")
    return raw.select(area, "remark", "elements", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"))


def stage_counts(batch: DataFrame, batch_id: int) -> DataFrame:
    """``area_id, batch_id, stage, n``: fetched elements and the ways of each role, one row per area and stage."""
    complete, _ = osm.complete_payloads(batch)
    parts = osm.split_elements(osm.explode_elements(complete))
    fetched = complete.select("area_id", F.lit("fetched").alias("stage"), F.size("elements").alias("n"))
    roles = ingest.classify_ways(parts["ways"]).filter("role IS NOT NULL").select("area_id", F.col("role").alias("stage"), F.lit(1).alias("n"))
    out = fetched.unionByName(roles).groupBy("area_id", "stage").agg(F.sum("n").alias("n"))
    return out.withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def start_import(payloads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the building layer of the areas it brings (an area that has none now loses its rows), so a replayed batch changes nothing; rejected payloads leave the
    area as it was. Stage counts are written per batch id for the same reason."""

    def write(batch: DataFrame, batch_id: int) -> None:
        complete, rejected = osm.complete_payloads(osm.newest_payloads(batch))
        parts = osm.split_elements(osm.explode_elements(complete))
        nodes = osm.fill_way_nodes(parts["nodes"], parts["ways"])
        buildings = ingest.resolve_geometry(ingest.buildings(ingest.classify_ways(parts["ways"])), nodes)
        layers.write_layer(buildings.drop("nodes"), f"{out}/buildings", complete)
        stages = stage_counts(batch, batch_id)
        stages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/stages")
        rejected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/rejected")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_import_run(payloads: DataFrame, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Each batch is one ``import_run`` over all layers: the newest payload of an area wins, one with a problem is rejected whole, and a replayed
    batch changes nothing. Its report goes to ``<root>/reports``. ``name`` tells the changes of this stream from others of the same root."""

    def write(batch: DataFrame, batch_id: int) -> None:
        report = import_run(batch, root, f"{name}/{batch_id}").withColumn("batch_id", F.lit(batch_id))
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/reports")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest valid feedback per block. ``max_by`` combines map-side."""
    ok = feedback.filter(rules.feedback_problem("building_count", "no_buildings").isNull())
    rest = [c for c in feedback.columns if c != "block_id"]
    return ok.groupBy("block_id").agg(F.max_by(F.struct(*rest), "updated_at").alias("_f")).select("block_id", "_f.*")


def start_feedback(events: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Keeps the newest feedback per block as a streaming aggregate in a named in-memory table (complete mode)."""
    return newest_feedback(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_feedback_table(events: DataFrame, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Keeps the newest feedback per block in the table ``feedback`` under ``root`` (``versions.read(spark, root, "feedback", "block_id")``). A batch reads and
    rewrites only the blocks it brings; nothing is held in memory between batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        came = settle(newest_feedback(batch))
        blocks = came.select("block_id")
        if not versions.log(spark, root).isEmpty():
            came = settle(newest_feedback(versions.read(spark, root, "feedback", "block_id", blocks).unionByName(came)))
        versions.change(root, f"{name}/{batch_id}", {"feedback": came}, blocks, "block_id")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
