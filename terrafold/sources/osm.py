"""Map-source payloads: JSON files of ``{"remark": ..., "elements": [...]}`` to one row per element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lat:double,lon:double>"
ELEMENT = (
    "struct<type:string,id:string,lat:double,lon:double,nodes:array<string>,"
    f"geometry:array<{POINT}>,tags:map<string,string>,"
    f"members:array<struct<type:string,ref:string,role:string,geometry:array<{POINT}>>>>"
)
PAYLOAD = f"remark string, elements array<{ELEMENT}>"


def read_osm(spark: SparkSession, path: str, area: Column | None = None, multi_line: bool = True) -> DataFrame:
    """Payload files as rows ``area_id, remark, elements``. The area defaults to the file's name without extension."""
    raw = spark.read.schema(PAYLOAD).json(path, multiLine=multi_line)
    by_file = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return raw.select((area if area is not None else by_file).alias("area_id"), "remark", "elements")


def parse_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """The same from a text column: ``area_id, remark, elements``."""
    parsed = F.from_json(F.col(column), PAYLOAD)
    return df.withColumn("_p", parsed).select("area_id", "_p.remark", "_p.elements")


def newest_payloads(payloads: DataFrame) -> DataFrame:
    """Of several payloads of an area the one that ``arrived`` last (ties: the last ``file`` by name). Payloads without these columns stay as they are."""
    if not {"arrived", "file"} <= set(payloads.columns):
        return payloads
    last = payloads.groupBy("area_id").agg(F.max(F.struct("arrived", "file")).alias("_last"))
    return payloads.join(last, "area_id").filter(F.struct("arrived", "file") == F.col("_last")).drop("_last")


def complete_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, rejected): a payload with any remark is an incomplete answer and is set aside whole."""
    incomplete = F.coalesce(F.trim("remark") != "", F.lit(False)) | F.col("elements").isNull()
    reason = F.when(F.col("elements").isNull(), F.lit("no elements list")).otherwise(F.concat(F.lit("incomplete: "), F.col("remark")))
    return payloads.filter(~incomplete), payloads.filter(incomplete).select("area_id", reason.alias("reason"))


def explode_elements(payloads: DataFrame) -> DataFrame:
    """One row per element, with its position in the payload."""
    return payloads.select("area_id", F.posexplode("elements").alias("element_pos", "e")).select("area_id", "element_pos", "e.*")


def split_elements(elements: DataFrame) -> dict[str, DataFrame]:
    """``nodes``, ``ways``, ``relations`` and ``problems``. A node without coordinates is dropped when it has no
    tags and is a problem when it has some."""
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    tags = F.coalesce(F.col("tags"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    el = elements.withColumn("tags", tags)
    is_node = F.col("type") == "node"
    in_range = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    lost = el.filter(is_node & ~placed & (F.size("tags") > 0)).select("area_id", F.col("id").alias("ref"), F.lit("missing coordinates").alias("problem"))
    bad = el.filter(is_node & placed & ~in_range).select("area_id", F.col("id").alias("ref"), F.lit("invalid coordinates").alias("problem"))
    return {
        "nodes": el.filter(is_node & placed & in_range).select("area_id", "element_pos", F.col("id").alias("node_id"), "lat", "lon", "tags"),
        "ways": el.filter("type = 'way'").select("area_id", "element_pos", F.col("id").alias("way_id"), "nodes", "geometry", "tags"),
        "relations": el.filter("type = 'relation'").select("area_id", "element_pos", F.col("id").alias("relation_id"), "members", "tags"),
        "problems": lost.unionByName(bad),
    }


def fill_way_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """``area_id, node_id, lat, lon``: the given nodes (the last copy of an id wins) plus a node for every way vertex that
    has none, from the first way that carries its position inline."""
    given = nodes.groupBy("area_id", "node_id").agg(F.max_by(F.struct("lat", "lon"), "element_pos").alias("p"))
    inline = (
        ways.filter(F.col("geometry").isNotNull())
        .select("area_id", "element_pos", F.posexplode(F.arrays_zip("nodes", "geometry")).alias("pos", "z"))
        .select("area_id", "element_pos", "pos", F.col("z.nodes").alias("node_id"), F.col("z.geometry").alias("p"))
        .filter("node_id IS NOT NULL AND p.lat IS NOT NULL AND p.lon IS NOT NULL")
    )
    first = inline.groupBy("area_id", "node_id").agg(F.min_by("p", F.struct("element_pos", "pos")).alias("p"))
    added = first.join(given, ["area_id", "node_id"], "left_anti")
    return given.unionByName(added).select("area_id", "node_id", "p.lat", "p.lon")


def newest_first(areas: DataFrame, status: str | None = None, limit: int = 50, blocks: DataFrame | None = None) -> DataFrame:
    """Areas by import day (creation day when never imported), newest first, id as tie, with block counts."""
    from terrafold.operators.compose import count_per

    out = areas.filter(F.col("status") == status) if status else areas
    if blocks is not None:
        out = out.join(count_per(blocks, "block_count"), "area_id", "left").withColumn("block_count", F.coalesce("block_count", F.lit(0)))
    return out.orderBy(F.coalesce("imported_day", "created_day").desc(), "area_id").limit(limit)


__all__ = ["read_osm", "parse_payloads", "newest_payloads", "complete_payloads", "explode_elements", "split_elements", "fill_way_nodes", "newest_first"]
