"""Batches of payloads through the import of all layers, read back from its versioned tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import imports, ingest
from terrafold.plans.elements import Imported
from terrafold.plans.q_network import NET_VIEWS, ROADS, SEGMENTS
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.session import work_dir
from terrafold.sources import versions


def payloads(v: Views) -> DataFrame:
    """One payload per area with elements; the source timed out on every third town."""
    e = Imported(v).elements
    fields = [c for c in e.columns if c not in {"area_id", "element_pos"}]
    packed = e.groupBy("area_id").agg(F.collect_list(F.struct("element_pos", F.struct(*fields).alias("e"))).alias("all"))
    ordered = F.array_sort("all", lambda x, y: F.when(x["element_pos"] < y["element_pos"], -1).when(x["element_pos"] > y["element_pos"], 1).otherwise(0))
    remark = F.when(F.col("town") % 3 == 1, F.lit("timed out"))
    return packed.join(v.town.select("area_id", "town"), "area_id", "left").select("area_id", remark.alias("remark"), F.transform(ordered, lambda x: x["e"]).alias("elements"))


@query(
    "import_run",
    f"""WITH {SEGMENTS},
        came AS (SELECT area_id FROM node_v WHERE k % 29 <> 28 UNION SELECT area_id FROM way_v UNION SELECT area_id FROM building_v UNION SELECT area_id FROM restriction_v),
        part AS (SELECT area_id, 'nodes' AS layer FROM nav UNION ALL SELECT area_id, 'roads' FROM road UNION ALL SELECT area_id, 'segments' FROM seg UNION ALL SELECT area_id, 'restrictions' FROM rr
          UNION ALL SELECT area_id, 'pois' FROM node_v WHERE (k % 13 = 0 OR k % 17 = 0) AND k % 29 <> 28 UNION ALL SELECT area_id, 'pois' FROM building_v WHERE k % 6 = 4
          UNION ALL SELECT area_id, 'buildings' FROM building_v WHERE k % 6 < 4 AND k % 37 <> 0 UNION ALL SELECT area_id, 'areas' FROM building_v WHERE k % 6 = 5 AND k % 4 IN (1, 3) AND k % 37 <> 0),
        run AS (SELECT c.area_id, coalesce(t.town % 3 = 1, FALSE) AS failed FROM came c LEFT JOIN town_v t USING (area_id))
        SELECT r.area_id, CASE WHEN failed THEN 'failed' ELSE 'imported' END AS status, CASE WHEN failed THEN 'incomplete: timed out' END AS problem,
        {", ".join(f"count(CASE WHEN p.layer = '{name}' AND NOT failed THEN 1 END) AS {name}" for name in imports.LAYERS)}
        FROM run r LEFT JOIN part p USING (area_id) GROUP BY r.area_id, failed""",
    ["town", *NET_VIEWS, "building"],
)
def import_run(v: Views):
    root = f"{work_dir(v.spark)}/terrafold/{uuid.uuid4().hex}"
    report = imports.import_run(payloads(v), root, "1").select("area_id", "status", "problem")
    kept = [versions.read(v.spark, root, name).groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(name)) for name in imports.LAYERS]
    wide = reduce(DataFrame.unionByName, kept).groupBy("area_id").pivot("layer", list(imports.LAYERS)).agg(F.sum("n"))
    return report.join(wide, "area_id", "left").select("area_id", "status", "problem", *(F.coalesce(name, F.lit(0)).alias(name) for name in imports.LAYERS))


@query(
    "unresolved_features",
    f"WITH {ROADS} SELECT area_id, way_id AS source_id, count(DISTINCT node_id) AS missing FROM rnode JOIN node_v USING (area_id, node_id) WHERE k % 29 = 28 GROUP BY area_id, way_id",
    NET_VIEWS,
)
def unresolved_features(v: Views):
    # Without the vertices that ways carry inline.
    i = Imported(v)
    return ingest.unresolved(i.roads, i.parts["nodes"])
