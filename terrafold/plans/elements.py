"""The views as map-source elements, in the shape the payload source yields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import ingest, network
from terrafold.plans.views import Views
from terrafold.session import settle
from terrafold.sources import osm

COLUMNS = ["area_id", "element_pos", "type", "id", "lat", "lon", "nodes", "geometry", "tags", "members"]
LATLON = "struct<lat:double,lon:double>"
MEMBER = f"array<struct<type:string,ref:string,role:string,geometry:array<{LATLON}>>>"


def _map(**values):
    entries = F.array(*(F.struct(F.lit(k.replace("__", ":")).alias("key"), c.cast("string").alias("value")) for k, c in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _shape(df: DataFrame, **columns) -> DataFrame:
    types = {"lat": "double", "lon": "double", "nodes": "array<string>", "geometry": f"array<{LATLON}>", "tags": "map<string,string>", "members": MEMBER, "element_pos": "bigint"}
    return df.select(*(columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS))


def elements(v: Views) -> DataFrame:
    """Lattice nodes (every 29th only inline in its row's way), street ways, footprints with their corner nodes, area
    and poi ways, open rings, and turn restriction relations."""
    c = F.col
    n = v.node
    nodes = _shape(
        n.filter("k % 29 <> 28"), area_id=c("area_id"), element_pos=c("k"), type=F.lit("node"), id=c("node_id"), lat=c("lat"), lon=c("lon"),
        tags=_map(amenity=F.when(c("k") % 13 == 0, F.lit("cafe")), shop=F.when(c("k") % 17 == 0, F.lit("bakery")), name=F.when(c("k") % 26 == 0, F.lit("Corner"))),
    )
    vertex = F.struct("pos", "node_id", "lat", "lon")
    first = ["area_id", "town", "axis", "line", "highway", "oneway", "junction", "lanes", "lanes_forward", "name"]
    w = v.way.groupBy("way_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"), *(F.first(x).alias(x) for x in first))
    ways = _shape(
        w, area_id=c("area_id"), element_pos=F.lit(2_000_000_000) + c("town") * 20 + c("axis") * 10 + c("line"), type=F.lit("way"), id=c("way_id"),
        nodes=F.transform("v", lambda e: e["node_id"]),
        geometry=F.when(c("axis") == 0, F.transform("v", lambda e: F.struct(e["lat"].alias("lat"), e["lon"].alias("lon")))),
        tags=_map(highway=c("highway"), oneway=c("oneway"), junction=c("junction"), lanes=c("lanes"), lanes__forward=c("lanes_forward"), name=c("name")),
    )
    b = v.building
    corner = b.select("area_id", "k", F.posexplode(F.slice("ring", 1, 4)).alias("i", "p"))
    corners = _shape(
        corner, area_id=c("area_id"), element_pos=F.lit(4_000_000_000) + c("k") * 4 + c("i"), type=F.lit("node"), id=F.concat(F.lit("b"), c("k"), F.lit("_"), c("i")),
        lat=c("p.y"), lon=c("p.x"), tags=F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")),
    )
    ref = lambda i: F.concat(F.lit("b"), c("k"), F.lit(f"_{i}"))
    ring = F.when(c("k") % 37 == 0, F.array(*(ref(i) for i in range(4)))).otherwise(F.array(*(ref(i) for i in (0, 1, 2, 3, 0))))
    group = c("k") % 6
    shapes = _shape(
        b, area_id=c("area_id"), element_pos=F.lit(6_000_000_000) + c("k"), type=F.lit("way"), id=c("source_id"), nodes=ring,
        tags=_map(
            building=F.when(group < 4, F.lower(F.trim("building"))), height=F.when(group < 4, c("height")), building__levels=F.when(group < 4, c("building_levels")),
            amenity=F.when(group == 4, F.when(c("k") % 4 == 0, F.lit("school")).otherwise(F.lit("parking"))),
            leisure=F.when((group == 5) & (c("k") % 4 == 1), F.lit("park")), natural=F.when((group == 5) & (c("k") % 4 == 3), F.lit("water")),
        ),
    )
    r = v.restriction
    member = lambda t, col, role: F.struct(F.lit(t).alias("type"), c(col).alias("ref"), F.lit(role).alias("role"), F.lit(None).cast(f"array<{LATLON}>").alias("geometry"))
    turns = _shape(
        r, area_id=c("area_id"), element_pos=F.lit(8_000_000_000) + c("ord"), type=F.lit("relation"), id=c("source_id"),
        tags=_map(type=F.lit("restriction"), restriction=c("kind")),
        members=F.array(member("way", "from_way", "from"), member("node", "via_node", "via"), member("way", "to_way", "to")),
    )
    out = nodes
    for part in (ways, corners, shapes, turns):
        out = out.unionByName(part)
    return out


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(v: Views, name: str, build) -> DataFrame:
    """A layer of the import written once per session and data folder, as an import run would write it, and read by
    every query that needs it."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = settle(build())
    return _STAGED[key]


class Imported:
    """The import steps over the views' elements; each layer is staged on first use."""

    def __init__(self, v: Views):
        self.v = v

    @property
    def elements(self) -> DataFrame:
        return staged(self.v, "elements", lambda: elements(self.v))

    @property
    def parts(self) -> dict[str, DataFrame]:
        return osm.split_elements(self.elements)

    @property
    def nodes(self) -> DataFrame:
        return staged(self.v, "nodes", lambda: osm.fill_way_nodes(self.parts["nodes"], self.parts["ways"]))

    @property
    def classified(self) -> DataFrame:
        return staged(self.v, "ways", lambda: ingest.classify_ways(self.parts["ways"]))

    @property
    def roads(self) -> DataFrame:
        return staged(self.v, "roads", lambda: ingest.roads(self.classified)).filter("problem IS NULL")

    @property
    def buildings(self) -> DataFrame:
        return staged(self.v, "buildings", lambda: ingest.resolve_geometry(ingest.buildings(self.classified), self.nodes))

    @property
    def restrictions(self) -> DataFrame:
        return ingest.restrictions(self.parts["relations"])

    @property
    def resolvable(self) -> DataFrame:
        return ingest.resolvable_restrictions(self.restrictions, self.roads, self.nodes)

    @property
    def navigable(self) -> DataFrame:
        return staged(self.v, "navigable", lambda: network.navigable_nodes(self.roads, self.resolvable))

    @property
    def segments(self) -> DataFrame:
        return staged(self.v, "segments", lambda: network.segmentize(self.roads, self.navigable, self.nodes))

    @property
    def turns(self) -> DataFrame:
        def build():
            resolved = network.resolve_restrictions(self.resolvable, self.segments)
            return network.apply_restrictions(network.turn_candidates(self.segments), resolved)

        return staged(self.v, "turns", build)
