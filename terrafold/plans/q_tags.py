"""Tag normalisation and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import rules, tags
from terrafold.plans import oracle as o
from terrafold.plans.registry import query
from terrafold.plans.views import Views

TAG_COLUMNS = {
    "highway": "highway", "oneway": "oneway", "junction": "junction", "lanes": "lanes", "lanes:forward": "lanes_forward",
    "lanes:backward": "lanes_backward", "height": "height", "building:levels": "building_levels", "building": "building",
    "amenity": "amenity", "shop": "shop", "leisure": "leisure", "natural": "nat", "landuse": "landuse",
    "restriction": "restriction", "restriction:motorcar": "restriction_motorcar", "restriction:bus": "restriction_bus",
}


def tags_map(table: dict[str, str]):
    """``map<string,string>`` of the tags that are present."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in table.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def tagged(v: Views) -> DataFrame:
    return v.tagset.select("k", tags_map(TAG_COLUMNS).alias("tags"))


WHOLE = lambda c: f"(CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN TRY_CAST(trim({c}) AS INT) END)"
LANES = lambda c: f"(CASE WHEN {WHOLE(c)} >= 1 THEN {WHOLE(c)} END)"
CLASS = (
    "CASE WHEN {h} IN ('motorway','motorway_link') THEN 'motorway' WHEN {h} IN ('trunk','trunk_link') THEN 'trunk' "
    "WHEN {h} IN ('primary','primary_link') THEN 'primary' WHEN {h} IN ('secondary','secondary_link') THEN 'secondary' "
    "WHEN {h} IN ('tertiary','tertiary_link') THEN 'tertiary' WHEN {h} IN ('residential','living_street') THEN 'residential' "
    "WHEN {h} IN ('unclassified','service') THEN {h} END"
)
ONEWAY_TAG = "CASE WHEN {p}oneway IS NOT NULL THEN {p}oneway WHEN {p}junction = 'roundabout' THEN 'yes' END"
ONEWAY = (
    "CASE WHEN lower(trim(coalesce({v}, ''))) IN ('','no','0','false','reversible','alternating') THEN 0 "
    "WHEN lower(trim({v})) IN ('yes','1','true') THEN 1 WHEN trim({v}) = '-1' THEN -1 END"
)


@query("road_class", f"SELECT k, {CLASS.format(h='highway')} AS road_class FROM tagset_v", ["tagset"])
def road_class(v: Views):
    return tagged(v).select("k", tags.road_class(tags.tag("tags", "highway")).alias("road_class"))


@query(
    "oneway_direction",
    f"""SELECT k, {ONEWAY.format(v='ow')} AS direction,
        CASE WHEN {ONEWAY.format(v='ow')} IS NULL THEN 'unsupported oneway value' END AS problem
        FROM (SELECT k, {ONEWAY_TAG.format(p='')} AS ow FROM tagset_v) t""",
    ["tagset"],
)
def oneway_direction(v: Views):
    ow = tags.oneway_effective("tags")
    return tagged(v).select("k", tags.oneway_dir(ow).alias("direction"), tags.oneway_problem(ow).alias("problem"))


@query(
    "lane_counts",
    f"SELECT k, {LANES('lanes')} AS lanes, CASE WHEN {WHOLE('lanes')} < 1 THEN 'invalid lane count' END AS problem FROM tagset_v",
    ["tagset"],
)
def lane_counts(v: Views):
    c = tags.tag("tags", "lanes")
    return tagged(v).select("k", tags.lane_count(c).alias("lanes"), tags.lane_problem(c).alias("problem"))


SPLIT_SQL = """
SELECT {keep}, CAST(CASE WHEN dir <> 0 THEN coalesce({L_fv}, CASE WHEN coalesce(lanes_forward,'') = '' THEN {L_t} END)
            WHEN {L_f} IS NOT NULL THEN {L_f} WHEN {L_b} IS NOT NULL THEN CASE WHEN {L_t} - {L_b} >= 1 THEN {L_t} - {L_b} END
            ELSE {L_t} - {L_t} // 2 END AS INT) AS forward,
       CAST(CASE WHEN dir <> 0 THEN coalesce({L_bv}, CASE WHEN coalesce(lanes_backward,'') = '' THEN {L_t} END)
            WHEN {L_b} IS NOT NULL THEN {L_b} WHEN {L_f} IS NOT NULL THEN CASE WHEN {L_t} - {L_f} >= 1 THEN {L_t} - {L_f} END
            ELSE CASE WHEN {L_t} // 2 >= 1 THEN {L_t} // 2 END END AS INT) AS backward
FROM {source}
"""


def split_sql(source: str, keep: str) -> str:
    return SPLIT_SQL.format(
        keep=keep, source=source, L_t=LANES("lanes"), L_f=LANES("lanes_forward"), L_b=LANES("lanes_backward"),
        L_fv=LANES("lanes_forward"), L_bv=LANES("lanes_backward"),
    )


@query(
    "split_lanes",
    split_sql(f"(SELECT *, {ONEWAY.format(v='ow')} AS dir FROM (SELECT *, {ONEWAY_TAG.format(p='')} AS ow FROM tagset_v) t) u WHERE dir IS NOT NULL", "k"),
    ["tagset"],
)
def split_lanes(v: Views):
    dirs = tags.oneway_dir(tags.oneway_effective("tags"))
    lanes = tags.split_lanes("tags", dirs)
    return tagged(v).filter(dirs.isNotNull()).select("k", lanes["forward"].alias("forward"), lanes["backward"].alias("backward"))


HEIGHT_SQL = """(CASE WHEN regexp_full_match({t}, '[0-9]+([.][0-9]+)?\\s*m?') AND TRY_CAST(trim(replace({t}, 'm', '')) AS DOUBLE) > 0
    THEN TRY_CAST(trim(replace({t}, 'm', '')) AS DOUBLE)
  WHEN regexp_full_match({t}, concat('[0-9]+([.][0-9]+)?\\s*(', chr(39), '|ft|feet)'))
    AND TRY_CAST(regexp_extract({t}, '^[0-9.]+') AS DOUBLE) > 0 THEN TRY_CAST(regexp_extract({t}, '^[0-9.]+') AS DOUBLE) * 0.3048::DOUBLE END)"""
HEIGHT = lambda c: HEIGHT_SQL.format(t=f"replace(lower(trim({c})), ',', '.')")
LEVELS = lambda c: (
    f"(CASE WHEN TRY_CAST(trim({c}) AS DOUBLE) >= 0 AND NOT isnan(TRY_CAST(trim({c}) AS DOUBLE)) "
    f"AND TRY_CAST(trim({c}) AS DOUBLE) = floor(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(trim({c}) AS DOUBLE) AS INT) END)"
)
CATEGORY = (
    "CASE WHEN {b} IN ('commercial','retail') THEN 'commercial' WHEN {b} IN ('industrial','warehouse') THEN 'industrial' "
    "WHEN {b} IN ('civic','school','church','hospital') THEN 'civic' WHEN {b} IN ('yes','house','apartments','residential') THEN 'residential' "
    "WHEN {b} IS NOT NULL THEN 'unspecified' END"
)


@query(
    "building_attributes",
    f"""SELECT k, {o.rn(HEIGHT('height'), 6)} AS height_m, {LEVELS('building_levels')} AS n_levels,
        {CATEGORY.format(b='building')} AS category, nullif(lower(trim(building)), '') AS building_type FROM tagset_v""",
    ["tagset"],
)
def building_attributes(v: Views):
    t = lambda k: tags.tag("tags", k)
    return tagged(v).select(
        "k", F.round(tags.height_meters(t("height")), 6).alias("height_m"), tags.levels(t("building:levels")).alias("n_levels"),
        tags.building_category(t("building")).alias("category"), tags.building_type(t("building")).alias("building_type"),
    )


POI_SQL = """CASE WHEN amenity IS NULL AND shop IS NULL THEN NULL WHEN pv IN ('restaurant','cafe','bar') THEN 'food_and_drink'
   WHEN pv IN ('hospital','clinic','pharmacy') THEN 'health' WHEN pv IN ('school','college','kindergarten') THEN 'education'
   WHEN pv IN ('bus_station','parking','fuel') THEN 'transit' WHEN shop IS NOT NULL THEN 'shopping' ELSE 'other' END"""
AREA_SQL = """CASE WHEN leisure = 'park' THEN 'park' WHEN nat = 'water' THEN 'water' WHEN landuse IN ('grass','recreation_ground') THEN 'green_space'
   WHEN landuse = 'forest' OR nat = 'wood' THEN 'forest' WHEN landuse IN ('farmland','meadow','orchard','vineyard','farmyard') THEN 'farmland'
   WHEN landuse = 'cemetery' OR amenity = 'grave_yard' THEN 'cemetery' WHEN landuse = 'railway' THEN 'railway' WHEN landuse = 'industrial' THEN 'industrial' END"""


@query("poi_category", f"SELECT k, {POI_SQL} AS category FROM (SELECT *, coalesce(nullif(amenity, ''), shop) AS pv FROM tagset_v) t", ["tagset"])
def poi_category(v: Views):
    return tagged(v).select("k", tags.poi_category("tags").alias("category"))


@query("area_kind", f"SELECT k, {AREA_SQL} AS kind FROM tagset_v", ["tagset"])
def area_kind(v: Views):
    return tagged(v).select("k", tags.area_kind("tags").alias("kind"))


KIND_LIST = "'no_left_turn','no_right_turn','no_straight_on','no_u_turn','only_left_turn','only_right_turn','only_straight_on'"


@query(
    "restriction_kind",
    f"""SELECT k, CASE WHEN rv IN ({KIND_LIST}) THEN rv END AS kind, CASE WHEN rv IN ({KIND_LIST}) THEN 'car'
        WHEN rv IS NULL AND restriction_bus IS NOT NULL THEN 'other_vehicle' ELSE 'malformed' END AS outcome
        FROM (SELECT *, coalesce(restriction, restriction_motorcar) AS rv FROM tagset_v) t""",
    ["tagset"],
)
def restriction_kind(v: Views):
    r = tags.restriction_kind("tags")
    return tagged(v).select("k", r["kind"].alias("kind"), r["outcome"].alias("outcome"))


@query(
    "normalized_names",
    "SELECT DISTINCT way_id, nullif(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '') AS name FROM way_v",
    ["way"],
)
def normalized_names(v: Views):
    return v.way.select("way_id", tags.norm_name("name").alias("name")).distinct()


LANE_TYPE = "CASE WHEN {c} = 'service' THEN 'narrow' WHEN {c} IN ('residential','unclassified','tertiary') THEN 'normal' WHEN {c} IS NOT NULL THEN 'wide' END"
LANE_WIDTH = "CASE WHEN {c} = 'service' THEN 2.75::DOUBLE WHEN {c} IN ('residential','unclassified','tertiary') THEN 3.25::DOUBLE WHEN {c} IS NOT NULL THEN 3.65::DOUBLE END"


@query(
    "lane_types",
    f"SELECT k, {LANE_TYPE.format(c='c')} AS lane_type, {LANE_WIDTH.format(c='c')} AS lane_width_m FROM (SELECT k, {CLASS.format(h='highway')} AS c FROM tagset_v) t",
    ["tagset"],
)
def lane_types(v: Views):
    c = tags.road_class(tags.tag("tags", "highway"))
    return tagged(v).select("k", tags.lane_type(c).alias("lane_type"), tags.lane_width(c).alias("lane_width_m"))


ADDRESS = {
    "suburb": "CASE WHEN k % 3 = 0 THEN seg END", "village": "CASE WHEN k % 4 = 1 THEN concat(' ', nat, ' ') END",
    "city": "CASE WHEN k % 5 <> 2 THEN nat END", "county": "CASE WHEN k % 7 = 2 THEN '  ' ELSE seg END", "country": "CASE WHEN k % 6 <> 0 THEN nat END",
}
ADDRESS_SQL = ", ".join(f"{sql} AS {name}" for name, sql in ADDRESS.items())
ADDRESS_FROM = "(SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment AS seg, concat('Nation ', c_nationkey) AS nat FROM customer) b"


@query(
    "place_from_address",
    f"""SELECT k, name, CASE WHEN around IS NULL THEN land WHEN land IS NULL THEN around ELSE concat(around, ', ', land) END AS context
    FROM (SELECT k, name, coalesce(CASE WHEN ci IS DISTINCT FROM name THEN ci END, CASE WHEN vi IS DISTINCT FROM name THEN vi END,
                                   CASE WHEN co IS DISTINCT FROM name THEN co END) AS around,
                 CASE WHEN cn IS DISTINCT FROM name THEN cn END AS land
      FROM (SELECT k, nullif(trim(suburb),'') AS su, nullif(trim(village),'') AS vi, nullif(trim(city),'') AS ci, nullif(trim(county),'') AS co,
                   nullif(trim(country),'') AS cn, coalesce(nullif(trim(suburb),''), nullif(trim(village),''), nullif(trim(city),''), nullif(trim(county),'')) AS name
            FROM (SELECT k, {ADDRESS_SQL} FROM {ADDRESS_FROM}) a) n) m""",
)
def place_from_address(v: Views):
    rows = v.spark.sql(f"SELECT k, {ADDRESS_SQL} FROM {ADDRESS_FROM.replace('customer', '{customer}')}", customer=v.table("customer"))
    p = tags.place_from_address(tags_map({k: k for k in ADDRESS}))
    return rows.select("k", p["name"].alias("name"), p["context"].alias("context"))


PLACES = """SELECT k, CASE WHEN k % 11 = 5 THEN 'north' ELSE CAST(lat AS VARCHAR(40)) END AS lat, CAST(lon AS VARCHAR(40)) AS lon,
  CASE WHEN k % 9 = 4 THEN '' ELSE concat(kind, ' ', area_id, ', Land') END AS display_name, CASE WHEN k % 2 = 0 THEN concat('Place ', k) ELSE '' END AS name,
  CASE WHEN k % 3 = 0 THEN kind END AS category, CASE WHEN k % 3 <> 1 THEN 'amenity' END AS class, kind AS type, k % 4 = 0 AS boxed FROM {poi}"""


@query(
    "normalized_places",
    f"""SELECT k, display_name, coalesce(nullif(name, ''), trim(split_part(display_name, ',', 1))) AS name, {o.r6('CAST(lat AS DOUBLE)')} AS lat,
       {o.r6('CAST(lon AS DOUBLE)')} AS lon, {o.r6("CASE WHEN boxed THEN CAST(lat AS DOUBLE) - 1 ELSE CAST(lat AS DOUBLE) - 0.005::DOUBLE END")} AS south,
       {o.r6("CASE WHEN boxed THEN CAST(lon AS DOUBLE) + 2 ELSE CAST(lon AS DOUBLE) + 0.005::DOUBLE END")} AS east, coalesce(category, class) AS category, type
       FROM ({PLACES.format(poi='poi_v')}) p WHERE display_name <> '' AND TRY_CAST(lat AS DOUBLE) IS NOT NULL""",
    ["poi"],
)
def normalized_places(v: Views):
    rows = v.spark.sql(PLACES.replace("VARCHAR(40)", "STRING"), poi=v.poi)
    num = lambda c, d: (F.col(c).try_cast("double") + d).cast("string")
    rows = rows.withColumn("boundingbox", F.when(F.col("boxed"), F.array(num("lat", -1), num("lat", 1), num("lon", -2), num("lon", 2)))).drop("boxed")
    p = tags.normalize_places(rows)
    return p.select("k", "display_name", "name", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "south", "east")), "category", "type")


@query(
    "boxes_from_corners",
    """SELECT k, round(least(a.lat, b.lat), 7) + 0.0 AS min_lat, round(least(a.lon, b.lon), 7) + 0.0 AS min_lon, round(greatest(a.lat, b.lat), 7) + 0.0 AS max_lat,
       round(greatest(a.lon, b.lon), 7) + 0.0 AS max_lon, a.lat = b.lat AND a.lon = b.lon AS same
       FROM poi_v a JOIN (SELECT k, lat, lon FROM ping_v) b USING (k)""",
    ["poi", "ping"],
)
def boxes_from_corners(v: Views):
    a, b = v.poi.select("k", "lat", "lon"), v.ping.select("k", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    j = a.join(b, "k").withColumn("box", tags.round_bbox(tags.bbox_from_corners("lat", "lon", "lat2", "lon2")))
    one, two = tags.bbox_from_corners("lat", "lon", "lat", "lon"), tags.bbox_from_corners("lat2", "lon2", "lat2", "lon2")
    return j.select("k", "box.min_lat", "box.min_lon", "box.max_lat", "box.max_lon", tags.same_bbox(one, two).alias("same"))


@query("coordinate_checks", "SELECT k, (lat * 10 BETWEEN -90 AND 90) AND (lon * 2.15::DOUBLE BETWEEN -180 AND 180) AS ok FROM node_v", ["node"])
def coordinate_checks(v: Views):
    return v.node.select("k", rules.valid_coord(F.col("lat") * 10, F.col("lon") * 2.15).alias("ok"))


BOXES = """SELECT k, lat * (1 + CAST(k % 13 = 3 AS INT) * 9) AS min_lat, lon AS min_lon,
   lat + 0.00300 * (k % 11) AS max_lat, lon + 0.0045 * (k % 7) AS max_lon FROM {node}"""


@query(
    "bbox_problems",
    f"""SELECT k, CASE WHEN NOT (min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90) THEN 'out_of_range'
       WHEN NOT (min_lat < max_lat AND min_lon < max_lon) THEN 'empty'
       WHEN {o.hav('min_lat','min_lon','min_lat','max_lon')} * {o.hav('min_lat','min_lon','max_lat','min_lon')} > 2000000 THEN 'too_large' END AS problem
       FROM ({BOXES.format(node='node_v')}) b""",
    ["node"],
)
def bbox_problems(v: Views):
    boxes = v.spark.sql(BOXES, node=v.node)
    return boxes.select("k", rules.bbox_problem("min_lat", "min_lon", "max_lat", "max_lon", limit=2_000_000.0).alias("problem"))


@query(
    "boundary_problems",
    "SELECT boundary_id, CASE name WHEN '  ' THEN 'blank_name' WHEN 'few' THEN 'too_few_vertices' WHEN 'open' THEN 'not_closed' WHEN 'twice' THEN 'degenerate' "
    "WHEN 'tie' THEN 'self_intersecting' WHEN 'out' THEN 'outside_import_area' END AS rule FROM boundary_v",
    ["boundary"],
)
def boundary_problems(v: Views):
    j = v.boundary.join(v.area.select("area_id", "min_lat", "min_lon", "max_lat", "max_lon"), "area_id")
    box = {k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    return j.select("boundary_id", rules.boundary_problem("name", "ring", box).alias("rule"))


BLOCKLIKE = "SELECT k, k % 7 = 0 AS is_clipped, k % 5 = 0 AS is_median, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 60 AS DOUBLE) END AS buildable_m2 FROM {node}"


@query(
    "block_eligibility",
    f"""SELECT k, CASE WHEN is_clipped THEN 'clipped' WHEN is_median THEN 'median' WHEN coalesce(buildable_m2, 0) < 30 THEN 'no_buildable_area' ELSE 'eligible' END AS eligibility
        FROM ({BLOCKLIKE.format(node='node_v')}) b""",
    ["node"],
)
def block_eligibility(v: Views):
    return v.spark.sql(BLOCKLIKE, node=v.node).select("k", rules.eligibility("is_clipped", "is_median", "buildable_m2").alias("eligibility"))


FEEDBACK = "SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 9 - 1 AS INT) END AS building_count, k % 4 = 0 AS no_buildings FROM {node}"


@query(
    "feedback_checks",
    f"""SELECT k, CASE WHEN (building_count IS NULL) = (NOT no_buildings) THEN 'exactly_one' WHEN building_count < 0 THEN 'negative_count' END AS problem,
        CASE WHEN no_buildings THEN 0 ELSE coalesce(building_count, 0) END AS target FROM ({FEEDBACK.format(node='node_v')}) f""",
    ["node"],
)
def feedback_checks(v: Views):
    f = v.spark.sql(FEEDBACK, node=v.node)
    return f.select("k", rules.feedback_problem("building_count", "no_buildings").alias("problem"), rules.feedback_target("building_count", "no_buildings").alias("target"))


@query(
    "constraint_violations",
    f"""SELECT k, 'exactly_one' AS violation FROM ({FEEDBACK.format(node='node_v')}) f WHERE (building_count IS NULL) <> no_buildings
        UNION ALL SELECT k, 'count_not_negative' FROM ({FEEDBACK.format(node='node_v')}) f WHERE building_count < 0""",
    ["node"],
)
def constraint_violations(v: Views):
    return rules.check_constraints(v.spark.sql(FEEDBACK, node=v.node), "feedback").select("k", "violation")


IMPUTE = (
    "CASE WHEN h IS NOT NULL THEN h WHEN n IS NOT NULL THEN n * 3.0::DOUBLE "
    "WHEN t IN ('yes','house','detached','semidetached_house','terrace','bungalow','hut','cabin','residential') THEN d * 3.0::DOUBLE "
    "WHEN t = 'apartments' THEN 15 WHEN t IN ('garage','garages','shed','carport') THEN 3 WHEN t IN ('church','cathedral') THEN 20 "
    "WHEN t IN ('commercial','retail') THEN 12 WHEN t IN ('industrial','warehouse') THEN 10 WHEN c IN ('residential','unspecified') THEN d * 3.0::DOUBLE "
    "WHEN c = 'commercial' THEN 12 WHEN c = 'industrial' THEN 10 WHEN c = 'civic' THEN 12 ELSE 6 END"
)


@query(
    "imputed_heights",
    f"""SELECT k, {o.rn(IMPUTE, 4)} AS height, h IS NULL AND n IS NULL AS defaulted
        FROM (SELECT k, CASE WHEN k % 3 = 0 THEN {HEIGHT('height')} END AS h, CASE WHEN k % 5 = 0 THEN {LEVELS('building_levels')} END AS n,
              nullif(lower(trim(building)), '') AS t, {CATEGORY.format(b='building')} AS c, 1 + k % 2 AS d FROM tagset_v) x""",
    ["tagset"],
)
def imputed_heights(v: Views):
    t = lambda k: tags.tag("tags", k)
    h = tags.imputed_height(
        F.when(F.col("k") % 3 == 0, tags.height_meters(t("height"))), F.when(F.col("k") % 5 == 0, tags.levels(t("building:levels"))),
        tags.building_type(t("building")), tags.building_category(t("building")), 1 + F.col("k") % 2,
    )
    return tagged(v).select("k", F.round(h["height"], 4).alias("height"), h["defaulted"].alias("defaulted"))
