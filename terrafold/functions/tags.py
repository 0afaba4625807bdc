"""Source tags to typed attributes. Every rule is a column expression over ``map<string,string>``.

Rules that reject a value return ``raise_error``-free columns: the value column is NULL and the matching
``*_problem`` expression names the reason, so one bad way never fails a whole batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies the results must agree on.
ROAD_CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service"]
LINKED_CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary"]
ONEWAY_BOTH = ["", "no", "0", "false", "reversible", "alternating"]
ONEWAY_FORWARD = ["yes", "1", "true"]
RESTRICTIONS = [
    "no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn",
    "only_left_turn", "only_right_turn", "only_straight_on",
]
CAR_RESTRICTION_KEYS = ["restriction:motorcar", "restriction:motor_vehicle", "restriction:vehicle"]
METERS_PER_FOOT = 0.3048
LANE_WIDTHS = {"narrow": 2.75, "normal": 3.25, "wide": 3.65}
LANE_TYPES = {
    "service": "narrow", "residential": "normal", "unclassified": "normal", "tertiary": "normal",
    "secondary": "wide", "primary": "wide", "trunk": "wide", "motorway": "wide",
}
BUILDING_CATEGORIES = {
    "commercial": ["commercial", "retail"],
    "industrial": ["industrial", "warehouse"],
    "civic": ["civic", "school", "church", "hospital"],
    "residential": ["yes", "house", "apartments", "residential"],
}
POI_CATEGORIES = {
    "food_and_drink": ["restaurant", "cafe", "bar"],
    "health": ["hospital", "clinic", "pharmacy"],
    "education": ["school", "college", "kindergarten"],
    "transit": ["bus_station", "parking", "fuel"],
}
GREEN_LANDUSE = ["grass", "recreation_ground"]
FARM_LANDUSE = ["farmland", "meadow", "orchard", "vineyard", "farmyard"]
PLACE_NAME_KEYS = [
    "neighbourhood", "quarter", "suburb", "city_district", "borough", "village", "town", "city", "municipality", "county",
]
PLACE_CONTEXT_KEYS = ["city", "town", "village", "municipality", "county", "state"]
LOW_RISE_TYPES = ["yes", "house", "detached", "semidetached_house", "terrace", "bungalow", "hut", "cabin", "residential"]
HEIGHT_BY_TYPE = {
    "apartments": 15.0, "garage": 3.0, "garages": 3.0, "shed": 3.0, "carport": 3.0, "church": 20.0, "cathedral": 20.0,
    "commercial": 12.0, "retail": 12.0, "industrial": 10.0, "warehouse": 10.0,
}
HEIGHT_BY_CATEGORY = {"commercial": 12.0, "industrial": 10.0, "civic": 12.0}
FALLBACK_HEIGHT = 6.0
METERS_PER_LEVEL = 3.0
POINT_HALF_SPAN_DEGREES = 0.005


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag(tags, key: str) -> Column:
    """The value of one tag, NULL when absent."""
    return F.try_element_at(_c(tags), F.lit(key))


def lookup(value: Column, table: dict) -> Column:
    """A small fixed table as a literal map, NULL for unlisted values."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def _by_group(value: Column, groups: dict[str, list[str]]) -> Column:
    out = None
    for name, members in groups.items():
        out = F.when(value.isin(members), name) if out is None else out.when(value.isin(members), name)
    return out


def road_class(highway) -> Column:
    """One of eight classes; a link takes its parent's class, other highways are not roads (NULL)."""
    table = {c: c for c in ROAD_CLASSES} | {f"{c}_link": c for c in LINKED_CLASSES} | {"living_street": "residential"}
    return lookup(_c(highway), table)


def oneway_effective(tags) -> Column:
    """A roundabout implies one-way in the drawn direction unless the way says otherwise."""
    return F.coalesce(tag(tags, "oneway"), F.when(tag(tags, "junction") == "roundabout", F.lit("yes")))


def oneway_dir(value) -> Column:
    """-1, 0 or 1; NULL for an unsupported value (see ``oneway_problem``)."""
    v = F.lower(F.trim(F.coalesce(_c(value), F.lit(""))))
    return F.when(v.isin(ONEWAY_BOTH), 0).when(v.isin(ONEWAY_FORWARD), 1).when(v == "-1", -1)


def oneway_problem(value) -> Column:
    return F.when(oneway_dir(value).isNull(), F.lit("unsupported oneway value"))


def lane_count(value) -> Column:
    """A whole number of lanes, or NULL when it is not one. Below 1 is NULL here and a lane problem."""
    n = _whole(value)
    return F.when(n >= 1, n)


def lane_problem(value) -> Column:
    return F.when(_whole(value) < 1, F.lit("invalid lane count"))


def _whole(value) -> Column:
    text = F.trim(_c(value))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def split_lanes(tags, oneway: Column) -> Column:
    """``struct<forward, backward>`` from the total and per-direction lane tags."""
    both, fwd, bwd = (tag(tags, k) for k in ("lanes", "lanes:forward", "lanes:backward"))
    present = lambda v: F.when(v != "", v)  # noqa: E731  an empty text counts as absent on a one-way
    one_f = lane_count(F.coalesce(present(fwd), both))
    one_b = lane_count(F.coalesce(present(bwd), both))
    total, f, b = lane_count(both), lane_count(fwd), lane_count(bwd)
    rest = lambda side: F.when(total - side >= 1, total - side)
    half = F.floor(total / 2).cast("int")
    two_f = F.when(f.isNotNull(), f).when(b.isNotNull(), rest(b)).otherwise(total - half)
    two_b = F.when(b.isNotNull(), b).when(f.isNotNull(), rest(f)).otherwise(F.when(half >= 1, half))
    return F.struct(
        F.when(oneway != 0, one_f).otherwise(two_f).cast("int").alias("forward"),
        F.when(oneway != 0, one_b).otherwise(two_b).cast("int").alias("backward"),
    )


def height_meters(value) -> Column:
    """Metres from a height text, feet converted; NULL unless the whole text is a positive number."""
    text = F.replace(F.lower(F.trim(_c(value))), F.lit(","), F.lit("."))
    metric = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*m?$", 1)
    feet = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*(?:'|ft|feet)$", 1)
    h = F.when(metric != "", metric.try_cast("double")).when(feet != "", feet.try_cast("double") * METERS_PER_FOOT)
    return F.when((h > 0) & (h < float("inf")), h)


def levels(value) -> Column:
    """A whole, finite, non-negative number of storeys, else NULL."""
    x = F.trim(_c(value)).try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < 2147483648.0) & (x == F.floor(x))
    return F.when(ok, x.try_cast("int"))


def building_category(value) -> Column:
    return F.coalesce(_by_group(_c(value), BUILDING_CATEGORIES), F.when(_c(value).isNotNull(), F.lit("unspecified")))


def building_type(value) -> Column:
    return F.nullif(F.lower(F.trim(_c(value))), F.lit(""))


def poi_category(tags) -> Column:
    """From ``amenity``, else ``shop``; NULL when the element has neither."""
    amenity, shop = tag(tags, "amenity"), tag(tags, "shop")
    value = F.coalesce(F.nullif(amenity, F.lit("")), shop)
    return F.when(
        amenity.isNotNull() | shop.isNotNull(),
        F.coalesce(_by_group(value, POI_CATEGORIES), F.when(shop.isNotNull(), F.lit("shopping")), F.lit("other")),
    )


def area_kind(tags) -> Column:
    """First matching rule wins, in this order."""
    leisure, natural, landuse, amenity = (tag(tags, k) for k in ("leisure", "natural", "landuse", "amenity"))
    return (
        F.when(leisure == "park", "park")
        .when(natural == "water", "water")
        .when(landuse.isin(GREEN_LANDUSE), "green_space")
        .when((landuse == "forest") | (natural == "wood"), "forest")
        .when(landuse.isin(FARM_LANDUSE), "farmland")
        .when((landuse == "cemetery") | (amenity == "grave_yard"), "cemetery")
        .when(landuse == "railway", "railway")
        .when(landuse == "industrial", "industrial")
    )


def restriction_kind(tags) -> Column:
    """``struct<kind, outcome>``: outcome is ``car``, ``other_vehicle`` (ignored) or ``malformed`` (skipped)."""
    tags = _c(tags)
    value = F.coalesce(tag(tags, "restriction"), *(tag(tags, k) for k in CAR_RESTRICTION_KEYS))
    scoped = F.exists(F.map_keys(tags), lambda k: k.startswith("restriction:"))
    kind = F.when(value.isin(RESTRICTIONS), value)
    outcome = F.when(kind.isNotNull(), "car").when(value.isNull() & scoped, "other_vehicle").otherwise("malformed")
    return F.struct(kind.alias("kind"), outcome.alias("outcome"))


def restriction_members(members) -> Column:
    """``struct<from_way, via_node, to_way>``: the last member of each role and type."""

    def last(role, kind):
        hits = F.filter(_c(members), lambda m: (m["role"] == role) & (m["type"] == kind) & m["ref"].isNotNull())
        return F.try_element_at(hits, F.lit(-1))["ref"]

    return F.struct(
        last("from", "way").alias("from_way"), last("via", "node").alias("via_node"), last("to", "way").alias("to_way")
    )


def norm_name(name) -> Column:
    """Whitespace collapsed, lower case, blank is NULL."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(_c(name), r"\s+", " "))), F.lit(""))


def lane_type(road_class_value) -> Column:
    return lookup(_c(road_class_value), LANE_TYPES)


def lane_width(road_class_value) -> Column:
    return lookup(lane_type(road_class_value), LANE_WIDTHS)


def place_from_address(address) -> Column:
    """``struct<name, context>`` from an address map."""
    present = lambda k: F.nullif(F.trim(tag(address, k)), F.lit(""))
    name = F.coalesce(*(present(k) for k in PLACE_NAME_KEYS))
    around = F.coalesce(*(F.when(~present(k).eqNullSafe(name), present(k)) for k in PLACE_CONTEXT_KEYS))
    country = F.when(~present("country").eqNullSafe(name), present("country"))
    return F.struct(name.alias("name"), F.nullif(F.concat_ws(", ", around, country), F.lit("")).alias("context"))


def normalize_places(df):
    """Geocoder result rows (``lat``, ``lon``, ``boundingbox``, ``display_name``, ``name``, ``category``, ``class``,
    ``type`` as text) to typed places; unusable rows are dropped."""
    num = lambda c: c.try_cast("double")
    box = F.col("boundingbox")
    has_box = F.coalesce(F.size(box) == 4, F.lit(False))
    lat, lon = num(F.col("lat")), num(F.col("lon"))
    edge = lambda i, center, sign: F.when(has_box, num(F.try_element_at(box, F.lit(i)))).otherwise(
        center + sign * POINT_HALF_SPAN_DEGREES
    )
    display = F.coalesce(F.col("display_name"), F.lit(""))
    out = df.select(
        *[c for c in df.columns if c not in {"lat", "lon", "boundingbox", "display_name", "name", "category", "class", "type"}],
        display.alias("display_name"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.trim(F.split(display, ",")[0])).alias("name"),
        lat.alias("lat"), lon.alias("lon"),
        edge(1, lat, -1).alias("south"), edge(3, lon, -1).alias("west"),
        edge(2, lat, 1).alias("north"), edge(4, lon, 1).alias("east"),
        F.nullif(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("class")), F.lit("")).alias("category"),
        F.nullif(F.col("type"), F.lit("")).alias("type"),
    )
    return out.filter(
        (F.col("display_name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("south").isNotNull()
        & F.col("west").isNotNull() & F.col("north").isNotNull() & F.col("east").isNotNull()
    )


def bbox_from_corners(lat_a, lon_a, lat_b, lon_b) -> Column:
    a, b, c, d = _c(lat_a), _c(lon_a), _c(lat_b), _c(lon_b)
    return F.struct(
        F.least(a, c).alias("min_lat"), F.least(b, d).alias("min_lon"), F.greatest(a, c).alias("max_lat"), F.greatest(b, d).alias("max_lon")
    )


def round_bbox(box) -> Column:
    """Seven decimals (about a centimetre), so the same drawn box names the same area again."""
    box = _c(box)
    return F.struct(*(F.round(box[k], 7).alias(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")))


def same_bbox(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["min_lat"] == b["min_lat"]) & (a["min_lon"] == b["min_lon"]) & (a["max_lat"] == b["max_lat"]) & (a["max_lon"] == b["max_lon"])


def imputed_height(height, level_count, type_value, category, drawn_storeys) -> Column:
    """``struct<height, defaulted>``: stated height, stated levels, a low-rise draw, then fixed defaults."""
    h, n, t, c = _c(height), _c(level_count), _c(type_value), _c(category)
    drawn = _c(drawn_storeys) * METERS_PER_LEVEL
    by_type = lookup(t, HEIGHT_BY_TYPE)
    low = F.coalesce(t.isin(LOW_RISE_TYPES), F.lit(False))
    value = (
        F.when(h.isNotNull(), h)
        .when(n.isNotNull(), n * METERS_PER_LEVEL)
        .when(low, drawn)
        .when(by_type.isNotNull(), by_type)
        .when(c.isin("residential", "unspecified"), drawn)
        .otherwise(F.coalesce(lookup(c, HEIGHT_BY_CATEGORY), F.lit(FALLBACK_HEIGHT)))
    )
    return F.struct(value.cast("double").alias("height"), (h.isNull() & n.isNull()).alias("defaulted"))
