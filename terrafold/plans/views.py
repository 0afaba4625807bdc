"""Spatial views over the star-schema tables, one definition for Spark and for the check engine.

The tables carry no coordinates, so every view computes them from dense integer keys. A view is a
SELECT whose text is the same in both engines except for the point and list constructors.

* ``area``: five large boxes (one per region) with a nested box per nation.
* ``poi``: customers scattered over the regions' boxes.
* ``node``, ``way``: a town per 100 customers, each a 10 x 10 street lattice, so work grows with customers.
* ``building``: parts as square footprints inside the towns' blocks.
* ``cell``: orders as a height grid. ``interval``: line items as intervals per order. ``ping``: events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.session import spread_width

#: Tables whose rows views make shapes of.
SPREAD = {"customer", "part", "orders"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def point(self, x: str, y: str) -> str:
        return f"named_struct('x', {x}, 'y', {y})" if self.spark else f"{{'x': {x}, 'y': {y}}}"

    def list(self, *items: str) -> str:
        inner = ", ".join(items)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def square(self, x: str, y: str, hx: str, hy: str) -> str:
        """Closed counter-clockwise square from its south-west corner."""
        corner = lambda sx, sy: self.point(f"{x} {sx} {hx}", f"{y} {sy} {hy}")
        return self.list(corner("-", "-"), corner("+", "-"), corner("+", "+"), corner("-", "+"), corner("-", "-"))

    def pick(self, index: str, *values: str) -> str:
        """values[index] for a 0-based index."""
        whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
        return f"CASE {index} {whens} END"


def q(*texts: str | None) -> list[str]:
    literal = lambda t: f"concat('{t[:-1]}', chr(39))" if t.endswith("'") else f"'{t}'"
    return ["NULL" if t is None else literal(t) for t in texts]


TOWN = "CAST((k - k % 100) / 100 AS BIGINT)"
TOWN_LAT = f"({_d(10)} + {_d(0.02)} * (town % 1000))"
TOWN_LON = f"(-{_d(84)} + {_d(0.02)} * CAST((town - town % 1000) / 1000 AS BIGINT))"


def sql(name: str, d: Dialect) -> str:
    return globals()[f"_{name}"](d)


def _area(d: Dialect) -> str:
    lat = f"{_d(10)} + {_d(0.03)} * r"
    row = f"CAST((n - r) / 5 AS BIGINT)"
    return f"""
SELECT concat('R', r) AS area_id, CAST(NULL AS VARCHAR(10)) AS parent_id, 'osm' AS provider, 'completed' AS status,
       {lat} AS min_lat, -{_d(84)} AS min_lon, {lat} + {_d(0.027)} AS max_lat, -{_d(84)} + {_d(0.027)} AS max_lon,
       CAST(r AS INT) AS created_day, CAST(10 + r AS INT) AS imported_day, place AS place_name, r AS root
FROM (SELECT CAST(r_regionkey AS BIGINT) AS r, r_name AS place FROM region) base
UNION ALL
SELECT concat('N', n), concat('R', r), 'osm', {d.pick('n % 7', "'completed'", "'completed'", "'completed'", "'failed'", "'completed'", "'importing'", "'completed'")},
       {lat} + {_d(0.004)} + {_d(0.004)} * {row}, -{_d(84)} + {_d(0.004)},
       {lat} + {_d(0.004)} + {_d(0.004)} * {row} + {_d(0.004)}, -{_d(84)} + {_d(0.014)},
       CAST(n * 11 % 30 AS INT), CASE WHEN n % 7 IN (3, 5) THEN NULL ELSE CAST(5 + n * 7 % 30 AS INT) END,
       CASE WHEN n % 4 = 0 THEN NULL ELSE place END, r
FROM (SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_nationkey % 5 AS BIGINT) AS r, n_name AS place FROM nation) base
"""


def _poi(d: Dialect) -> str:
    return f"""
SELECT concat('node/', k) AS source_id, k, concat('R', r) AS area_id, lower(seg) AS kind,
       {_d(10)} + {_d(0.03)} * r + ((37 * k) % 1000) * {_d(0.000027)} AS lat,
       -{_d(84)} + ((91 * k) % 1000) * {_d(0.000027)} AS lon
FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey % 5 AS BIGINT) AS r, c_mktsegment AS seg FROM customer) base
"""


def _town(d: Dialect) -> str:
    return f"""
SELECT concat('T', town) AS area_id, town, {TOWN_LAT} - {_d(0.0005)} AS min_lat, {TOWN_LON} - {_d(0.0005)} AS min_lon,
       {TOWN_LAT} + {_d(0.0085)} AS max_lat, {TOWN_LON} + {_d(0.0085)} AS max_lon
FROM (SELECT DISTINCT {TOWN} AS town FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) b0) base
"""


def _node(d: Dialect) -> str:
    return f"""
SELECT concat('n', k) AS node_id, k, town, concat('T', town) AS area_id, lrow, lcol,
       {TOWN_LAT} + {_d(0.001)} * lrow + {_d(0.00001)} * ((k * 7) % 10) AS lat,
       {TOWN_LON} + {_d(0.001)} * lcol + {_d(0.00001)} * ((k * 3) % 10) AS lon
FROM (SELECT k, {TOWN} AS town, CAST((k % 100 - k % 10) / 10 AS BIGINT) AS lrow, k % 10 AS lcol
      FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) b0) base
"""


def _way(d: Dialect) -> str:
    """One row per way vertex: lattice rows ('h') and columns ('v') of each town."""
    highway = q("residential", "tertiary", "primary_link", "living_street", "service", "secondary", "unclassified", "footway", "trunk", "motorway")
    oneway = q(None, "no", "yes", " YES ", "-1", "reversible", None)
    lanes = q("2", None, "3", "x", "4", None, "1")
    fwd = q(None, None, "2", None, None)
    return f"""
SELECT way_id, area_id, town, axis, line, pos, node_id, lat, lon,
       {d.pick('(line * 3 + town + axis) % 10', *highway)} AS highway,
       {d.pick('(line * 5 + axis) % 7', *oneway)} AS oneway,
       CASE WHEN (line + town) % 9 = 8 THEN 'roundabout' END AS junction,
       {d.pick('(line + town) % 7', *lanes)} AS lanes,
       {d.pick('(line + axis) % 5', *fwd)} AS lanes_forward,
       CASE WHEN axis = 1 AND line % 4 = 3 THEN NULL WHEN line % 2 = 0 THEN concat(' Main  Street ', CAST((line - line % 4) / 4 AS BIGINT))
            ELSE concat('MAIN street ', CAST((line - line % 4) / 4 AS BIGINT)) END AS name
FROM (SELECT concat('h', town, '_', lrow) AS way_id, area_id, town, 0 AS axis, lrow AS line, lcol AS pos, node_id, lat, lon FROM node_v
      UNION ALL
      SELECT concat('v', town, '_', lcol), area_id, town, 1, lcol, lrow, node_id, lat, lon FROM node_v) base
"""


def _building(d: Dialect) -> str:
    kind = q("yes", "house", "Apartments ", "retail", "warehouse", "school", "garage", "castle", "church", "detached")
    height = q("12", "12.5 m", "12,5", "40 ft", "abc", None)
    level = q("2", "3.0", "2.5", "-1", None, "1", "2")
    ring = d.square("lon", "lat", "hx", "hy")
    return f"""
SELECT concat('way/', k) AS source_id, k, town, concat('T', town) AS area_id, lat, lon, hy,
       hx, building, height, building_levels, {ring} AS ring
FROM (
  SELECT k, town, {d.pick('k % 10', *kind)} AS building, {d.pick('k % 6', *height)} AS height, {d.pick('k % 7', *level)} AS building_levels,
         {TOWN_LAT} + {_d(0.001)} * (CAST((k % 100 - k % 10) / 10 AS BIGINT)) + {_d(0.0003)} + {_d(0.00004)} * (k % 11) AS lat,
         {TOWN_LON} + {_d(0.001)} * (k % 10) + {_d(0.0003)} + {_d(0.00004)} * (k % 9) AS lon,
         {_d(0.00003)} + {_d(0.00001)} * (sz % 7) AS hy, {_d(0.00003)} + {_d(0.00001)} * (sz % 5) AS hx
  FROM (SELECT k, sz, {TOWN} AS town FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS sz FROM part) b0) b1
) base
"""


def _cell(d: Dialect) -> str:
    """A height grid per 2,500 orders: 50 x 50 samples, with pits."""
    return f"""
SELECT area_id, grow AS row, gcol AS col, 50 AS rows, 50 AS cols,
       {_d(10)} + {_d(0.02)} * g AS origin_lat, -{_d(84)} AS origin_lon, {_d(0.0002)} AS lat_step, {_d(0.0002)} AS lon_step,
       {_d(100)} + {_d(0.05)} * grow + {_d(0.02)} * gcol + {_d(0.5)} * ((grow * 13 + gcol * 7) % 11)
       - CASE WHEN k % 97 = 0 THEN {_d(300)} ELSE {_d(0)} END AS height
FROM (SELECT k, g, concat('G', g) AS area_id, CAST((k % 2500 - k % 50) / 50 AS BIGINT) AS grow, k % 50 AS gcol
      FROM (SELECT k, CAST((k - k % 2500) / 2500 AS BIGINT) AS g FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) b0) b1) base
"""


def _ping(d: Dialect) -> str:
    return f"""
SELECT event_id AS k, concat('R', user_id % 5) AS area_id,
       {_d(10)} + {_d(0.03)} * (user_id % 5) + ((37 * event_id) % 1000) * {_d(0.000027)} + {_d(0.0000131)} AS lat,
       -{_d(84)} + ((91 * event_id + user_id) % 1000) * {_d(0.000027)} + {_d(0.0000077)} AS lon
FROM (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id FROM events) base
"""


def _boundary(d: Dialect) -> str:
    """Per region: an L-shaped ring, a bow-tie and a ring that leaves the box."""
    lat, lon = f"({_d(10)} + {_d(0.03)} * r)", f"(-{_d(84)})"
    p = lambda x, y: d.point(f"{lon} + {_d(x)}", f"{lat} + {_d(y)}")
    ell = d.list(p(0.003, 0.003), p(0.021, 0.003), p(0.021, 0.012), p(0.012, 0.012), p(0.012, 0.021), p(0.003, 0.021), p(0.003, 0.003))
    tie = d.list(p(0.003, 0.003), p(0.012, 0.012), p(0.012, 0.003), p(0.003, 0.012), p(0.003, 0.003))
    out = d.list(p(0.003, 0.003), p(0.05, 0.003), p(0.012, 0.012), p(0.003, 0.003))
    few = d.list(p(0.003, 0.003), p(0.012, 0.003), p(0.003, 0.003))
    opened = d.list(p(0.003, 0.003), p(0.012, 0.003), p(0.012, 0.012), p(0.003, 0.012))
    twice = d.list(p(0.003, 0.003), p(0.012, 0.003), p(0.012, 0.003), p(0.003, 0.012), p(0.003, 0.003))
    rows = [("'ell'", ell), ("'tie'", tie), ("'out'", out), ("'few'", few), ("'open'", opened), ("'twice'", twice), ("'  '", ell)]
    return " UNION ALL ".join(
        f"SELECT concat('B', r, '_{i}') AS boundary_id, concat('R', r) AS area_id, {name} AS name, {ring} AS ring "
        f"FROM (SELECT CAST(r_regionkey AS BIGINT) AS r FROM region) b{i}"
        for i, (name, ring) in enumerate(rows)
    )


def _tagset(d: Dialect) -> str:
    """One set of raw tag texts per order, cycling through good, odd and broken values."""
    pick = lambda expr, *v: d.pick(f"({expr}) % {len(v)}", *q(*v))
    return f"""
SELECT k,
  {pick('k', 'residential', 'motorway_link', 'living_street', 'footway', 'service', 'trunk', 'tertiary_link', None, 'unclassified', 'primary', 'service_link')} AS highway,
  {pick('k * 3', 'yes', 'no', None, ' YES ', '-1', 'reversible', 'sideways', '1', 'alternating', 'False', '')} AS oneway,
  {pick('k', 'roundabout', None, None, 'yes')} AS junction,
  {pick('k', '2', '3', None, 'x', '0', '1', '5', ' 4 ')} AS lanes,
  {pick('k * 5', None, '2', None, '1', '9', None, 'two', None, '')} AS lanes_forward,
  {pick('k * 7', None, None, '1', None, '3', None, '-2', None, None, None)} AS lanes_backward,
  {pick('k', '12', '12.5 m', '12,5', '40 ft', 'abc', None, "40'", '30feet', '0', '-3', '7m', '1e3', ' 8 M ')} AS height,
  {pick('k', '2', '3.0', '2.5', '-1', None, '0', ' 4 ', 'NaN', 'many', '1e1')} AS building_levels,
  {pick('k', 'yes', 'house', 'Retail', 'retail', 'warehouse', 'school', ' Garage ', None, '', 'apartments', 'cathedral')} AS building,
  {pick('k * 11', None, 'restaurant', None, 'clinic', 'school', 'fuel', 'grave_yard', '', None)} AS amenity,
  {pick('k * 13', None, None, 'bakery', None, 'pharmacy')} AS shop,
  {pick('k', None, 'park', None, None, None, 'pitch')} AS leisure,
  {pick('k', None, 'water', 'wood', None, None, None, None)} AS nat,
  {pick('k', None, 'grass', 'forest', 'orchard', 'cemetery', 'railway', 'industrial', 'retail', None)} AS landuse,
  {pick('k', 'no_left_turn', None, 'only_straight_on', None, 'no_entry', None, 'no_u_turn')} AS restriction,
  {pick('k', None, None, 'no_right_turn', None, None)} AS restriction_motorcar,
  {pick('k', None, 'no_left_turn', None)} AS restriction_bus
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) base
"""


def _interval(d: Dialect) -> str:
    return f"""
SELECT group_id, line, start_m, start_m + CAST(qty % 9 AS DOUBLE) AS end_m, qty, price
FROM (SELECT CAST(l_orderkey AS BIGINT) AS group_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_linenumber * 5 AS DOUBLE) AS start_m,
             CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem) base
"""


def _restriction(d: Dialect) -> str:
    """Turn restrictions at lattice crossings: from a row into a column, and at some also the other way round."""
    kind = d.pick("CAST((k - k % 7) / 7 AS BIGINT) % 8", *q(
        "no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn", "only_left_turn", "only_right_turn", "only_straight_on", "no_entry"))
    row, column = "concat('h', town, '_', lrow)", "concat('v', town, '_', lcol)"
    return f"""
SELECT concat('r', k) AS source_id, area_id, k AS ord, {row} AS from_way, node_id AS via_node, {column} AS to_way, {kind} AS kind FROM node_v WHERE k % 7 = 0
UNION ALL
SELECT concat('q', k), area_id, k + 1000000000, {column}, node_id, {row}, {kind} FROM node_v WHERE k % 14 = 0 OR lrow = 0 AND k % 3 = 1
"""


def _plot(d: Dialect) -> str:
    """A rectangular buildable area per customer in local metres, with the block attributes analytics compare."""
    ring = d.list(*(d.point(x, y) for x, y in (("0 * w", "0 * h"), ("w", "0 * h"), ("w", "h"), ("0 * w", "h"), ("0 * w", "0 * h"))))
    group = d.pick("k % 3", *q("local", "collector", "arterial"))
    style = d.pick("CAST((k - k % 4) / 4 AS BIGINT) % 3", *q("regular", "sparse", "informal"))
    return f"""
SELECT concat('P', k) AS block_id, k, concat('R', r) AS area_id, w, h, {ring} AS ring, w * h AS area_m2, {group} AS road_group, {style} AS style,
       k % 11 = 0 AS is_clipped, k % 13 = 0 AS is_median, lat, lon
FROM (SELECT k, r, CAST(60 + 10 * (k % 5) AS DOUBLE) AS w, CAST(40 + 10 * (k % 4) AS DOUBLE) AS h,
             {_d(10)} + {_d(0.03)} * r + ((37 * k) % 1000) * {_d(0.000027)} AS lat, -{_d(84)} + ((91 * k) % 1000) * {_d(0.000027)} AS lon
      FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey % 5 AS BIGINT) AS r FROM customer) b0) base
"""


def _house(d: Dialect) -> str:
    """A house per order on its customer's plot, in one of six slots at the bottom or the top side."""
    ring = d.list(*(d.point(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    return f"""
SELECT concat('H', lpad(CAST(j AS {'STRING' if d.spark else 'VARCHAR'}), 9, '0')) AS building_id, concat('P', k) AS block_id, j, k, x0, y0, x1, y1, levels, {ring} AS ring
FROM (SELECT j, k, CAST(3 + 9 * (j % 6) AS DOUBLE) AS x0, CAST(3 + 9 * (j % 6) + 6 + j % 3 AS DOUBLE) AS x1,
        CAST(CASE WHEN j % 12 < 6 THEN 2 + j % 3 ELSE 40 + 10 * (k % 4) - 11 - j % 2 END AS DOUBLE) AS y0,
        CAST(CASE WHEN j % 12 < 6 THEN 9 + j % 3 + j % 2 ELSE 40 + 10 * (k % 4) - 4 END AS DOUBLE) AS y1,
        CASE WHEN j % 4 = 0 THEN NULL ELSE CAST(1 + j % 3 AS INT) END AS levels
      FROM (SELECT CAST(o_orderkey AS BIGINT) AS j, CAST(o_custkey AS BIGINT) AS k FROM orders) b0) base
"""


DEPENDS = {"way": ["node"], "restriction": ["node"]}
VIEW_NAMES = ["area", "poi", "town", "node", "way", "building", "cell", "ping", "boundary", "interval", "tagset", "restriction", "plot", "house"]


def with_views(body: str, *names: str) -> str:
    """Check-engine text: the named views as common table expressions ``<name>_v`` in front of ``body``."""
    d, order = Dialect(spark=False), []
    for n in names:
        for m in [*DEPENDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = ", ".join(f"{n}_v AS ({sql(n, d)})" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {rest[9:] if recursive else rest}"
    return f"WITH {ctes} {body}"


class Views:
    """The same views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # A row becomes many (samples, lattice edges, rings), so rows are dealt out first: a small file alone would be one task.
        return df.repartition(spread_width(self.spark)) if name in SPREAD else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEW_NAMES:
            raise AttributeError(name)
        text = sql(name, Dialect(spark=True))
        frames = {}
        for m in DEPENDS.get(name, []):
            text = text.replace(f"{m}_v", f"{{{m}_v}}")
            frames[f"{m}_v"] = getattr(self, m)
        for t in TABLES:
            if f"FROM {t})" in text or f"FROM {t} " in text or f" {t})" in text:
                text = text.replace(f"FROM {t})", f"FROM {{{t}}})")
                frames[t] = self.table(t)
        return self.spark.sql(text, **frames)
