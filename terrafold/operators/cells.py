"""Cell buckets: the equi key behind every spatial join.

The earth is cut into latitude bands of equal height; each band is cut into cells whose longitude
step is widened by 1/cos(latitude), so a cell is about ``size_m`` on both sides everywhere. A point has exactly
one cell. A box or a disc is exploded into the cells it touches. Joins are then plain equi joins on
``(band, cell)``: Spark shuffles and, where one cell is hot, AQE splits that partition."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo


def _band_height(size_m: float) -> float:
    return size_m / geo.METERS_PER_DEGREE


def band_of(lat, size_m: float) -> Column:
    return F.floor(geo.col(lat) / _band_height(size_m))


def _lon_step(band: Column, size_m: float) -> Column:
    """Longitude width of the cells of one band: from its edge nearest the pole, at least 0.01 wide in cosine."""
    h = _band_height(size_m)
    edge = F.greatest(F.abs(band * h), F.abs((band + 1) * h))
    return h / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.01))


def point_cell(lat, lon, size_m: float) -> Column:
    band = band_of(lat, size_m)
    return F.struct(band.alias("band"), F.floor(geo.col(lon) / _lon_step(band, size_m)).alias("cell"))


def box_cells(min_lat, min_lon, max_lat, max_lon, size_m: float) -> Column:
    """Array of every cell a box touches."""
    bands = F.sequence(band_of(min_lat, size_m), band_of(max_lat, size_m))
    west, east = geo.col(min_lon), geo.col(max_lon)
    low, high = F.lit(-180.0), F.lit(180.0)

    def of_band(b):
        step = _lon_step(b, size_m)
        between = lambda a, z: F.sequence(F.floor(a / step), F.floor(z / step))
        none = F.array().cast("array<bigint>")
        # What reaches over the antimeridian goes on at the other side.
        over = F.when(east > high, between(low, F.least(east - 360.0, high))).otherwise(none)
        under = F.when(west < low, between(F.greatest(west + 360.0, low), high)).otherwise(none)
        cells = F.when((east > high) | (west < low), F.array_distinct(F.concat(between(F.greatest(west, low), F.least(east, high)), over, under))).otherwise(between(west, east))
        return F.transform(cells, lambda c: F.struct(b.alias("band"), c.alias("cell")))

    return F.flatten(F.transform(bands, of_band))


def disc_box(lat, lon, radius_m) -> dict[str, Column]:
    """The box around a disc, a hair wider than exact so rounding never loses a hit."""
    lat, lon = geo.col(lat), geo.col(lon)
    r = geo.col(radius_m) if not isinstance(radius_m, (int, float)) else F.lit(float(radius_m))
    dlat = r * (1.000001 / geo.METERS_PER_DEGREE)
    far = F.abs(lat) + dlat
    # A disc that reaches a pole spans all longitudes.
    dlon = F.when(far < 89.9, F.least(dlat / F.cos(F.radians(F.least(far, F.lit(89.9)))), F.lit(180.0))).otherwise(180.0)
    return {"min_lat": lat - dlat, "min_lon": lon - dlon, "max_lat": lat + dlat, "max_lon": lon + dlon}


def with_point_cell(df: DataFrame, lat, lon, size_m: float) -> DataFrame:
    c = point_cell(lat, lon, size_m)
    return df.withColumn("_band", c["band"]).withColumn("_cell", c["cell"])


def with_box_cells(df: DataFrame, box: dict | Column, size_m: float) -> DataFrame:
    """One row per touched cell, as ``_band`` and ``_cell``."""
    cells = box_cells(box["min_lat"], box["min_lon"], box["max_lat"], box["max_lon"], size_m)
    out = df.withColumn("_c", F.explode(cells))
    return out.withColumn("_band", F.col("_c.band")).withColumn("_cell", F.col("_c.cell")).drop("_c")


def meets_here(a: dict, b: dict, size_m: float) -> Column:
    """For two boxes met in cell ``(_band, _cell)``: true in exactly one of the cells they share, so a
    pair of extended shapes comes out once without a later distinct."""
    ref = point_cell(F.greatest(a["min_lat"], b["min_lat"]), F.greatest(a["min_lon"], b["min_lon"]), size_m)
    return (ref["band"] == F.col("_band")) & (ref["cell"] == F.col("_cell"))


def box_columns(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
