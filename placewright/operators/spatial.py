"""Spatial joins as equi-joins on geohash cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import geo
from ..functions import geohash_cells, haversine, scalar


def nearest(points: DataFrame, sites: DataFrame, n: int = 1, precision: int = 5) -> DataFrame:
    """(id, site, km, rank): the n nearest sites in a point's cell and the eight around it.

    ``points``: (id, lat, lon); ``sites``: (site, lat, lon). Sites stay in one cell each; points are
    sent to nine. Points at one spot have the same sites, which are looked for once; of sites at one spot only
    the first n can be among the nearest n.
    """
    def ranked(df: DataFrame, by: list[str], *order: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    first = ranked(sites.select("site", F.col("lat").alias("slat"), F.col("lon").alias("slon")), ["slat", "slon"], "site").drop("rank")
    home = first.withColumn("cell", F.element_at(geohash_cells("slat", "slon", precision), 1))
    ask = points.select("lat", "lon").distinct().select("lat", "lon", F.explode(geohash_cells("lat", "lon", precision)).alias("cell"))
    km = ask.join(home, "cell").select("lat", "lon", "site", haversine("lat", "lon", "slat", "slon").alias("km"))
    return points.select("id", "lat", "lon").join(ranked(km, ["lat", "lon"], "km", "site"), ["lat", "lon"]).select("id", "site", "km", "rank")


def point_in_polygon(points: DataFrame, polygons: DataFrame, precision: int = 4, first: bool = False) -> DataFrame:
    """(id, poly, level): polygons that hold a point, by admin level; ``first`` keeps the finest.

    ``polygons``: (poly, level, rings), a ring being an array of (lon, lat). Each polygon covers the
    cells of its bounding box; the exact test runs on the candidates only.
    """
    to_rings = lambda rings: [[(p["lon"], p["lat"]) for p in r] for r in rings]
    cells = scalar(lambda rings: sorted({c for r in to_rings(rings) for c in geo.cover(r, precision)}), "array<string>", "rings")
    cover = polygons.select("poly", "level", "rings", F.explode(cells).alias("cell"))
    at = points.select("id", "lat", "lon", F.element_at(geohash_cells("lat", "lon", precision), 1).alias("cell"))
    inside = scalar(lambda rings, lon, lat: geo.contains(to_rings(rings), lon, lat), "boolean", "rings", "lon", "lat")
    hits = at.join(cover, "cell").where(inside).select("id", "poly", "level")
    if not first:
        return hits
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("level"), "poly"))
    return hits.withColumn("rank", rank).where("rank = 1").drop("rank")


def cell_lookup(points: DataFrame, cells: DataFrame, precisions: list[int]) -> DataFrame:
    """(id, value): the value of the finest stored cell that holds a point; ``points`` (id, cell),
    ``cells`` (cell, value) of mixed precision."""
    parts = F.array(*[F.left("cell", F.lit(k)) for k in sorted(precisions, reverse=True)])
    ask = points.select("id", F.explode(F.array_distinct(parts)).alias("cell"))
    return ask.join(cells, "cell").groupBy("id").agg(F.max_by("value", F.length("cell")).alias("value"))
