"""Regions of a map: statistics, splitting by area, fragments, matching, contact, edges and adjacency.

Tables are regions(map_id, y, x, lid). Set-based operators are joins and aggregates; order-dependent ones run per map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import InvalidParameterError
from ..sources.scratch import stored
from . import kernels as K
from .raster import AT, around, array_of, met, per_map


def room_stats(regions: DataFrame, resolution: float) -> DataFrame:
    """Pixels, area, mean place and bounding box of each region."""
    stats = regions.groupBy("map_id", "lid").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    return stats.withColumn("area", F.col("pixels") * (resolution * resolution))


def by_area(regions: DataFrame, least: int) -> DataFrame:
    """Regions with normal: at least so many pixels."""
    size = regions.groupBy("map_id", "lid").agg((F.count(F.lit(1)) >= least).alias("normal"))
    return met(regions, size, ["map_id", "lid"])


def relabelled(regions: DataFrame) -> DataFrame:
    """Labels 1..k of each map in ascending order."""
    ids = regions.select("map_id", "lid").distinct().withColumn("new", F.row_number().over(Window.partitionBy("map_id").orderBy("lid")))
    return met(regions, ids, ["map_id", "lid"]).select(*AT, F.col("new").alias("lid"))


def merged(regions: DataFrame, ids: list[int]) -> DataFrame:
    """The listed labels become the first of them; fewer than two are an error of code 4."""
    if len(ids) < 2:
        raise InvalidParameterError("two labels or more are merged")
    return regions.withColumn("lid", F.when(F.col("lid").isin(ids), F.lit(ids[0])).otherwise(F.col("lid")))


def picked(regions: DataFrame, points: DataFrame) -> DataFrame:
    """points (map_id, x1, y1, x2, y2) with the regions at both: keep, gone and code, which is 4 where a point lies on
    background or both lie in one region, else null."""
    at = lambda n, name: regions.select("map_id", F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("lid").alias(name))
    both = met(met(points, at(1, "keep"), ["map_id", "x1", "y1"], "left"), at(2, "gone"), ["map_id", "x2", "y2"], "left")
    wrong = F.col("keep").isNull() | F.col("gone").isNull() | (F.col("keep") == F.col("gone"))
    return both.select("map_id", "x1", "y1", "x2", "y2", "keep", "gone", F.when(wrong, InvalidParameterError.code).alias("code"))


def merged_at(regions: DataFrame, points: DataFrame) -> DataFrame:
    """points (map_id, x1, y1, x2, y2): the second point's region becomes the first's; a point on background or two in
    one region change nothing."""
    pairs = picked(regions, points).where("code IS NULL").select("map_id", "keep", "gone")
    return met(regions, pairs, "map_id", "left").select(*AT, F.when(F.col("lid") == F.col("gone"), F.col("keep")).otherwise(F.col("lid")).alias("lid"))


def new_space(pixels: DataFrame, regions: DataFrame, least: int = 128, strips: DataFrame | None = None) -> DataFrame:
    """Pixels of at least `least` that no region and no threshold strip holds."""
    out = met(pixels.where(F.col("v") >= least).select(*AT), regions.select(*AT), AT, "left_anti")
    return met(out, strips.select(*AT), AT, "left_anti") if strips is not None else out


def borders(regions: DataFrame) -> DataFrame:
    """Pixels with one of their eight neighbours outside their region, or the map."""
    near = met(around(regions.select(*AT, "lid")), regions.select(*AT, "lid"), [*AT, "lid"], "left_semi")
    inner = near.groupBy("map_id", F.col("y0").alias("y"), F.col("x0").alias("x"), "lid").agg(F.count(F.lit(1)).alias("n")).where("n = 8")
    return met(regions.select(*AT, "lid"), inner, [*AT, "lid"], "left_anti")


def fragment_targets(fragments: DataFrame, targets: DataFrame, tile: int = 16) -> DataFrame:
    """For each fragment the region with most pixels at its least square distance (ties to the smallest): map_id, lid,
    target. Only border pixels can lie at that distance, so only they are compared. Both sides are dealt to tiles and met in neighbouring tiles; what has met nothing closer than a tile's
    edge allows is tried again with tiles twice as wide."""
    fragments, targets = stored(borders(fragments)), stored(borders(targets))
    out, open_ = None, fragments
    limits = targets.groupBy("map_id").agg(F.max(F.greatest("x", "y")).alias("far"))
    far = limits.agg(F.coalesce(F.max("far"), F.lit(0))).first()[0]
    while True:
        cell = lambda name: F.floor(F.col(name) / tile).cast("int")
        left = open_.select("map_id", "lid", F.col("y").alias("fy"), F.col("x").alias("fx"), F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("ty"), F.sequence(cell("x") - 1, cell("x") + 1).alias("txs")).withColumn("tx", F.explode("txs")).drop("txs")
        right = targets.select("map_id", F.col("lid").alias("target"), "y", "x", cell("y").alias("ty"), cell("x").alias("tx"))
        apart = F.greatest(F.abs(F.col("x") - F.col("fx")), F.abs(F.col("y") - F.col("fy")))
        # each target pixel's distance from the fragment, then the pixels of each region at each distance: written once
        pairs = met(left, right, ["map_id", "ty", "tx"]).groupBy("map_id", "lid", "target", "y", "x").agg(F.min(apart).alias("d")).where(F.col("d") <= tile)
        votes = stored(pairs.groupBy("map_id", "lid", "target", "d").agg(F.count(F.lit(1)).alias("n")))
        found = votes.groupBy("map_id", "lid").agg(F.min_by("target", F.struct("d", -F.col("n"), "target")).alias("target"))
        out = found if out is None else out.unionByName(found)
        if tile > far:
            return out
        open_ = stored(met(open_, votes.select("map_id", "lid").distinct(), ["map_id", "lid"], "left_anti"))
        if open_.isEmpty():
            return out
        tile *= 2


def old_room_mapping(new: DataFrame, old: DataFrame) -> DataFrame:
    """For each new region the old one it overlaps most (ties to the smallest): map_id, lid, old_lid."""
    both = met(new, old.withColumnRenamed("lid", "old_lid"), AT).groupBy("map_id", "lid", "old_lid").agg(F.count(F.lit(1)).alias("n"))
    return both.groupBy("map_id", "lid").agg(F.max_by("old_lid", F.struct("n", -F.col("old_lid"))).alias("old_lid"))


def region_contact(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pixels of old regions in the ring round each new one: map_id, lid, old_lid, contact."""
    ring = around(new).select("map_id", "lid", "y", "x").distinct()
    return met(ring, old.withColumnRenamed("lid", "old_lid"), AT).groupBy("map_id", "lid", "old_lid").agg(F.count(F.lit(1)).alias("contact"))


def classified(new: DataFrame, old: DataFrame, resolution: float, min_area: float = 1.0, ratio: float = 0.3) -> DataFrame:
    """Each new region as 'new' or 'merge' with its target: without contact new; small ones, and ones whose largest
    contact exceeds the ratio of their boundary pixels, merge with the region of most contact."""
    size = new.groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"))
    own = new.select(*AT, "lid")
    outer = met(around(own), own, [*AT, "lid"], "left_anti").select("map_id", F.col("y0").alias("y"), F.col("x0").alias("x")).distinct()
    edge = met(new, outer, AT, "left_semi").groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("edge"))
    best = region_contact(new, old).groupBy("map_id", "lid").agg(F.max_by(F.struct("old_lid", "contact"), F.struct("contact", -F.col("old_lid"))).alias("b"))
    joined = met(met(size, edge, ["map_id", "lid"]), best, ["map_id", "lid"], "left")
    joins = F.col("b").isNotNull() & ((F.col("n") * (resolution * resolution) < min_area) | (F.col("b.contact") / F.col("edge") > ratio))
    return joined.select("map_id", "lid", F.when(joins, "merge").otherwise("new").alias("verdict"), F.when(joins, F.col("b.old_lid")).alias("target"))


SIDES = [(-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))]


def boundary_edges(regions: DataFrame) -> DataFrame:
    """Directed unit lattice edges round each region: map_id, lid, x0, y0, x1, y1."""
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("dy", "dx", "ax", "ay", "bx", "by"), (dy, dx, *e))]) for dy, dx, e in SIDES]))
    faces = regions.withColumn("s", side).select("map_id", "lid", F.col("y").alias("py"), F.col("x").alias("px"), "s", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    open_ = met(faces, regions.select(*AT, "lid"), ["map_id", "y", "x", "lid"], "left_anti")
    return open_.select("map_id", "lid", *[(F.col(p) + F.col(f"s.{o}")).alias(n) for p, o, n in (("px", "ax", "x0"), ("py", "ay", "y0"), ("px", "bx", "x1"), ("py", "by", "y1"))])


def shared_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges with their labels: map_id, a and b (ends in order), lids."""
    p, q = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return edges.select("map_id", "lid", F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).groupBy("map_id", "a", "b").agg(F.array_sort(F.collect_set("lid")).alias("lids"))


def adjacency(regions: DataFrame) -> DataFrame:
    """Pairs i < j of regions that overlap or have 8-adjacent pixels; sets of pixels may overlap."""
    near = around(regions, centre=True).select("map_id", F.col("lid").alias("i"), "y", "x")
    return met(near, regions.withColumnRenamed("lid", "j"), AT).where("i < j").select("map_id", "i", "j").distinct()


def fallback_regions(rasters: DataFrame, resolution: float = 0.05, min_area: float = 1.0, name: str = "labels") -> DataFrame:
    """Components, split by area, fragments merged one after the other: packed labels."""
    least = K.area_cutoff(min_area, resolution)

    def kernel(row: dict) -> Iterator[dict]:
        img = array_of(row)
        mask = img >= 200
        normal, small = K.split_by_area(K.components(mask if mask.any() else img > 0), least)
        yield {"h": row["h"], "w": row["w"], name: K.merge_fragments(normal, small).astype("<i4").tobytes()}

    return per_map(rasters, kernel, f"h int, w int, {name} binary")


def region_polygons(labels: DataFrame) -> DataFrame:
    """Packed labels -> map_id, lid, points: lattice polygons that share their edges."""

    def kernel(row: dict) -> Iterator[dict]:
        for c, p in K.polygons(array_of(row, "labels", np.int32)).items():
            yield {"lid": c, "points": [{"x": int(x), "y": int(y)} for x, y in p]}

    return per_map(labels, kernel, "lid int, points array<struct<x:int,y:int>>")


def final_polygons(rasters: DataFrame, labels: DataFrame) -> DataFrame:
    """Rasters and their packed labels -> map_id, lid, points: contours in pixels, pieces bridged, fragments joined,
    widened by a pixel to the walls."""
    both = met(labels.select("map_id", "labels"), rasters.select("map_id", "h", "w", "data"), "map_id")

    def kernel(row: dict) -> Iterator[dict]:
        for c, p in K.final_polygons(array_of(row), array_of(row, "labels", np.int32)).items():
            yield {"lid": c, "points": [{"x": int(x), "y": int(y)} for x, y in p]}

    return per_map(both, kernel, "lid int, points array<struct<x:int,y:int>>")


def grown(labels: DataFrame, masks: DataFrame, iterations: int) -> DataFrame:
    """Packed labels grown inside packed masks."""
    both = met(labels, masks.select("map_id", "data"), "map_id")

    def kernel(row: dict) -> Iterator[dict]:
        out = K.grow_regions(array_of(row) > 0, array_of(row, "labels", np.int32), iterations)
        yield {"h": row["h"], "w": row["w"], "labels": out.astype("<i4").tobytes()}

    return per_map(both, kernel, "h int, w int, labels binary")
