"""Landmarks: one point in every room, away from its walls and from furniture."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.labels import landmark_id
from . import kernels as K
from .raster import met, per_map

GRID = 51
#: A ring's last point within this of the first one closes it (fixed value).
CLOSED = 1e-6


def valid(x: Column, y: Column, points: Column, markers: Column, least: float) -> Column:
    """Inside the room, farther than `least` from its boundary, outside every marker and farther than that from it."""
    clear = F.forall(markers, lambda m: G.bind(G.ring(G.points_of(m), CLOSED), lambda p: ~G.inside_polygon(x, y, p) & (G.distance_to_polygon(x, y, p) > least)))
    return G.inside_polygon(x, y, points) & (G.distance_to_polygon(x, y, points) > least) & F.coalesce(clear, F.lit(True))


def centers(rooms: DataFrame, least: float = 0.1, grid: int = GRID) -> DataFrame:
    """rooms(map_id, pos, geometry, markers) -> map_id, pos, x, y: the box centre if valid; else the valid point of a
    grid over the box that is farthest from the boundary (within a billionth the first by x, then y); else the box
    centre. The grid of a room is searched in one kernel."""
    ring = G.ring(G.points_of(F.col("geometry")), CLOSED)
    base = G.settled(rooms.select("map_id", "pos", ring.alias("p"), F.coalesce("markers", F.array().cast("array<array<double>>")).alias("markers")))
    xs, ys = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    base = G.settled(base.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}))
    base = G.settled(base.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}))
    base = G.settled(base.withColumn("ok", valid(F.col("cx"), F.col("cy"), F.col("p"), F.col("markers"), least)))

    def xy(ring: list[dict] | None) -> list[tuple[float, float]]:
        points = [(q["x"], q["y"]) for q in ring or () if q]
        return [] if any(None in q for q in points) else points  # a ring with a gap bounds nothing

    def place(row: dict) -> Iterator[dict]:
        at = K.clearest_point(xy(row["p"]), [xy(m) for m in row["rings"]], least, grid)
        if at is not None:
            yield {"pos": row["pos"], "x": at[0], "y": at[1]}

    rings = F.transform("markers", lambda m: G.ring(G.points_of(m), CLOSED)).alias("rings")
    pos = base.schema["pos"].dataType.simpleString()
    best = per_map(base.where("NOT ok").select("map_id", "pos", "p", rings), place, f"pos {pos}, x double, y double")
    out = met(base.select("map_id", "pos", "cx", "cy"), best, ["map_id", "pos"], "left")
    return out.select("map_id", "pos", F.coalesce("x", "cx", F.lit(0.0)).alias("x"), F.coalesce("y", "cy", F.lit(0.0)).alias("y"))


def generated(rooms: DataFrame, least: float = 0.1) -> DataFrame:
    """rooms(map_id, pos, id, name, geometry, markers) -> landmark rows with running ids in room order."""
    at = centers(rooms, least)
    order = F.row_number().over(Window.partitionBy("map_id").orderBy("pos"))
    joined = met(rooms.select("map_id", "pos", F.col("id").alias("roomId"), "name"), at, ["map_id", "pos"])
    return joined.select("map_id", "pos", landmark_id(order).alias("id"), "roomId", "name", F.lit("pose").alias("type"), F.array(F.round("x", 3), F.round("y", 3), F.lit(0.0)).alias("geometry"))
