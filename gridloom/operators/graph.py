"""Room graphs: degrees, colours, walks, start rooms.

rooms(map_id, pos, ...) and edges(map_id, i, j) with i < j. A map's graph is gathered into one row (its rooms are few)
and walked there; maps are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import kernels as K
from .raster import met, per_map


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("map_id", "i", "j").union(edges.select("map_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def degrees(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    n = both_ways(edges).groupBy("map_id", F.col("i").alias("pos")).agg(F.count(F.lit(1)).alias("degree"))
    return met(rooms.select("map_id", "pos"), n, ["map_id", "pos"], "left").select("map_id", "pos", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_rows(rooms: DataFrame, edges: DataFrame, *extra: str) -> DataFrame:
    """One row a map: nodes (pos and the extra columns, by pos) and edges."""
    nodes = rooms.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("pos", *extra))).alias("nodes"))
    lines = edges.groupBy("map_id").agg(F.collect_list(F.struct("i", "j")).alias("edges"))
    return met(nodes, lines, "map_id", "left")


def graph_of(row: dict) -> dict[int, list[int]]:
    graph: dict[int, list[int]] = {n["pos"]: [] for n in row["nodes"]}
    for e in row["edges"] or ():
        graph[e["i"]].append(e["j"])
        graph[e["j"]].append(e["i"])
    return {k: sorted(set(v)) for k, v in graph.items()}


def coloured(rooms: DataFrame, edges: DataFrame, kept: bool = False) -> DataFrame:
    """map_id, pos, color. With kept, rooms hold a color column: nulls are filled in index order and conflicts mended;
    otherwise all are coloured by ascending degree."""

    def kernel(row: dict) -> Iterator[dict]:
        graph = graph_of(row)
        if kept:
            colors = {n["pos"]: n["color"] for n in row["nodes"] if n["color"] is not None}
            for room in sorted(graph):
                if room not in colors:
                    colors[room] = K.color_one(room, graph, colors)
            colors = K.repair_colors(graph, colors)
        else:
            colors = K.greedy_colors(graph)
        for room, color in sorted(colors.items()):
            yield {"pos": room, "color": color}

    return per_map(graph_rows(rooms, edges, *(["color"] if kept else [])), kernel, "pos int, color int")


def walked(rooms: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """map_id, pos, rank: preorder from the start room (map_id, start) or the room of highest degree."""
    rows = graph_rows(rooms, edges)
    rows = met(rows, starts, "map_id", "left") if starts is not None else rows.withColumn("start", F.lit(None).cast("int"))

    def kernel(row: dict) -> Iterator[dict]:
        for rank, room in enumerate(K.dfs_order(graph_of(row), row["start"])):
            yield {"pos": room, "rank": rank}

    return per_map(rows, kernel, "pos int, rank int")


def start_rooms(rooms: DataFrame, docks: DataFrame | None = None) -> DataFrame:
    """map_id, start. rooms(map_id, pos, points). Without a dock (map_id, dx, dy) the largest polygon, the first of
    equals; else the one that holds the dock, or the one whose boundary is nearest."""
    sized = rooms.select("map_id", "pos", "points", G.polygon_area(F.col("points")).alias("area"))
    if docks is None:
        return sized.groupBy("map_id").agg(F.max_by("pos", F.struct("area", -F.col("pos"))).alias("start"))
    near = met(sized, docks, "map_id", "left")
    x, y = F.col("dx").cast("double"), F.col("dy").cast("double")
    gap = F.when(G.inside_polygon(x, y, F.col("points")), F.lit(0.0)).otherwise(G.distance_to_polygon(x, y, F.col("points")))
    rank = F.when(F.col("dx").isNull(), -F.col("area")).otherwise(gap)
    return near.groupBy("map_id").agg(F.min_by("pos", F.struct(rank.alias("g"), "pos")).alias("start"))
