"""The five behaviours over a table of requests: automatic partition, extension, repartition, division, merge.

maps(map_id, h, w, data, resolution, ox, oy, robot_model, uuid, charge_pose, furniture, labels) as sources.maps reads
them; requests(request_id, map_id, operation, room_merge_list, division). Every request gets one row (request_id,
statusCode, body); a bad one carries its code there and never fails the job. A map's rooms are few: they are gathered
per map where an order runs through them, everything else is joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BAD_ARGUMENT, FAILED, OK, Config
from ..functions import geometry as G
from ..functions import labels as L
from ..operators import detections as D
from ..operators import extension as X
from ..operators import graph as N
from ..operators import kernels as K
from ..operators import landmarks as M
from ..operators import polygons as P
from ..operators import raster as R
from ..operators import regions as RG
from ..sources.scratch import stored

#: Pixels of a contour, as tests and callers know it.
contour_mask = K.contour_mask

META = ["resolution", "ox", "oy", "robot_model", "uuid", "charge_pose", "furniture"]


def validated(requests: DataFrame, maps: DataFrame) -> DataFrame:
    """Requests with their map's labels and a code: null where the request can run."""
    readable = F.col("data").isNotNull() if "data" in maps.columns else F.lit(True)
    joined = R.met(requests, maps.select("map_id", "resolution", "labels", readable.alias("readable"), F.lit(True).alias("known")), "map_id", "left")
    ids = F.transform(L.rooms_of(F.col("labels.data")), lambda r: r["id"])
    a, b, wanted = F.col("division.A"), F.col("division.B"), F.col("room_merge_list")
    editing = F.col("operation").isin("division", "merge")
    code = (
        F.when(F.col("known").isNull(), 11)
        .when(~F.col("readable"), 1)
        .when(F.col("resolution").isNull() | (F.col("resolution") <= 0), 2)
        .when(~F.coalesce(F.col("operation").isin("split", "repartition", "division", "merge"), F.lit(False)), 9)
        .when(editing & F.col("labels").isNull(), 3)
        .when((F.col("operation") == "division") & (F.col("division.id").isNull() | a.isNull() | b.isNull() | (F.size(a) < 2) | (F.size(b) < 2)), 4)
        .when((F.col("operation") == "division") & ~F.array_contains(ids, F.col("division.id")), 7)
        .when((F.col("operation") == "merge") & (wanted.isNull() | (F.size(F.array_distinct(F.coalesce(wanted, F.array().cast("array<string>")))) < 2)), 4)
        .when((F.col("operation") == "merge") & (F.size(F.array_except(wanted, ids)) > 0), 7)
    )
    return joined.withColumn("code", code).withColumn("room_ids", ids)


def refusal() -> Column:
    """What is wrong with a request's arguments, before any map is looked at: null where nothing is."""
    known = F.coalesce(F.col("operation").isin("split", "repartition", "division", "merge"), F.lit(False))
    return (
        F.when(~known, "no such operation")
        .when((F.col("operation") == "merge") & F.col("room_merge_list").isNull(), "need room merge list")
        .when((F.col("operation") == "division") & F.col("division").isNull(), "need division croods list")
    )


def document(rooms: DataFrame, landmarks: DataFrame, maps: DataFrame, config: Config) -> DataFrame:
    """rooms and landmarks in order (map_id, pos, item fields) -> map_id, body: the labels document as JSON."""
    room = F.struct("name", "id", F.lit("polygon").alias("type"), "geometry", "colorType", "graph", "groundMaterial")
    parts = rooms.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", room.alias("r")))), lambda x: F.to_json(x["r"], {"ignoreNullFields": "false"})).alias("rooms"))
    mark = F.struct("geometry", "id", "roomId", "name", "type")
    marks = landmarks.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", mark.alias("m")))), lambda x: F.to_json(x["m"])).alias("marks"))
    joined = R.met(R.met(maps.select("map_id", "uuid"), parts, "map_id"), marks, "map_id", "left")
    items = F.concat(F.col("rooms"), F.coalesce("marks", F.array().cast("array<string>")))
    quoted = F.when(F.col("uuid").isNull(), "null").otherwise(F.expr("substring(to_json(array(uuid)), 2, length(to_json(array(uuid))) - 2)"))
    body = F.concat(F.lit(f'{{"version":"{config.labels_version}","uuid":'), quoted, F.lit(',"data":['), F.array_join(items, ","), F.lit("]}"))
    return joined.select("map_id", body.alias("body"))


def ordered_rooms(polygons: DataFrame, edges: DataFrame, maps: DataFrame, colors: DataFrame) -> DataFrame:
    """polygons(map_id, pos, points in pixels) -> rooms in walking order with names, ids, geometry, colours and
    neighbours by new position."""
    dock = G.world_to_pixel(F.col("charge_pose")[0], F.col("charge_pose")[1], F.col("resolution"), F.col("ox"), F.col("oy"), F.col("h"))
    docks = maps.where(~F.coalesce(F.forall("charge_pose", lambda v: v == 0), F.lit(True))).select("map_id", dock.alias("d")).select("map_id", F.col("d.x").alias("dx"), F.col("d.y").alias("dy"))
    order = N.walked(polygons.select("map_id", "pos"), edges, N.start_rooms(polygons, docks))
    both = R.met(N.both_ways(edges), order.withColumnRenamed("pos", "j").withColumnRenamed("rank", "to"), ["map_id", "j"])
    near = both.groupBy("map_id", F.col("i").alias("pos")).agg(F.array_sort(F.collect_list("to")).alias("graph"))
    rooms = R.met(R.met(R.met(R.met(polygons, order, ["map_id", "pos"]), colors, ["map_id", "pos"]), near, ["map_id", "pos"], "left"), maps.select("map_id", "h", *META), "map_id")
    geometry = G.contour_to_geometry(F.col("points"), F.col("resolution"), F.col("ox"), F.col("oy"), F.col("h"))
    return G.settled(
        rooms.select(
            "map_id", F.col("rank").alias("pos"), F.col("pos").alias("lid"), L.room_name(F.col("rank")).alias("name"), F.format_string("ROOM_%03d", F.col("rank") + 1).alias("id"), geometry.alias("geometry"),
            F.col("color").alias("colorType"), F.coalesce("graph", F.array().cast("array<int>")).alias("graph"), F.lit(None).cast("string").alias("groundMaterial"), F.col("furniture").alias("markers"), "robot_model",
        )
    )


def partition(maps: DataFrame, config: Config, detections: DataFrame | None = None) -> DataFrame:
    """Automatic partition: map_id, body. With detections (map_id, det_id, v in model space) free space is cut along
    their lines, without them it falls into its components."""
    rasters = maps.select("map_id", "h", "w", "data")
    layers = R.preprocessed(rasters, config.max_noise_area, config.dilate_iter, config.smooth_iterations, config.max_burr_len)
    if detections is None:
        labels = RG.fallback_regions(layers.where("layer = 'input'").drop("layer"), config.resolution, config.min_room_area)
    else:
        cleaned = layers.where("layer = 'cleaned'").drop("layer")
        free = R.unpack(cleaned).where("v >= 200").select("map_id", "y", "x")
        lines = D.threshold_lines(detections, maps.select("map_id", "w", "h"), free, config.target_size, int(config.max_extend), config.min_input_size)
        least = K.area_cutoff(config.min_room_area, config.resolution)

        def settle(row: dict) -> Iterator[dict]:
            normal, small = K.split_by_area(R.array_of(row, "labels", np.int32), least)
            yield {"h": row["h"], "w": row["w"], "labels": K.merge_fragments(normal, small).astype("<i4").tobytes()}

        labels = R.per_map(D.split_by_lines(cleaned, lines), settle, "h int, w int, labels binary")
    labels = stored(labels)
    polygons = stored(RG.final_polygons(layers.where("layer = 'input'").drop("layer"), labels).withColumnRenamed("lid", "pos"))
    edges = stored(RG.adjacency(R.unpack_labels(labels)))
    rooms = stored(ordered_rooms(polygons, edges, maps, N.coloured(polygons.select("map_id", "pos"), edges)))
    marks = M.generated(rooms.where(F.col("robot_model") == config.landmark_model), config.landmark_min_distance)
    return document(rooms, marks, maps, config)


def stored_rooms(maps: DataFrame) -> DataFrame:
    """The rooms of stored labels: map_id, pos, item fields, points (pixel contours)."""
    rooms = maps.select("map_id", "h", *META, F.posexplode(L.rooms_of(F.col("labels.data"))).alias("pos", "r"))
    contour = G.geometry_to_contour(F.col("r.geometry"), F.col("resolution"), F.col("ox"), F.col("oy"), F.col("h"))
    return stored(rooms.select("map_id", "pos", "r.name", "r.id", "r.geometry", "r.colorType", "r.groundMaterial", contour.alias("points"), F.col("furniture").alias("markers")))


def contour_edges(rooms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs i < j of positions whose filled contours, borders included, together are one component: crops that overlap
    or touch, compared where their boxes meet."""
    held = R.met(rooms.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("rooms")), sizes, "map_id")

    def kernel(row: dict) -> Iterator[dict]:
        shapes = [(room["pos"], X.contour_patch([(p["x"], p["y"]) for p in room["points"]], row["h"], row["w"])) for room in row["rooms"]]
        yield from ({"i": i, "j": j} for i, j in sorted(X.touching(shapes)))

    return R.per_map(held, kernel, "i int, j int")


def edited(rooms: DataFrame, maps: DataFrame, config: Config) -> DataFrame:
    """rooms after an edit (pos as stored; colorType null where it must be found) -> body, neighbours and colours new.
    Rooms that the edit left alone keep their landmarks' places, by room id; the others, and those without, get one.
    Landmarks stand in walking order from the largest room, those of a room as stored."""
    rooms = stored(rooms)
    rooms = rooms.withColumn("changed", F.col("colorType").isNull()) if "changed" not in rooms.columns else rooms
    edges = stored(contour_edges(rooms, maps.select("map_id", "h", "w")))
    colors = N.coloured(rooms.select("map_id", "pos", F.col("colorType").alias("color")), edges, kept=True)
    near = N.both_ways(edges).groupBy("map_id", F.col("i").alias("pos")).agg(F.array_sort(F.collect_list("j")).alias("graph"))
    full = R.met(R.met(rooms.drop("colorType"), colors, ["map_id", "pos"]), near, ["map_id", "pos"], "left")
    full = stored(full.withColumn("colorType", F.col("color")).withColumn("graph", F.coalesce("graph", F.array().cast("array<int>"))))
    old = maps.select("map_id", F.posexplode(L.landmarks_of(F.col("labels.data"))).alias("turn", "m")).select("map_id", "turn", F.col("m.roomId").alias("id"), F.col("m.geometry").alias("geometry"))
    named = full.select("map_id", "pos", F.col("id").alias("roomId"), "name")
    same = full.where(~F.col("changed")).select("map_id", "pos", "id")
    kept = stored(R.met(same, old, ["map_id", "id"]).select("map_id", "pos", "turn", "geometry"))
    rest = R.met(full, kept.select("map_id", "pos").distinct(), ["map_id", "pos"], "left_anti")
    new = M.generated(rest.withColumn("markers", F.lit(None).cast("array<array<double>>")), config.landmark_min_distance)
    marks = R.met(kept.unionByName(new.select("map_id", "pos", F.lit(0).alias("turn"), "geometry")), named, ["map_id", "pos"])
    walk = N.walked(full.select("map_id", "pos"), edges, N.start_rooms(full.select("map_id", "pos", "points")))
    marks = R.met(marks, walk, ["map_id", "pos"])
    place = F.row_number().over(Window.partitionBy("map_id").orderBy("rank", "turn"))
    marks = marks.select("map_id", place.alias("pos"), L.landmark_id(place).alias("id"), "roomId", "name", F.lit("pose").alias("type"), "geometry")
    return document(full, marks, maps, config)


def _pixels(geometry: Column) -> Column:
    return G.geometry_to_contour(geometry, F.col("resolution"), F.col("ox"), F.col("oy"), F.col("h"))


def division(requests: DataFrame, maps: DataFrame, config: Config) -> DataFrame:
    """Valid division requests -> request_id, code, body. Requests stand for maps: one room is cut in each."""
    own = requests.select(F.col("request_id"), "map_id", "division").join(maps, "map_id").withColumn("source_map", F.col("map_id")).withColumn("map_id", F.col("request_id"))
    rooms = stored_rooms(own)
    target = R.met(rooms, own.select("map_id", "division", "resolution", "ox", "oy", "h"), "map_id").where("id = division.id")
    ring = G.ring(G.points_of(F.col("geometry")))
    target = G.settled(target.select("map_id", "pos", "id", "geometry", "resolution", "ox", "oy", "h", "name", ring.alias("ring"), *[F.col(f"division.{e}")[i].cast("double").alias(f"{e.lower()}{c}") for e in "AB" for i, c in ((0, "x"), (1, "y"))]))
    chord = P.chord(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("ring"))
    target = G.settled(target.withColumn("chord", chord))
    target = G.settled(target.withColumn("halves", P.cut(F.col("ring"), F.col("chord"))))
    area = lambda i: G.polygon_area(F.col("halves")[i])
    named = rooms.groupBy("map_id").agg(F.collect_list("id").alias("ids"), F.collect_list("name").alias("names"), F.count(F.lit(1)).cast("int").alias("n"))
    code = F.when(F.size("geometry") < 8, 4).when(F.col("halves").isNull(), 5).when((area(0) < config.min_part_area) | (area(1) < config.min_part_area), 10).when(L.next_room_id(F.col("ids")).isNull(), 0)
    target = stored(R.met(target, named, "map_id").withColumn("code", code))
    good = target.where("code IS NULL")
    flat = lambda i: G.flat(F.transform(G.closed(F.col("halves")[i]), lambda p: G.point(F.round(p["x"], 3), F.round(p["y"], 3))))
    halves = good.select("map_id", F.explode(F.array(
        F.struct(F.col("pos"), F.col("name"), F.col("id"), flat(0).alias("geometry")),
        F.struct(F.col("n").alias("pos"), L.next_room_name(F.col("names")).alias("name"), L.next_room_id(F.col("ids")).alias("id"), flat(1).alias("geometry")),
    )).alias("r"), "resolution", "ox", "oy", "h")
    changed = halves.select("map_id", "r.pos", "r.name", "r.id", "r.geometry", F.lit(None).cast("int").alias("colorType"), F.lit(None).cast("string").alias("groundMaterial"), _pixels(F.col("r.geometry")).alias("points"))
    kept = R.met(R.met(rooms, good.select("map_id", "pos"), ["map_id", "pos"], "left_anti"), good.select("map_id"), "map_id", "left_semi").drop("markers")
    bodies = edited(kept.unionByName(changed), R.met(own, good.select("map_id"), "map_id", "left_semi"), config)
    return R.met(target.select(F.col("map_id").alias("request_id"), "code"), bodies.withColumnRenamed("map_id", "request_id"), "request_id", "left")


def merge(requests: DataFrame, maps: DataFrame, config: Config) -> DataFrame:
    """Valid merge requests -> request_id, code, body: the listed rooms become the first of them."""
    own = requests.select("request_id", "map_id", "room_merge_list").join(maps, "map_id").withColumn("map_id", F.col("request_id"))
    rooms = stored_rooms(own)
    listed = R.met(rooms, own.select("map_id", "room_merge_list"), "map_id").withColumn("turn", F.array_position("room_merge_list", F.col("id"))).where("turn > 0")
    rows = N.graph_rows(listed, contour_edges(listed, own.select("map_id", "h", "w")), "turn")

    def connected(row: dict) -> Iterator[dict]:
        graph = N.graph_of(row)
        start = min(row["nodes"], key=lambda n: n["turn"])["pos"]
        seen, todo = {start}, [start]
        while todo:
            for v in graph[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        yield {"start": start, "whole": len(seen) == len(graph)}

    state = R.per_map(rows, connected, "start int, whole boolean")
    groups = listed.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "geometry"))), lambda g: G.ring(G.points_of(g["geometry"]))).alias("rings"))
    state = stored(R.met(state, P.unions(groups), "map_id").withColumn("code", F.when(~F.col("whole"), 8).when(F.size("points") < 3, 4)))
    good = state.where("code IS NULL")
    merged = R.met(R.met(listed, good.select("map_id", F.col("start").alias("pos"), F.col("points").alias("ring")), ["map_id", "pos"]), own.select("map_id", "resolution", "ox", "oy", "h"), "map_id")
    flat = G.flat(F.transform(G.closed(F.col("ring")), lambda p: G.point(F.round(p["x"], 3), F.round(p["y"], 3))))
    merged = G.settled(merged.drop("geometry", "points").withColumn("geometry", flat))
    changed = merged.select("map_id", "pos", "name", "id", "geometry", F.lit(None).cast("int").alias("colorType"), "groundMaterial", _pixels(F.col("geometry")).alias("points"))
    kept = R.met(R.met(rooms, listed.select("map_id", "pos"), ["map_id", "pos"], "left_anti"), good.select("map_id"), "map_id", "left_semi").drop("markers")
    after = kept.unionByName(changed).withColumn("pos", (F.row_number().over(Window.partitionBy("map_id").orderBy("pos")) - 1).cast("int"))
    bodies = edited(after, R.met(own, good.select("map_id"), "map_id", "left_semi"), config)
    return R.met(state.select(F.col("map_id").alias("request_id"), "code"), bodies.withColumnRenamed("map_id", "request_id"), "request_id", "left")


#: Steps by which door lines may be carried on in an extension (fixed value).
EXTENSION_REACH = 5


def extension(requests: DataFrame, maps: DataFrame, config: Config, detections: DataFrame | None = None) -> DataFrame:
    """Splitting a map that has labels: rooms keep ids, names and colours, new space joins them or makes new rooms, cut
    along the detections' lines (see `partition`). Rooms then stand in walking order and neighbours name that order.
    A map without new space keeps its rooms and landmarks as they are; only neighbours and colours are renewed."""
    own = R.met(requests.select("request_id", "map_id"), maps, "map_id").withColumn("source_map", F.col("map_id")).withColumn("map_id", F.col("request_id"))
    rooms = stored_rooms(own)
    chain = (config.max_noise_area, config.dilate_iter, config.smooth_iterations, config.max_burr_len)
    rasters = own.select("map_id", "h", "w", "data")
    held = R.met(rasters, rooms.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("rooms")), "map_id", "left")
    if detections is None:
        held = held.withColumn("lines", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    else:
        doors = R.met(detections.withColumnRenamed("map_id", "source_map"), own.select("source_map", "map_id"), "source_map").drop("source_map")
        free = R.unpack(R.preprocessed(rasters, *chain).where("layer = 'cleaned'").drop("layer")).where("v >= 200").select("map_id", "y", "x")
        lines = D.threshold_lines(doors, own.select("map_id", "w", "h"), free, config.target_size, EXTENSION_REACH, config.min_input_size)
        held = R.met(held, lines.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("lines")), "map_id", "left")
    least = config.min_room_area / config.resolution**2

    grown = stored(X.extended_maps(held, least, chain, config.wall_threshold, config.threshold_thickness))
    wider = grown.where("pos < 0").select("map_id")
    changed = R.met(grown.where("pos >= 0"), own.select("map_id", "resolution", "ox", "oy", "h"), "map_id")
    geometry = G.contour_to_geometry(F.col("points"), F.col("resolution"), F.col("ox"), F.col("oy"), F.col("h"))
    changed = G.settled(changed.select("map_id", "pos", F.col("points").alias("new_points"), geometry.alias("new_geometry")))
    both = R.met(rooms.drop("markers"), changed, ["map_id", "pos"], "full")
    known = rooms.groupBy("map_id").agg(F.collect_list("name").alias("names"), F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")).alias("last"))
    turns = Window.partitionBy("map_id").orderBy("pos")
    both = R.met(both, known, "map_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("turn", F.sum(F.col("id").isNull().cast("int")).over(turns))
    unused = F.filter(F.transform(F.sequence(F.lit(0), F.size("names") + F.col("turn")), L.room_name), lambda n: ~F.array_contains("names", n))
    full = R.met(both, wider.withColumn("wider", F.lit(True)), "map_id", "left").select(
        "map_id", "pos", F.coalesce("name", F.get(unused, F.col("turn") - 1)).alias("name"), F.coalesce("id", F.format_string("ROOM_%03d", F.coalesce("last", F.lit(0)) + F.col("turn"))).alias("id"),
        F.coalesce("new_geometry", "geometry").alias("geometry"), "colorType", F.when(F.col("wider").isNull(), F.col("groundMaterial")).alias("groundMaterial"), F.coalesce("new_points", "points").alias("points"), F.coalesce("wider", F.lit(False)).alias("wider"),
    )
    full = stored(full)
    over = full.where(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int") > 999).select("map_id").distinct()  # there is no such id: the request fails
    full = R.met(full, over, "map_id", "left_anti")
    edges = stored(contour_edges(full, own.select("map_id", "h", "w")))
    colors = N.coloured(full.select("map_id", "pos", F.col("colorType").alias("color")), edges, kept=True)
    walk = N.walked(full.where("wider").select("map_id", "pos"), R.met(edges, wider, "map_id", "left_semi"), N.start_rooms(full.where("wider")))
    order = stored(walk.unionByName(full.where("NOT wider").select("map_id", "pos", F.col("pos").alias("rank"))))
    near = R.met(N.both_ways(edges), order.withColumnsRenamed({"pos": "j", "rank": "to"}), ["map_id", "j"]).groupBy("map_id", F.col("i").alias("pos")).agg(F.array_sort(F.collect_list("to")).alias("graph"))
    done = R.met(R.met(R.met(full.drop("colorType"), order, ["map_id", "pos"]), colors, ["map_id", "pos"]), near, ["map_id", "pos"], "left")
    done = stored(done.select("map_id", F.col("rank").alias("pos"), "name", "id", "geometry", F.col("color").alias("colorType"), F.coalesce("graph", F.array().cast("array<int>")).alias("graph"), "groundMaterial", "wider"))
    placed = R.met(done.where("wider"), own.where(F.col("robot_model") == config.landmark_model).select("map_id", F.col("furniture").alias("markers")), "map_id")
    kept = R.met(own, wider, "map_id", "left_anti").select("map_id", F.posexplode(L.landmarks_of(F.col("labels.data"))).alias("pos", "m")).select("map_id", "pos", "m.id", "m.roomId", "m.name", "m.type", "m.geometry")
    bodies = document(done, kept.unionByName(M.generated(placed, config.landmark_min_distance)), own, config)
    return R.met(own.select("request_id"), bodies.withColumnRenamed("map_id", "request_id"), "request_id", "left").withColumn("code", F.lit(None).cast("int"))


def model_tensors(maps: DataFrame, config: Config) -> DataFrame:
    """What a door model takes for each map: the cleaned input layer as a tensor, by the configuration's target size, least
    size and normalisation."""
    chain = (config.max_noise_area, config.dilate_iter, config.smooth_iterations, config.max_burr_len)
    layers = R.preprocessed(maps.select("map_id", "h", "w", "data"), *chain).where("layer = 'input'").drop("layer")
    return D.letterbox_tensor(layers, config.target_size, config.min_input_size, *((config.mean, config.std) if config.normalize else (None, None)))


def doors_of(raw: DataFrame, config: Config) -> DataFrame:
    """A model's raw candidates (map_id, cell, channels) as detections: decoded by the configured format and least
    confidence, then suppressed by the configured overlap."""
    return D.suppressed(D.decoded(raw, config.output_format, config.conf_threshold), config.nms_threshold)


def run(requests: DataFrame, maps: DataFrame, config: Config | None = None, detections: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """request_id, statusCode, body of every request: 200 with the labels document, 190 with the code of a failure, 171
    with what is missing from its arguments. detections: door boxes of the maps, see `partition`; raw: a model's
    candidates instead, see `doors_of`."""
    config = config or Config()
    if raw is not None:
        if detections is not None:
            raise ValueError("give either detections or raw candidates")
        detections = stored(doors_of(raw, config))
    asked = stored(requests.withColumn("refusal", refusal()))
    refused = asked.where("refusal IS NOT NULL").select("request_id", F.lit(BAD_ARGUMENT).alias("statusCode"), F.col("refusal").alias("body"))
    checked = stored(validated(asked.where("refusal IS NULL").drop("refusal"), maps))
    maps = maps.where("data IS NOT NULL")
    ok = checked.where("code IS NULL")
    has = F.col("labels").isNotNull() & (F.size("labels.data") > 0)
    fresh = ok.where((F.col("operation") == "repartition") | ((F.col("operation") == "split") & ~F.coalesce(has, F.lit(False))))
    old = ok.where((F.col("operation") == "split") & has)
    columns = ("request_id", "code", "body")
    parts = [checked.where("code IS NOT NULL").select("request_id", "code", F.lit(None).cast("string").alias("body"))]
    if not fresh.isEmpty():  # what nobody asks for isn't planned
        wanted = R.met(maps, fresh.select("map_id").distinct(), "map_id", "left_semi")
        auto = R.met(fresh.select("request_id", "map_id"), partition(wanted, config, detections), "map_id", "left")
        parts.append(auto.withColumn("code", F.lit(None).cast("int")).select(*columns))
    for rows, answer in ((ok.where("operation = 'division'"), division), (ok.where("operation = 'merge'"), merge)):
        if not rows.isEmpty():
            parts.append(answer(rows, maps, config).select(*columns))
    if not old.isEmpty():
        parts.append(extension(old, maps, config, detections).select(*columns))
    done = reduce(DataFrame.unionByName, parts)
    failed = F.col("code").isNotNull() | F.col("body").isNull()
    done = done.select("request_id", F.when(failed, FAILED).otherwise(OK).alias("statusCode"), F.when(failed, F.coalesce(F.col("code"), F.lit(0)).cast("string")).otherwise(F.col("body")).alias("body"))
    return done.unionByName(refused)
