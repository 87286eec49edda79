"""Oriented door detections: decoding, non-maximum suppression, threshold lines.

raw(map_id, cell, channels): one row a candidate. detections(map_id, det_id, v, conf): four corners and a confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as G
from . import kernels as K
from .raster import array_of, met, per_map

#: Channels of the output formats: box or corners, confidence, angle (1-based; fixed values).
FORMATS = {"yolo_obb": {"conf": 5, "angle": 6}, "xywha": {"conf": 6, "angle": 5}, "xyxyxyxy": {"conf": 9}}
#: Pairs of boxes that are compared, and clipped, at a time.
PAIRS, CLIPPED = 1 << 18, 1 << 12


def decoded(raw: DataFrame, form: str = "yolo_obb", least: float = 0.1) -> DataFrame:
    """Candidates of at least some confidence as corners."""
    spec = FORMATS[form]
    at = lambda i: F.element_at("channels", i)
    if form == "xyxyxyxy":
        v = F.array(*[G.point(at(2 * i + 1), at(2 * i + 2)) for i in range(4)])
    else:
        v = G.box_vertices(at(1), at(2), at(3), at(4), at(spec["angle"]))
    held = G.settled(raw.where(at(spec["conf"]) >= least).select("map_id", "cell", "channels"))
    return G.settled(held.select("map_id", F.col("cell").alias("det_id"), v.alias("v"), at(spec["conf"]).alias("conf")))


def _pieces(p: np.ndarray, q: np.ndarray, margin: np.ndarray, closed: bool) -> np.ndarray:
    """What the pieces of p's edges within q add to the area they bound; corners are (corner, axis, n). An edge along one
    of q's counts if closed, where both run the same way (else the polygons only touch there)."""
    d, e = np.roll(p, -1, axis=0) - p, np.roll(q, -1, axis=0) - q
    size = np.hypot(e[:, 0], e[:, 1])
    size = np.where(size > 0, size, 1)
    nx, ny = -e[:, 1] / size, e[:, 0] / size
    total = np.zeros(p.shape[-1])
    for (x, y), (dx, dy) in zip(p, d):
        lo, hi, out = np.zeros_like(total), np.ones_like(total), np.zeros(len(total), bool)
        for j, (ox, oy) in enumerate(q):
            start = nx[j] * (x - ox) + ny[j] * (y - oy)
            rate = nx[j] * dx + ny[j] * dy
            level = np.abs(rate) <= margin
            if level.any():
                beyond = level & (start <= margin)
                if closed:
                    beyond &= (start < -margin) | (dx * e[j, 0] + dy * e[j, 1] <= 0)
                out |= beyond
            with np.errstate(divide="ignore", invalid="ignore"):
                t = -start / rate
            np.copyto(lo, t, where=~level & (rate > 0) & (t > lo))
            np.copyto(hi, t, where=~level & (rate < 0) & (t < hi))
        lo, hi = np.minimum(lo, 1), np.maximum(hi, 0)
        ax, ay, bx, by = x + lo * dx, y + lo * dy, x + hi * dx, y + hi * dy
        total += np.where((lo < hi) & ~out, ax * by - ay * bx, 0.0)
    return total / 2


def clip_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of the intersections of pairs of convex polygons (n, corners, 2), by the boundary of each intersection:
    the edges of one inside the other, and the other way round; 0 for degenerate ones."""
    if len(a) > CLIPPED:
        return np.concatenate([clip_areas(a[k : k + CLIPPED], b[k : k + CLIPPED]) for k in range(0, len(a), CLIPPED)])
    a, b = (np.ascontiguousarray((v - a[:, :1]).transpose(1, 2, 0)) for v in (a, b))

    def wound(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = p[:, 0], p[:, 1]
        s = (x * np.roll(y, -1, axis=0) - np.roll(x, -1, axis=0) * y).sum(axis=0) / 2
        return np.where(s < 0, p[::-1], p), np.abs(s)

    (a, one), (b, two) = wound(a), wound(b)
    margin = 1e-11 * np.maximum(np.abs(a).max(axis=(0, 1)), np.abs(b).max(axis=(0, 1)))
    area = _pieces(a, b, margin, True) + _pieces(b, a, margin, False)
    return np.where((one >= 1e-12) & (two >= 1e-12), np.clip(area, 0, np.minimum(one, two)), 0.0)




def _near(g: np.ndarray, l: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: E741
    """Pairs i < j of rows of one group (g, ascending) whose spans l..r meet, by a sweep along l, PAIRS or so at a time."""
    n = len(g)
    order = np.lexsort((l, g))
    events = np.lexsort((np.repeat([0, 1], n), np.concatenate([l[order], r[order]]), np.tile(g[order], 2)))
    begun = np.cumsum(events < n)
    end = np.empty(2 * n, np.int64)
    end[events] = begun
    counts = np.maximum(end[n:] - np.arange(n) - 1, 0)
    done = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        c = counts[at:to]
        p = np.repeat(np.arange(at, to), c)
        q = p + 1 + np.arange(len(p)) - np.repeat(done[at:to] - done[at], c)
        i, j = order[p], order[q]
        yield np.minimum(i, j), np.maximum(i, j)
        at = to


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the keys, cut anew so that a group never lies in two batches."""
    held: list[pa.RecordBatch] = []
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            last &= pc.equal(batch.column(k), batch.column(k)[-1]).to_numpy(zero_copy_only=False)
        at = int(last.argmax())
        if held and (at or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            if all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
                held.append(batch.slice(0, at))
                batch, at = batch.slice(at), 0
            yield from whole(held)
            held = []
        if at:
            yield batch.slice(0, at)
        held.append(batch.slice(at))
    if held:
        yield from whole(held)


def _overlaps(detections: DataFrame, tile: float, least: float) -> DataFrame:
    """iou_pairs with the confidences ca, cb of both."""
    xs, ys = F.transform("v", lambda p: p["x"]), F.transform("v", lambda p: p["y"])
    boxed = G.settled(detections.select("map_id", "det_id", "v", "conf", F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"), G.polygon_area(F.col("v")).alias("s")))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    tiled = boxed.where("map_id IS NOT NULL AND conf IS NOT NULL").withColumn("tx", cells("l", "r")).withColumn("ty", cells("t", "b"))
    keys = ["map_id", "tx", "ty"]
    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys, F.desc("conf"), "det_id")  # the earlier box of a pair is a
    kind = {f.name: f.dataType for f in detections.schema}
    out = StructType([StructField(n, t) for n, t in (("map_id", kind["map_id"]), ("a", kind["det_id"]), ("b", kind["det_id"]), ("ca", kind["conf"]), ("cb", kind["conf"]), ("iou", DoubleType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches, keys):
            number = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            left, top, right, bottom, size = (number(n).astype(float) for n in ("l", "t", "r", "b", "s"))
            tx, ty, conf = number("tx"), number("ty"), number("conf")
            code = lambda n: batch.column(n).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            maps, ids = code("map_id"), code("det_id")
            corners = batch.column("v").flatten()
            corners = np.stack([corners.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")], axis=-1).reshape(batch.num_rows, -1, 2)
            group = np.cumsum(np.concatenate([[0], (np.diff(maps) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0)]))
            for a, b in _near(group, left, right):
                fore, up = np.maximum(left[a], left[b]), np.maximum(top[a], top[b])
                back, down = np.minimum(right[a], right[b]), np.minimum(bottom[a], bottom[b])
                # one tile counts, where the overlap begins
                held = (up <= down) & (np.floor(fore / tile) == tx[a]) & (np.floor(up / tile) == ty[a])
                level = (conf[a] == conf[b]) | (np.isnan(conf[a]) & np.isnan(conf[b]))
                held &= ~(level & ((ids[a] == ids[b]) | (ids[a] < 0) | (ids[b] < 0)))
                if least > 0:
                    most = np.minimum(np.minimum((back - fore) * (down - up), size[a]), size[b])
                    held &= most * (1 + 1e-9) >= least * (size[a] + size[b] - most)
                a, b = a[held], b[held]
                if not len(a):
                    continue
                both = clip_areas(corners[a], corners[b])
                union = size[a] + size[b] - both
                iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                one, two = pa.array(a), pa.array(b)
                columns = [batch.column(n).take(k) for n, k in (("map_id", one), ("det_id", one), ("det_id", two), ("conf", one), ("conf", two))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(iou, pa.float64())], schema=arrow)

    return dealt.mapInArrow(run, out)


def iou_pairs(detections: DataFrame, tile: float = 256.0, least: float = 0.0) -> DataFrame:
    """Pairs of a map's detections whose bounding boxes meet: map_id, a, b (a before b by confidence, then id), iou.
    Boxes are dealt to tiles and met there by a sweep, so far ones are never paired. Pairs surely under `least` are not
    clipped: an intersection is at most the smaller area and what the bounding boxes share. Boxes without finite corners
    meet nothing."""
    return _overlaps(detections, tile, least).select("map_id", "a", "b", "iou")


def suppressed(detections: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Greedy suppression: by confidence (then id) each survivor removes the later ones that overlap it so much. Only the
    pairs that do are put in order; of a map no more is held than what has gone."""
    heavy = _overlaps(detections, 256.0, threshold).where(F.col("iou") >= threshold).drop("iou")
    dealt = heavy.repartition("map_id").sortWithinPartitions("map_id", F.desc("ca"), "a")
    out = StructType([StructField(n, detections.schema[n].dataType) for n in ("map_id", "det_id", "conf")])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for batch in batches:
            found = []
            ca, cb = ([None if c != c else c for c in batch.column(n).to_pylist()] for n in ("ca", "cb"))
            for k, (m, *a) in enumerate(zip(batch.column("map_id").to_pylist(), zip(batch.column("a").to_pylist(), ca), zip(batch.column("b").to_pylist(), cb))):
                if m != now:
                    now, gone = m, set()
                if a[0] not in gone and a[1] not in gone:
                    gone.add(a[1])
                    found.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(found, pa.int64())) for n in ("map_id", "b", "cb")], schema=arrow)

    whole = detections.where("map_id IS NOT NULL AND det_id IS NOT NULL")
    return met(whole, dealt.mapInArrow(run, out), ["map_id", "det_id", "conf"], "left_anti")


def ray_extended(lines: DataFrame, free: DataFrame, reach: int = 3) -> DataFrame:
    """lines(map_id, seg_id, line): both ends moved outward by unit steps, at most `reach`, while the rounded pixel is
    free (map_id, y, x): map_id, seg_id, x1, y1, x2, y2."""
    a, b = F.col("line")[0], F.col("line")[1]
    size = F.hypot(b["x"].cast("double") - a["x"], b["y"].cast("double") - a["y"])
    unit = lambda n: (b[n].cast("double") - a[n]) / size
    ends = lines.select("map_id", "seg_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), a["x"].cast("double").alias("px"), a["y"].cast("double").alias("py"), (-unit("x")).alias("ux"), (-unit("y")).alias("uy")), F.struct(F.lit(1).alias("end"), b["x"].cast("double").alias("px"), b["y"].cast("double").alias("py"), unit("x").alias("ux"), unit("y").alias("uy")))).alias("e")).select("map_id", "seg_id", "e.*")
    steps = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("x", F.rint(F.col("px") + F.col("k") * F.col("ux")).cast("int")).withColumn("y", F.rint(F.col("py") + F.col("k") * F.col("uy")).cast("int"))
    seen = met(steps, free.select("map_id", "y", "x").withColumn("open", F.lit(1)), ["map_id", "y", "x"], "left")
    run = Window.partitionBy("map_id", "seg_id", "end").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    went = seen.withColumn("still", F.min(F.coalesce("open", F.lit(0))).over(run)).groupBy("map_id", "seg_id", "end").agg(F.sum("still").alias("k"))
    moved = met(ends, went, ["map_id", "seg_id", "end"]).select("map_id", "seg_id", "end", (F.col("px") + F.col("k") * F.col("ux")).alias("x"), (F.col("py") + F.col("k") * F.col("uy")).alias("y"))
    pick = lambda e, n: F.max(F.when(F.col("end") == e, F.col(n)))
    return moved.groupBy("map_id", "seg_id").agg(pick(0, "x").alias("x1"), pick(0, "y").alias("y1"), pick(1, "x").alias("x2"), pick(1, "y").alias("y2"))


def threshold_lines(detections: DataFrame, maps: DataFrame, free: DataFrame, size: tuple[int, int] = (1280, 1280), reach: int = 3, least: int = 416) -> DataFrame:
    """Detections in model space -> extended centre lines in map pixels. maps: map_id, w, h."""
    box = G.letterbox(F.col("w"), F.col("h"), *size, least)
    placed = detections.join(maps.select("map_id", box.alias("_box")), "map_id").withColumn("v", G.un_letterbox(F.col("v"), F.col("_box")))
    lines = placed.select("map_id", F.col("det_id").alias("seg_id"), G.box_centerline(F.col("v")).alias("line")).where("line is not null")
    return ray_extended(lines, free, reach)


def merged_lines(lines: DataFrame, gap: int = 3) -> DataFrame:
    """lines(map_id, seg_id, x1, y1, x2, y2), whole pixels: level or upright ones on one line, in order of seg_id, become
    one where their facing ends lie within the gap. The first keeps its id. Repeated ids stand in order of their ends."""
    held = lines.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "x1", "y1", "x2", "y2"))).alias("lines"))

    def kernel(row: dict) -> Iterator[dict]:
        rows = row["lines"]
        for old, now in zip(rows, K.merge_segments([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows], gap)):
            if now:
                yield {"seg_id": old["seg_id"], **dict(zip(("x1", "y1", "x2", "y2"), now))}

    kind = lines.schema["seg_id"].dataType.simpleString()
    return per_map(held, kernel, f"seg_id {kind}, x1 int, y1 int, x2 int, y2 int")


def split_by_lines(rasters: DataFrame, lines: DataFrame, thickness: int = 2) -> DataFrame:
    """Free space without the drawn lines, as components: packed labels."""
    held = met(rasters, lines.groupBy("map_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("lines")), "map_id", "left")

    def kernel(row: dict) -> Iterator[dict]:
        img = array_of(row)
        mask = img >= 200
        for s in row["lines"] or ():
            mask = mask & ~K.draw_line(img.shape, (round(s["x1"]), round(s["y1"])), (round(s["x2"]), round(s["y2"])), thickness)
        yield {"h": row["h"], "w": row["w"], "labels": K.components(mask).astype("<i4").tobytes()}

    return per_map(held, kernel, "h int, w int, labels binary")


def letterbox_tensor(rasters: DataFrame, size: tuple[int, int] = (1280, 1280), least: int = 416, mean: tuple[float, ...] | None = None, std: tuple[float, ...] | None = None) -> DataFrame:
    """rasters -> map_id, scale, pad_x, pad_y, pre_x, pre_y, shape and tensor: (1, 3, th, tw) floats, packed channel after
    channel. Every target cell takes the source pixel under it; small maps are centred in `least` x `least` first, the
    rest is unknown (127). Values lie in 0..1, with mean and std (of each channel) they are normalised."""
    tw, th = size
    boxed = rasters.withColumn("box", G.letterbox(F.col("w"), F.col("h"), tw, th, least))
    shift, scale = (np.array(v if v is not None else (d, d, d), np.float32) for v, d in ((mean, 0.0), (std, 1.0)))

    def kernel(row: dict) -> Iterator[dict]:
        img, b = array_of(row), row["box"]
        small = row["w"] < least and row["h"] < least
        h, w = (least, least) if small else img.shape
        ys = np.minimum((np.arange(b["h"]) * h / b["h"]).astype(int), h - 1) - b["pre_y"]
        xs = np.minimum((np.arange(b["w"]) * w / b["w"]).astype(int), w - 1) - b["pre_x"]
        held = ((ys >= 0) & (ys < row["h"]))[:, None] & ((xs >= 0) & (xs < row["w"]))
        near = img[np.ix_(ys.clip(0, row["h"] - 1), xs.clip(0, row["w"] - 1))]
        full = np.full((th, tw), K.UNKNOWN, np.float32)
        full[b["pad_y"] : b["pad_y"] + b["h"], b["pad_x"] : b["pad_x"] + b["w"]] = np.where(held, near, K.UNKNOWN)
        full /= np.float32(255)
        packed = b"".join(((full - shift[c]) / scale[c]).astype("<f4").tobytes() for c in range(3))
        yield {**{k: b[k] for k in ("scale", "pad_x", "pad_y", "pre_x", "pre_y")}, "shape": [1, 3, th, tw], "tensor": packed}

    return per_map(boxed, kernel, "scale double, pad_x int, pad_y int, pre_x int, pre_y int, shape array<int>, tensor binary")


def tensor_cells(tensors: DataFrame) -> DataFrame:
    """letterbox_tensor's rows -> map_id, channel, v, n, places: how many cells have a value, and the sum of their places."""

    def kernel(row: dict) -> Iterator[dict]:
        _, channels, th, tw = row["shape"]
        values = np.frombuffer(row["tensor"], "<f4").reshape(channels, th * tw)
        for c in range(channels):
            found, own = np.unique(values[c], return_inverse=True)
            n, places = np.bincount(own), np.bincount(own, np.arange(th * tw))
            for k, v in enumerate(found):
                yield {"channel": c, "v": float(v), "n": int(n[k]), "places": int(places[k])}

    return per_map(tensors, kernel, "channel int, v double, n long, places long")
