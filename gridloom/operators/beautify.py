"""Room contours made plain: sight lines, axis-aligned edges, overlaps, and the doorways on their borders.

A contour is an array of pixels (x, y). Its edges may run over walls and unknown space but not over free pixels (255),
save those of a contour's own border, which counts as wall. Contours of a map are taken in order, as each one's border
is wall for the later ones; what one contour's edges need is looked at in crops, doorways are windows over the borders'
pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .polygons import straightened
from .raster import array_of, met, per_map

#: Rounds after which a contour is left as it is, whether it has settled or not.
ROUNDS = 4


class Sight:
    """Which lines are clear of free pixels. Level and upright ones are two look-ups in sums along rows and columns."""

    def __init__(self, free: np.ndarray):
        self.free = free
        self.rows = np.zeros((free.shape[0], free.shape[1] + 1), np.int32)
        self.cols = np.zeros((free.shape[0] + 1, free.shape[1]), np.int32)
        np.cumsum(free, axis=1, out=self.rows[:, 1:])
        np.cumsum(free, axis=0, out=self.cols[1:])

    def clear(self, p: Sequence[int], q: Sequence[int]) -> bool:
        (x0, y0), (x1, y1) = p, q
        if y0 == y1:
            return self.rows[y0, max(x0, x1) + 1] == self.rows[y0, min(x0, x1)]
        if x0 == x1:
            return self.cols[max(y0, y1) + 1, x0] == self.cols[min(y0, y1), x0]
        x, y = np.array(K.bresenham(x0, y0, x1, y1)).T
        return not self.free[y, x].any()


Points = list[tuple[int, int]]


def without_collinear(points: Points) -> Points:
    """As geometry.without_collinear: no repeats, no points on a straight line with both neighbours; the ends stay."""
    if len(points) < 3:
        return list(points)
    u = [p for i, p in enumerate(points) if not i or p != points[i - 1]]
    bends = lambda a, p, b: (p[0] - a[0]) * (b[1] - a[1]) != (p[1] - a[1]) * (b[0] - a[0])
    return [p for i, p in enumerate(u) if i in (0, len(u) - 1) or bends(u[i - 1], p, u[i + 1])]


def dropped(points: Points, sight: Sight) -> Points:
    """The vertices that are needed: from each kept one, the last that it sees the next of."""
    out = [points[0]]
    for i in range(1, len(points) + 1):
        if not sight.clear(out[-1], points[i % len(points)]):
            out.append(points[i - 1])
    return out


def least_turns(closed: np.ndarray, p: tuple[int, int], q: tuple[int, int]) -> Points | None:
    """The corners of a path of fewest turns from p to q, by rows and columns within the box of both, over pixels that
    are not free; None without one. closed: not free. All pixels that so many turns reach are found at once: each turn
    adds the runs, of the other direction, of what is reached."""
    (xa, xb), (ya, yb) = sorted((p[0], q[0])), sorted((p[1], q[1]))
    box = closed[ya : yb + 1, xa : xb + 1]
    start, end = (p[1] - ya, p[0] - xa), (q[1] - ya, q[0] - xa)
    runs = []
    for a in (box, box.T):  # level, upright
        step = np.diff(np.pad(a.astype(np.int8), ((0, 0), (1, 0))), axis=1) == 1
        ids = np.where(a, np.cumsum(step).reshape(a.shape), 0)
        runs.append(ids if a is box else ids.T)
    runs[0][start], runs[1][start] = runs[0][start] or -1, runs[1][start] or -1
    level = [[], []]  # what is reached by so many turns, moving level or upright at last
    seen = [np.zeros(box.shape, bool), np.zeros(box.shape, bool)]
    now = [np.zeros(box.shape, bool), np.zeros(box.shape, bool)]
    for d in (0, 1):
        now[d] = runs[d] == runs[d][start]
    while any(n.any() for n in now):
        for d in (0, 1):
            seen[d] |= now[d]
            level[d].append(now[d])
        turns = len(level[0]) - 1
        for d in (0, 1):
            if level[d][turns][end]:
                at, path = end, [end]
                for k in range(turns, 0, -1):  # back over the nearest cell that one turn less reaches
                    run = runs[d] == runs[d][at]
                    ys, xs = np.nonzero(run & level[1 - d][k - 1])
                    best = np.lexsort((xs, ys, np.abs(ys - at[0]) + np.abs(xs - at[1])))[0]
                    at, d = (int(ys[best]), int(xs[best])), 1 - d
                    path.append(at)
                path.append(start)
                return without_collinear([(x + xa, y + ya) for y, x in reversed(path)])
        now = [np.isin(runs[d], np.unique(runs[d][now[1 - d] & (runs[d] != 0)])) & (runs[d] != 0) & ~seen[d] for d in (0, 1)]
    return None


def aligned(points: Points, sight: Sight) -> Points:
    """Slanted edges as level and upright ones: over a corner where that is clear, else by the path of fewest turns; an
    edge without any stays."""
    if len(points) < 2:
        return list(points)
    out = [points[0]]
    for i in range(1, len(points) + 1):
        p, q = out[-1], points[i % len(points)]
        if p[0] != q[0] and p[1] != q[1]:
            corners = [c for c in ((q[0], p[1]), (p[0], q[1])) if sight.clear(p, c) and sight.clear(c, q)]
            if corners:
                out.append(corners[0])
            else:
                out += (least_turns(~sight.free, p, q) or [])[1:-1]
        out.append(q)
    return out


def _filled(points: Points) -> tuple[np.ndarray, int, int]:
    """A contour's pixels, border included, as a crop with the place of its corner."""
    xy = np.array(points)
    x0, y0 = xy.min(axis=0)
    w, h = xy.max(axis=0) - (x0, y0) + 1
    mask = K.contour_mask([(int(x - x0), int(y - y0)) for x, y in points], h, w)
    if len(points) < 3:
        for p, q in zip(points, points[1:] or points):
            for x, y in K.bresenham(*p, *q):
                mask[y - y0, x - x0] = True
    return mask, int(x0), int(y0)


def refilled(points: Points) -> Points:
    """The outer contour of what a contour encloses: spikes and inner loops go."""
    mask, x0, y0 = _filled(points)
    return [(int(x + x0), int(y + y0)) for x, y in K.outer_contour(mask)]


def plain(points: Points, sight: Sight, rounds: int = ROUNDS) -> Points:
    """Vertices dropped, edges aligned, filled and traced again, aligned: until nothing changes or for so many rounds."""
    now = points
    for _ in range(rounds):
        once = without_collinear(dropped(dropped(now, sight), sight))
        traced = refilled(aligned(once, sight))
        before, now = now, without_collinear(aligned(traced, sight)) if traced else once
        if set(now) == set(before):
            break
    return now


def _border(points: Points) -> np.ndarray:
    return np.array([c for p, q in zip(points, [*points[1:], points[0]]) for c in K.bresenham(*p, *q)])


def _cells(points: Points, x0: int, y0: int, w: int, h: int) -> np.ndarray:
    """The unit squares between pixels that a contour encloses, in a window."""
    return K.fill_polygon(np.array(points) - (x0, y0), h, w)


def without_overlaps(rings: list[Points]) -> list[Points]:
    """Earlier contours take what they share with later ones: of each later one the largest part outside the earlier
    stays, traced along the edges that the two areas don't share. Then what earlier ones share with later ones goes in
    the same way (nothing is left of that). Only pairs whose boxes meet are looked at."""
    rings = list(rings)
    box = lambda r: (*np.min(r, axis=0).tolist(), *np.max(r, axis=0).tolist())
    boxes = [box(r) if r else None for r in rings]
    for i in range(len(rings)):
        for j in range(len(rings)):
            a, b = boxes[i], boxes[j]
            if i == j or not a or not b or a[0] >= b[2] or b[0] >= a[2] or a[1] >= b[3] or b[1] >= a[3]:
                continue
            window = b[0], b[1], b[2] - b[0], b[3] - b[1]
            mine, theirs = _cells(rings[j], *window), _cells(rings[i], *window)
            parts = K.components(mine & ~theirs, corners=False)
            if not (mine & theirs).any() or not parts.any():
                continue
            size = np.bincount(parts.ravel())
            size[0] = 0
            edges = K.boundary_edges((parts == size.argmax()).astype(np.int32))[:, 1:]
            ring = straightened(K.outer_polygon(edges)) + (b[0], b[1])
            rings[j] = [(int(x), int(y)) for x, y in ring]
            boxes[j] = box(rings[j])
    return rings


def beautified(rasters: DataFrame, contours: DataFrame) -> DataFrame:
    """rasters and contours (map_id, pos, points in pixels) -> map_id, pos, points: plain, aligned, without overlaps."""
    held = met(contours.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("rooms")), rasters.select("map_id", "h", "w", "data"), "map_id")

    def kernel(row: dict) -> Iterator[dict]:
        free = array_of(row) == K.FREE
        rings, rooms = [], [r for r in row["rooms"] if r["points"]]
        for room in rooms:
            points = [(int(p["x"]), int(p["y"])) for p in room["points"]]
            xy = _border(points)
            xy = xy[(xy >= 0).all(axis=1) & (xy[:, 0] < row["w"]) & (xy[:, 1] < row["h"])]
            free[xy[:, 1], xy[:, 0]] = False
            rings.append(plain(points, Sight(free)))
        for room, ring in zip(rooms, without_overlaps(rings)):
            yield {"pos": room["pos"], "points": [{"x": x, "y": y} for x, y in without_collinear(ring)]}

    return per_map(held, kernel, "pos int, points array<struct<x:int,y:int>>")


def border_pixels(rings: DataFrame) -> DataFrame:
    """rings(map_id, pos, points) -> map_id, pos, n, t, x, y: the n pixels of each closed border in order, t from 0."""
    ends = rings.where(F.size("points") > 0).select("map_id", "pos", F.posexplode("points").alias("k", "p"), F.col("points").alias("ps"))
    edges = ends.select("map_id", "pos", "k", "p", F.col("ps")[F.pmod(F.col("k") + 1, F.size("ps"))].alias("q"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    edges = edges.withColumn("n", F.greatest(F.abs(dx), F.abs(dy)))
    before = Window.partitionBy("map_id", "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("map_id", "pos")))
    step = edges.where("n > 0").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    along = lambda c: (F.col(f"p.{c}") + F.round((F.col(f"q.{c}") - F.col(f"p.{c}")) * F.col("s") / F.col("n"))).cast("int").alias(c)
    return step.select("map_id", "pos", F.col("all").alias("n"), (F.col("from") + F.col("s")).alias("t"), along("x"), along("y"))


def doorways(rings: DataFrame, free: DataFrame) -> DataFrame:
    """Where borders run over free pixels (free: map_id, y, x): map_id, pos, seg_id, x1, y1, x2, y2, each run as straight
    segments in the border's order. A border is a cycle, so its first and last run may be one; a single pixel between
    free ones doesn't part a run, on any border; a run of one pixel is no doorway."""
    chain = border_pixels(rings)
    turn = Window.partitionBy("map_id", "pos").orderBy("t")
    flagged = met(chain, free.select("map_id", "y", "x").distinct().withColumn("free", F.lit(1)), ["map_id", "y", "x"], "left").withColumn("free", F.coalesce("free", F.lit(0)))

    def cyclic(name: str, step: int):
        """The neighbour's value on the cycle."""
        whole = Window.partitionBy("map_id", "pos").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.lag(name).over(turn), F.last(name).over(whole)) if step < 0 else F.coalesce(F.lead(name).over(turn), F.first(name).over(whole))

    island = flagged.withColumn("a", cyclic("free", -1)).withColumn("b", cyclic("free", 1)).where("free = 0 AND a = 1 AND b = 1").select("map_id", "y", "x").distinct()
    flagged = met(flagged, island.withColumn("island", F.lit(1)), ["map_id", "y", "x"], "left").withColumn("free", F.greatest("free", F.coalesce("island", F.lit(0)))).drop("island")
    opened = flagged.withColumn("begins", ((F.col("free") == 1) & (cyclic("free", -1) == 0)).cast("int"))
    opened = opened.withColumn("run", F.sum("begins").over(turn)).withColumn("last", F.max("run").over(Window.partitionBy("map_id", "pos")))
    # pixels before the first beginning belong to the last run, behind its others
    opened = opened.where("free = 1").withColumn("u", F.col("t") + F.when((F.col("run") == 0) & (F.col("last") > 0), F.col("n")).otherwise(0)).withColumn("run", F.when(F.col("run") == 0, F.col("last")).otherwise(F.col("run")))
    line = Window.partitionBy("map_id", "pos", "run").orderBy("u")
    ahead, behind = (lambda c: F.lead(c).over(line)), (lambda c: F.lag(c).over(line))
    near = opened.select("map_id", "pos", "run", "u", "x", "y", behind("x").alias("xa"), behind("y").alias("ya"), ahead("x").alias("xb"), ahead("y").alias("yb"))
    cross = (F.col("x") - F.col("xa")) * (F.col("yb") - F.col("ya")) - (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    kept = near.where(F.col("xa").isNull() | F.col("xb").isNull() | (cross != 0))
    found = kept.select("map_id", "pos", "run", "u", F.col("x").alias("x1"), F.col("y").alias("y1"), ahead("x").alias("x2"), ahead("y").alias("y2")).where("x2 IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("map_id", "pos").orderBy("run", "u")) - 1
    return found.select("map_id", "pos", number.alias("seg_id"), "x1", "y1", "x2", "y2")


def merged_doorways(doors: DataFrame, gap: int = 3) -> DataFrame:
    """Doorways of a room on one line whose facing ends lie within the gap, as one: `detections.merged_lines`, room by room."""
    from .detections import merged_lines

    keyed = doors.select(F.struct("map_id", "pos").alias("map_id"), "seg_id", "x1", "y1", "x2", "y2")
    return merged_lines(keyed, gap).select("map_id.map_id", "map_id.pos", "seg_id", "x1", "y1", "x2", "y2")
