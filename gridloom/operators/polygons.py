"""World polygons: cutting one by a line, joining several."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import kernels as K
from .raster import per_map, spread


def chord(ax: Column, ay: Column, bx: Column, by: Column, points: Column) -> Column:
    """The two crossings to cut along: neighbours on the line whose midpoint lies inside, nearest to AB's midpoint;
    else the crossing nearest to A with the one nearest to B. Null if there are none."""
    mx, my = (ax + bx) / 2, (ay + by) / 2

    def choose(c: Column) -> Column:
        def pair(i: Column) -> Column:
            p, q = F.get(c, i), F.get(c, i + 1)
            x, y = (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2
            return F.when(G.inside_polygon(x, y, points), F.struct(F.hypot(x - mx, y - my).alias("d"), i.alias("i")))

        near = F.array_min(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(c) - 2), pair)))
        to = lambda x, y: F.array_min(F.transform(c, lambda p, i: F.struct(F.hypot(p["x"] - x, p["y"] - y).alias("d"), i.alias("i"))))["i"]
        back = F.when(to(ax, ay) != to(bx, by), F.array(F.get(c, F.least(to(ax, ay), to(bx, by))), F.get(c, F.greatest(to(ax, ay), to(bx, by)))))
        return F.when(F.size(c) >= 2, F.coalesce(G.bind(near, lambda n: F.when(n.isNotNull(), F.array(F.get(c, n["i"]), F.get(c, n["i"] + 1)))), back))

    return G.bind(G.line_crossings(ax, ay, bx, by, points), choose)


def cut(points: Column, pair: Column) -> Column:
    """The two rings on either side of a chord (two crossings), larger first; null without a chord."""
    n = F.size(points)

    def side(p: Column, q: Column) -> Column:
        count = F.pmod(q["edge"] - p["edge"], n)
        between = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda j: F.get(points, (p["edge"] + 1 + j) % n))).otherwise(F.slice(points, 1, 0))
        whole = F.concat(F.array(G.point(p["x"], p["y"])), between, F.array(G.point(q["x"], q["y"])))
        return G.ring(F.filter(whole, lambda v, i: (i == 0) | (v != F.get(whole, i - 1))))

    one, two = side(pair[0], pair[1]), side(pair[1], pair[0])
    return F.when(pair.isNotNull(), G.bind(F.struct(one.alias("a"), two.alias("b")), lambda s: F.when(G.polygon_area(s["a"]) >= G.polygon_area(s["b"]), F.array(s["a"], s["b"])).otherwise(F.array(s["b"], s["a"]))))


#: Width by which parts that almost touch are grown and shrunk again (fixed value).
CLOSING = 1e-4
#: A ring round nothing.
_NOTHING = np.zeros((1, 2))


#: Points times edges that are compared at once.
_AT_ONCE = 1 << 20


def _windings(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """How often a ring runs round each point, anticlockwise counted positive."""
    x0, y0 = ring.T
    x1, y1 = np.roll(ring, -1, axis=0).T
    out = np.zeros(len(p), np.int64)
    step = max(1, _AT_ONCE // max(1, len(ring)))
    for k in range(0, len(p), step):
        px, py = p[k : k + step, :1], p[k : k + step, 1:]
        up, down = (y0 <= py) & (y1 > py), (y1 <= py) & (y0 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = (x1 - x0) * (py - y0) / (y1 - y0) + x0 > px
        out[k : k + step] = np.count_nonzero(up & right, axis=1) - np.count_nonzero(down & right, axis=1)
    return out


class _Nodes:
    """Points by place: one within a unit of the last digit of an earlier one is that one. (Two edges round the point
    where they cross each for itself; if that gave two nodes, the loop through it would stay open.)"""

    def __init__(self, digits: int):
        self.scale = 10.0**digits
        self.exact: dict[tuple[float, float], tuple[float, float]] = {}
        self.cells: dict[tuple[int, int], list[tuple[int, int, tuple[float, float]]]] = {}

    def of(self, x: float, y: float) -> tuple[float, float]:
        if (x, y) not in self.exact:
            i, j = round(x * self.scale), round(y * self.scale)
            near = (n for di in (-1, 0, 1) for dj in (-1, 0, 1) for n in self.cells.get(((i >> 2) + di, (j >> 2) + dj), ()))
            known = next((p for a, b, p in near if abs(a - i) <= 1 and abs(b - j) <= 1), None)
            if known is None:
                known = (x, y)
                self.cells.setdefault((i >> 2, j >> 2), []).append((i, j, known))
            self.exact[x, y] = known
        return self.exact[x, y]


def _holes_apart(loop: list[int], nodes: list[tuple[float, float]]) -> list[list[int]]:
    """A traced loop, and by themselves the holes that touch it in a node: the trace runs through them."""
    if len(set(loop)) == len(loop):
        return [loop]
    held: list[int] = []
    out = []
    for n in loop:
        if n in held:
            part = held[held.index(n) :]
            if K.shoelace(np.array([nodes[i] for i in part])) < 0:
                out.append(part)
                del held[-len(part) :]
        held.append(n)
    return [held, *out]


def region_loops(regions: list[list[np.ndarray]], digits: int = 9) -> list[np.ndarray]:
    """The loops of the union of regions: outer ones anticlockwise, holes clockwise. A region of one ring is what the ring
    winds round at all (so a self-crossing one keeps all its parts), one of several rings what they wind round
    positively. Edges are cut where they meet; those with the union on one side only remain and are traced."""
    regions = [[np.round(np.asarray(r, float), digits) for r in region] for region in regions]
    rings = [r for region in regions for r in region]
    segments = [(tuple(p), tuple(q)) for r in rings for p, q in zip(r, np.roll(r, -1, axis=0)) if tuple(p) != tuple(q)]
    if not segments:
        return []
    a, b = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    d = b - a
    sizes = np.einsum("kc,kc->k", d, d)
    every = np.arange(len(segments))
    on, at = [every, every], [np.zeros(len(d)), np.ones(len(d))]  # the segments and where they are cut
    step = max(1, _AT_ONCE // len(segments))
    for k in range(0, len(segments), step):
        own, way, size = a[k : k + step, None], d[k : k + step, None], sizes[k : k + step, None]
        gap = a - own
        cross = way[..., 0] * d[:, 1] - way[..., 1] * d[:, 0]
        off = gap[..., 0] * way[..., 1] - gap[..., 1] * way[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[..., 0] * d[:, 1] - gap[..., 1] * d[:, 0]) / cross
            u = off / cross
        level = np.abs(cross) <= 1e-12
        line = level & (np.abs(off) <= 1e-9 * np.maximum(1.0, np.sqrt(size)))
        for held, place in ((~level & (u >= -1e-9) & (u <= 1 + 1e-9), t), *((line, np.einsum("kjc,kjc->kj", e - own, np.broadcast_to(way, gap.shape)) / size) for e in (a, b))):
            i, j = np.nonzero(held & (place > 0) & (place < 1))
            on.append(i + k)
            at.append(place[i, j])
    on, at = np.concatenate(on), np.concatenate(at)
    turn = np.lexsort((at, on))
    on, at = on[turn], at[turn]
    nodes = _Nodes(digits)
    for v in np.concatenate([a, b]).tolist():
        nodes.of(*v)
    cuts = [nodes.of(*v) for v in (np.round(a[on] + at[:, None] * d[on], digits) + 0.0).tolist()]
    pieces = {(p, q) for p, q, k, j in zip(cuts, cuts[1:], on.tolist(), on[1:].tolist()) if k == j and p != q}
    aside = 10.0 ** (-digits) * 20

    def inside(p: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([_windings(p, r[0]) != 0 if len(r) == 1 else sum(_windings(p, x) for x in r) > 0 for r in regions])

    if not pieces:
        return []
    ends = np.array(list(pieces))
    p, q = ends[:, 0], ends[:, 1]
    m, v = (p + q) / 2, q - p
    n = np.stack([-v[:, 1], v[:, 0]], axis=1) / np.hypot(v[:, 0], v[:, 1])[:, None] * aside
    left, right = inside(m + n), inside(m - n)
    keep = {(e if one else e[::-1]) for e, one, two in zip(pieces, left.tolist(), right.tolist()) if one != two}  # the union on the left
    nodes = sorted({p for e in keep for p in e})
    number = {p: i for i, p in enumerate(nodes)}
    leaving: dict[int, list[int]] = {}
    for p, q in sorted(keep):
        leaving.setdefault(number[p], []).append(number[q])
    loops = []
    for first in sorted(leaving):
        while leaving.get(first):
            at, loop = first, []
            while leaving.get(at):
                loop.append(at)
                at = leaving[at].pop(0)
                if at == first:
                    break
            loops += [np.array([nodes[i] for i in part]) for part in _holes_apart(loop, nodes) if len(part) > 2]
    return [straightened(r) for r in loops]


def straightened(ring: np.ndarray) -> np.ndarray:
    """A ring without the points that don't bend it."""
    prev, nxt = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
    bend = np.abs((ring[:, 0] - prev[:, 0]) * (nxt[:, 1] - ring[:, 1]) - (ring[:, 1] - prev[:, 1]) * (nxt[:, 0] - ring[:, 0])) > 1e-12
    return ring[bend]


def offset(loop: np.ndarray, width: float, bevel: bool = False) -> np.ndarray:
    """A loop with its region on the left, moved outwards by a width (inwards by a negative one): edges shift, corners
    are where shifted edges meet. Sharp corners, and with bevel those that the shift opens, are cut off."""
    d = np.roll(loop, -1, axis=0) - loop
    d /= np.hypot(d[:, 0], d[:, 1])[:, None]
    out = np.stack([d[:, 1], -d[:, 0]], axis=1) * width
    points = []
    for k in range(len(loop)):
        before, after = d[k - 1], d[k]
        cross, dot = before[0] * after[1] - before[1] * after[0], before @ after
        if dot < -0.5 or bevel and cross * width > 0:
            points += [loop[k] + out[k - 1], loop[k] + out[k]]
        else:
            points.append(loop[k] + (out[k - 1] + out[k]) / (1 + dot))
    return np.array(points)


def union_outline(rings: list[np.ndarray], closing: float = CLOSING) -> tuple[np.ndarray, int]:
    """Outer ring of the largest part of a union, and how many parts there are. Parts that touch in a point, or over a
    gap of less than twice the closing width, are one: all are grown by that width and shrunk again."""
    loops = region_loops([[r] for r in rings])
    outer = [r for r in loops if K.shoelace(r) > 0]
    for bevel in (False, True):
        if len(outer) > 1 and closing:
            grown = region_loops([[offset(r, closing) for r in loops]])
            closed = [r for r in region_loops([[*(offset(r, -closing, bevel) for r in grown), _NOTHING]]) if len(r) > 2]
            parts = [r for r in closed if K.shoelace(r) > 0]
            if 0 < len(parts) < len(outer):
                outer = parts
    if not outer:
        return np.zeros((0, 2)), 0
    return max(outer, key=K.shoelace), len(outer)


def unions(groups: DataFrame) -> DataFrame:
    """groups(map_id, rings: arrays of points) -> map_id, points, parts: the largest part's outer ring; holes and
    other parts go."""

    def kernel(row: dict) -> Iterator[dict]:
        ring, parts = union_outline([np.array([[p["x"], p["y"]] for p in r]) for r in row["rings"] if len(r) > 2])
        yield {"points": [{"x": float(x), "y": float(y)} for x, y in ring], "parts": parts}

    return per_map(spread(groups, "map_id"), kernel, "points array<struct<x:double,y:double>>, parts int")
