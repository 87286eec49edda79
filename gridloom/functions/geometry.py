"""Column functions: pixel and world coordinates, flat geometries, polygons, oriented boxes.

Points are structs (x, y); a geometry is a flat closed array [x0, y0, ..., x0, y0] in metres, three decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half a cell at the usual resolution, applied at every resolution.
OFFSET = 0.025


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, their columns computed once: later expressions aren't merged with earlier ones."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_row")).select("_row.*")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def pixel_to_world(px: Column, py: Column, resolution: Column, ox: Column, oy: Column, height: Column, offset: float = OFFSET) -> Column:
    return point(F.round(px * resolution + ox + offset, 3), F.round((height - py - 1) * resolution + oy - offset, 3))


def half_away(v: Column) -> Column:
    """Rounded to whole, halves away from zero."""
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5)).cast("int")


def world_to_pixel(wx: Column, wy: Column, resolution: Column, ox: Column, oy: Column, height: Column, offset: float = OFFSET) -> Column:
    return point(half_away((wx - ox - offset) / resolution), half_away(height - 1 - (wy - oy + offset) / resolution))


def points_of(geometry: Column) -> Column:
    """Flat array -> array of points."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(geometry).cast("int") / 2 - 1, F.lit(0)).cast("int")), lambda i: point(F.get(geometry, 2 * i), F.get(geometry, 2 * i + 1)))


def flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def ring(points: Column, within: float = 0.0) -> Column:
    """Without a last point equal to the first, or within a distance of it along both axes."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    same = (F.abs(first["x"] - last["x"]) < within) & (F.abs(first["y"] - last["y"]) < within) if within else first == last
    return F.when((F.size(points) > 1) & same, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def closed(points: Column) -> Column:
    """With the first point again at the end, unless it is there."""
    return F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def twice_area(points: Column) -> Column:
    """Twice the signed shoelace sum of a ring."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: bind(F.get(points, (i + 1) % n), lambda q: p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"]))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def polygon_area(points: Column) -> Column:
    return F.abs(twice_area(points)) / 2


def is_clockwise(points: Column) -> Column:
    return twice_area(points) < 0


def contour_to_geometry(points: Column, resolution: Column, ox: Column, oy: Column, height: Column, clockwise: bool = True) -> Column:
    """Pixel contour -> flat closed geometry; repeated vertices keep their first place, winding is as asked."""
    world = F.array_distinct(F.transform(points, lambda p: pixel_to_world(p["x"], p["y"], resolution, ox, oy, height)))
    turned = bind(world, lambda w: F.when(is_clockwise(w) == F.lit(clockwise), w).otherwise(F.reverse(w)))
    return bind(turned, lambda w: flat(F.concat(w, F.slice(w, 1, 1))))


def geometry_to_contour(geometry: Column, resolution: Column, ox: Column, oy: Column, height: Column) -> Column:
    """Flat geometry -> pixel contour without repeated vertices (the closing one goes too)."""
    return F.array_distinct(F.transform(points_of(geometry), lambda p: world_to_pixel(p["x"], p["y"], resolution, ox, oy, height)))


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to the nearest point of a segment; of a segment without length, to its point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def distance_to_polygon(px: Column, py: Column, points: Column) -> Column:
    n = F.size(points)
    return F.array_min(F.transform(points, lambda p, i: bind(F.get(points, (i + 1) % n), lambda q: distance_to_segment(px, py, p["x"], p["y"], q["x"], q["y"]))))


def inside_polygon(px: Column, py: Column, points: Column) -> Column:
    """Even-odd rule."""
    n = F.size(points)

    def crosses(p: Column, q: Column) -> Column:
        spans = (p["y"] > py) != (q["y"] > py)
        return F.when(spans & (px < (q["x"] - p["x"]) * (py - p["y"]) / F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    hits = F.transform(points, lambda p, i: bind(F.get(points, (i + 1) % n), lambda q: crosses(p, q)))
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h) % 2 == 1


def without_collinear(points: Column) -> Column:
    """A line's points without repeats of the one before and without those that lie on a straight line with both
    neighbours; the ends stay. Fewer than three points stay as they are."""
    single = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))

    def bends(u: Column) -> Column:
        def keep(p: Column, i: Column) -> Column:
            a, b = F.get(u, i - 1), F.get(u, i + 1)
            cross = (p["x"] - a["x"]) * (b["y"] - a["y"]) - (p["y"] - a["y"]) * (b["x"] - a["x"])
            return (i == 0) | (i == F.size(u) - 1) | (cross != 0)

        return F.filter(u, keep)

    return F.when(F.size(points) < 3, points).otherwise(bind(single, bends))


def segment_class(dx: Column, dy: Column) -> Column:
    """'H' under one degree, 'V' over 89, else 'D'."""
    angle = F.degrees(F.atan2(F.abs(dy), F.abs(dx)))
    return F.when(angle < 1, "H").when(angle > 89, "V").otherwise("D")


def segment_offset(kind: Column, dx: Column, dy: Column, sign: Column, distance: int = 1) -> Column:
    """Whole-pixel step outward from a segment of a ring whose winding has the given sign."""
    one = lambda v: F.signum(v).cast("int")
    ox = F.when(kind == "H", 0).otherwise(one(dy))
    oy = F.when(kind == "V", 0).otherwise(-one(dx))
    return point((ox * sign * distance).cast("int"), (oy * sign * distance).cast("int"))


def box_vertices(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Corners of a rotated box: (-,-), (+,-), (+,+), (-,+) before rotation."""
    c, s = F.cos(angle), F.sin(angle)
    corner = lambda sx, sy: point(cx + sx * w / 2 * c - sy * h / 2 * s, cy + sx * w / 2 * s + sy * h / 2 * c)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def box_centerline(v: Column) -> Column:
    """Line between the midpoints of a box's shortest edge (the first of equals) and the opposite one, in single
    precision; null for a degenerate box."""
    f = lambda c: c.cast("float")
    at = lambda i: F.get(v, F.lit(i % 4))
    length = [F.hypot(f(at(i)["x"]) - f(at(i + 1)["x"]), f(at(i)["y"]) - f(at(i + 1)["y"])) for i in range(4)]
    best = F.array_min(F.array(*[F.struct(length[i].alias("d"), F.lit(i).alias("i")) for i in range(4)]))["i"]
    middle = lambda i: point(f((f(at(i)["x"]) + f(at(i + 1)["x"])) / F.lit(2.0).cast("float")), f((f(at(i)["y"]) + f(at(i + 1)["y"])) / F.lit(2.0).cast("float")))
    line = F.when(best % 2 == 0, F.array(middle(0), middle(2))).otherwise(F.array(middle(1), middle(3)))
    line = F.when((best == 2) | (best == 3), F.reverse(line)).otherwise(line)
    return F.when(line[0] != line[1], line)


def letterbox(w: Column, h: Column, target_w: int, target_h: int, least: int = 416) -> Column:
    """Scale and padding that fit a map into the model's input: small maps are centred in a square first."""
    small = (w < least) & (h < least)
    px, py = F.when(small, F.floor((least - w) / 2)).otherwise(0).cast("int"), F.when(small, F.floor((least - h) / 2)).otherwise(0).cast("int")
    pw, ph = F.when(small, least).otherwise(w), F.when(small, least).otherwise(h)
    scale = F.least(F.lit(float(target_w)) / pw, F.lit(float(target_h)) / ph)
    nw, nh = F.bround(pw * scale).cast("int"), F.bround(ph * scale).cast("int")
    return F.struct(px.alias("pre_x"), py.alias("pre_y"), scale.alias("scale"), nw.alias("w"), nh.alias("h"), F.floor((target_w - nw) / 2).cast("int").alias("pad_x"), F.floor((target_h - nh) / 2).cast("int").alias("pad_y"))


def un_letterbox(v: Column, box: Column) -> Column:
    """A model-space value's points back in map pixels."""
    return F.transform(v, lambda p: point((p["x"] - box["pad_x"]) / box["scale"] - box["pre_x"], (p["y"] - box["pad_y"]) / box["scale"] - box["pre_y"]))


def cut_line(ax: Column, ay: Column, bx: Column, by: Column, points: Column) -> Column:
    """The line through A and B, long enough to cross the polygon; null if A and B coincide."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    reach = F.greatest(4 * F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)), F.lit(10.0))
    size = F.hypot(bx - ax, by - ay)
    ux, uy = (bx - ax) / size, (by - ay) / size
    return F.when(size >= 1e-8, F.array(point(ax - ux * reach, ay - uy * reach), point(bx + ux * reach, by + uy * reach)))


def line_crossings(ax: Column, ay: Column, bx: Column, by: Column, points: Column) -> Column:
    """Where the line through A and B meets a ring's edges, by position along it: structs (t, edge, x, y). An edge
    counts its first end, not its last."""
    n = F.size(points)
    ux, uy = bx - ax, by - ay

    def side(p: Column) -> Column:
        return ux * (p["y"] - ay) - uy * (p["x"] - ax)

    def meet(p: Column, i: Column) -> Column:
        def cut(q: Column) -> Column:
            s = side(p) / (side(p) - side(q))
            x, y = p["x"] + s * (q["x"] - p["x"]), p["y"] + s * (q["y"] - p["y"])
            t = ((x - ax) * ux + (y - ay) * uy) / (ux * ux + uy * uy)
            return F.when((side(p) >= 0) != (side(q) >= 0), F.struct(t.alias("t"), i.alias("edge"), x.alias("x"), y.alias("y")))

        return bind(F.get(points, (i + 1) % n), cut)

    return F.array_sort(F.array_compact(F.transform(points, meet)))
