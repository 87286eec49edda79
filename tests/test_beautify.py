"""Plain contours: sight, paths of fewest turns, overlaps and doorways, against brute force."""

from collections import Counter

import numpy as np
import pytest

from gridloom.operators import beautify as B
from gridloom.operators import kernels as K


def plain_clear(free, p, q):
    return not any(free[y, x] for x, y in K.bresenham(*p, *q))


def test_sight_and_dropped_vertices():
    rng = np.random.default_rng(0)
    for _ in range(150):
        free = rng.random((15, 18)) < rng.choice([0.05, 0.2, 0.5])
        sight = B.Sight(free)
        points = [(int(rng.integers(0, 18)), int(rng.integers(0, 15))) for _ in range(rng.integers(1, 12))]
        assert all(sight.clear(p, q) == plain_clear(free, p, q) for p in points for q in points)
        out = [points[0]]
        for i in range(1, len(points) + 1):
            if not plain_clear(free, out[-1], points[i % len(points)]):
                out.append(points[i - 1])
        assert B.dropped(points, sight) == out


def plain_turns(closed, p, q):
    """Fewest turns by a search over (pixel, direction) within the box."""
    x0, x1, y0, y1 = min(p[0], q[0]), max(p[0], q[0]), min(p[1], q[1]), max(p[1], q[1])
    if p == q:
        return 0
    best = {}
    todo = [(0, p, None)]
    while todo:
        todo.sort(key=lambda t: t[0])
        turns, at, came = todo.pop(0)
        if best.get((at, came), 99) <= turns:
            continue
        best[at, came] = turns
        for d in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            to = at[0] + d[0], at[1] + d[1]
            if x0 <= to[0] <= x1 and y0 <= to[1] <= y1 and closed[to[1], to[0]]:
                todo.append((turns + (came is not None and came != d), to, d))
    return min((t for (at, _), t in best.items() if at == q), default=None)


def test_fewest_turns():
    rng = np.random.default_rng(1)
    found = Counter()
    for _ in range(400):
        closed = rng.random((8, 9)) < rng.choice([0.5, 0.7, 0.9])
        p, q = ((int(rng.integers(0, 9)), int(rng.integers(0, 8))) for _ in range(2))
        closed[p[1], p[0]] = closed[q[1], q[0]] = True
        want, path = plain_turns(closed, p, q), B.least_turns(closed, p, q)
        found[want] += 1
        if want is None:
            assert path is None
            continue
        assert path[0] == p and path[-1] == q
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(path, path[1:])) or p == q
        assert all(closed[y, x] for a, b in zip(path, path[1:]) for x, y in K.bresenham(*a, *b))
        if p != q:
            assert len(path) - 2 == want
    assert len(found) > 4  # none, straight, one turn, two and more


def test_aligned_edges():
    free = np.zeros((20, 20), bool)
    triangle = [(2, 2), (15, 2), (2, 15)]
    got = B.aligned(triangle, B.Sight(free))
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(got, got[1:])) and set(triangle) <= set(got)
    free[2, 6] = True  # the first corner's way is blocked
    assert B.aligned([(2, 2), (9, 9)], B.Sight(free))[1] == (2, 9)


@pytest.mark.parametrize("ring", [[(20, 20), (80, 20), (80, 80), (20, 80)], [(20, 20), (50, 20), (80, 20), (80, 80), (20, 80), (20, 50)]])
def test_rectangle(ring):
    free = np.zeros((100, 100), bool)
    free[20:80, 20:80] = True
    xy = B._border(ring)
    free[xy[:, 1], xy[:, 0]] = False
    sight = B.Sight(free)
    once = B.plain(ring, sight)
    assert {(20, 20), (80, 20), (80, 80), (20, 80)} == set(once)
    assert set(B.plain(once, sight)) == set(once)


def test_plain_contours_settle():
    """Ragged contours come out level and upright and stay as they are when made plain again."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        mask = np.zeros((40, 40), bool)
        mask[6:32, 6:32] = True
        for _ in range(14):
            y, x = rng.integers(4, 33, 2)
            mask[y : y + 3, x : x + 3] = rng.random() < 0.5
        mask = K.filled(K.components(mask) == 1)
        ring = [(int(x), int(y)) for x, y in K.outer_contour(mask)]
        free = mask.copy()
        xy = B._border(ring)
        free[xy[:, 1], xy[:, 0]] = False
        sight = B.Sight(free)
        got = B.plain(ring, sight, rounds=20)
        assert all(sight.clear(p, q) for p, q in zip(got, [*got[1:], got[0]]))
        assert all(p[0] == q[0] or p[1] == q[1] for p, q in zip(got, [*got[1:], got[0]]))
        assert set(B.plain(got, sight, rounds=20)) == set(got)


def area(points):
    return abs(K.shoelace(np.array(points)))


def test_overlaps_by_pixels():
    """Two boxes that overlap without cutting one apart: interiors are apart, the areas add up to the union's."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(200):
        rings = []
        for _ in range(2):
            x, y = (int(v) for v in rng.integers(0, 30, 2))
            w, h = (int(v) for v in rng.integers(4, 25, 2))
            rings.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        cells = [np.zeros((60, 60), bool) for _ in rings]
        for c, r in zip(cells, rings):
            c[r[0][1] : r[2][1], r[0][0] : r[2][0]] = True  # unit squares between pixels
        rest = cells[1] & ~cells[0]
        if not (cells[0] & cells[1]).any() or not rest.any() or K.components(rest, corners=False).max() != 1 or K.components(~rest, corners=False).max() != 1:
            continue
        met += 1
        first, second = B.without_overlaps(rings)
        assert area(first) == cells[0].sum() and area(second) == rest.sum()
        assert np.array_equal(K.fill_polygon(np.array(second), 60, 60), rest)
    assert met > 20
    apart = [[(0, 0), (5, 0), (5, 5), (0, 5)], [(20, 20), (25, 20), (25, 25), (20, 25)], []]
    assert B.without_overlaps(apart) == apart


def plain_doorways(points, free):
    """The doorways of one border, walked by hand."""
    chain = [c for p, q in zip(points, [*points[1:], points[0]]) for c in K.bresenham(*p, *q)[:-1]]
    n = len(chain)
    open_ = [bool(free[y, x]) for x, y in chain]
    open_ = [open_[i] or open_[i - 1] and open_[(i + 1) % n] for i in range(n)]
    starts = [i for i in range(n) if open_[i] and not open_[i - 1]]
    runs = []
    for s in starts or ([0] if open_[0] else []):
        run = []
        while len(run) < n and open_[(s + len(run)) % n]:
            run.append(chain[(s + len(run)) % n])
        runs.append(run)
    out = []
    for run in runs:
        line = B.without_collinear(run) if len(run) > 2 else run
        out += [(*a, *b) for a, b in zip(line, line[1:])]
    return Counter(out)


def test_doorways(spark):
    rng = np.random.default_rng(6)
    maps, rings, want = [], [], {}
    for m in range(12):
        free = rng.random((20, 24)) < rng.choice([0.0, 0.3, 0.6, 0.9, 1.0])
        x, y, w, h = (int(v) for v in (*rng.integers(0, 8, 2), *rng.integers(2, 11, 2)))
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if m % 3 else [(x, y), (x + w, y), (x + w, y + h), (x + 1, y + h), (x + 1, y + 1), (x, y + 1)]
        maps += [(m, int(a), int(b)) for a, b in zip(*np.nonzero(free))]
        rings.append((m, m * 10, [{"x": a, "y": b} for a, b in ring]))
        want[m] = plain_doorways(ring, free)
    rows = spark.createDataFrame(rings, "map_id int, pos int, points array<struct<x:int,y:int>>")
    got = B.doorways(rows, spark.createDataFrame(maps, "map_id int, y int, x int")).collect()
    for m in range(12):
        own = sorted((r for r in got if r.map_id == m), key=lambda r: r.seg_id)
        assert Counter((r.x1, r.y1, r.x2, r.y2) for r in own) == want[m] and [r.seg_id for r in own] == list(range(len(own)))


def test_beautified_maps(spark):
    img = np.full((100, 100), 127, np.uint8)
    img[20:80, 20:80] = 255
    ring = [{"x": x, "y": y} for x, y in ((20, 20), (80, 20), (80, 80), (20, 80))]
    maps = spark.createDataFrame([(1, 100, 100, img.tobytes()), (2, 100, 100, img.tobytes())], "map_id int, h int, w int, data binary")
    rooms = spark.createDataFrame([(1, 0, ring), (1, 1, []), (2, 5, ring[:2])], "map_id int, pos int, points array<struct<x:int,y:int>>")
    got = {(r.map_id, r.pos): [(p.x, p.y) for p in r.points] for r in B.beautified(maps, rooms).collect()}
    assert set(got) == {(1, 0), (2, 5)} and {(20, 20), (80, 80)} <= set(got[1, 0]) and abs(area(got[1, 0])) == 3600
    assert B.beautified(maps, rooms.limit(0)).count() == 0


def test_merged_doorways(spark):
    doors = spark.createDataFrame([(1, 0, 0, 0, 5, 10, 5), (1, 0, 1, 12, 5, 20, 5), (1, 1, 0, 22, 5, 30, 5), (1, 0, 2, 20, 5, 20, 9)], "map_id int, pos int, seg_id int, x1 int, y1 int, x2 int, y2 int")
    got = {tuple(r) for r in B.merged_doorways(doors).collect()}
    assert got == {(1, 0, 0, 0, 5, 20, 5), (1, 1, 0, 22, 5, 30, 5), (1, 0, 2, 20, 5, 20, 9)}
