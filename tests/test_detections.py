"""Detections of whole tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from gridloom.operators import detections as D
from gridloom.plans import catalogue
from gridloom.sources import seed

SMALL = "/root/testdata/sf0.001"


def test_detections_of_all_line_items(spark):
    """Every line item takes part; survivors equal plain greedy suppression of axis-aligned boxes."""
    maps = defaultdict(list)
    turn = Counter()
    for r in sorted(seed.table(spark, SMALL, "lineitem").collect(), key=lambda r: (r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity)):
        turn[r.l_orderkey] += 1
        k = r.l_orderkey * 1000 + turn[r.l_orderkey]
        conf = k * 7919 % 100003 / 100003
        if conf >= 0.1:
            cx, cy, w, h = r.l_partkey * 13 % 300, r.l_suppkey * 29 % 200, float(10 + r.l_quantity), float(6 + r.l_quantity / 2)
            maps[r.l_orderkey // 16].append((-conf, k, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2))
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    meet = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    assert sum(turn.values()) == 6000
    want = set()
    for m, boxes in maps.items():
        kept = []
        for b in sorted(boxes):
            if all(meet(a, b) / (area(a) + area(b) - meet(a, b)) < 0.35 for a in kept):
                kept.append(b)
        want |= {(m, b[1]) for b in kept}
    assert {r.det_id for r in catalogue.QUERIES["obb_decode"](spark, SMALL).collect()} == {b[1] for boxes in maps.values() for b in boxes}
    assert {tuple(r) for r in catalogue.QUERIES["nms_keep"](spark, SMALL).collect()} == want


def plain_clip(a, b):
    """Area of the intersection of two convex polygons, edge by edge of the second."""
    area = lambda p: sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in range(len(p))) / 2
    if area(a) == 0 or area(b) == 0:
        return 0.0
    b = b[::-1] if area(b) < 0 else b
    for (x0, y0), (x1, y1) in zip(b, b[1:] + b[:1]):
        side = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in a]
        now = []
        for k, (p, s) in enumerate(zip(a, side)):
            q, t = a[(k + 1) % len(a)], side[(k + 1) % len(a)]
            if s >= 0:
                now.append(p)
            if (s >= 0) != (t >= 0):
                now.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        a = now
        if len(a) < 3:
            return 0.0
    return abs(area(a))


def rectangle(cx, cy, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + x * w / 2 * c - y * h / 2 * s, cy + x * w / 2 * s + y * h / 2 * c) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_clip_areas():
    """Random, equal, touching, nested, shifted, wound either way and degenerate boxes against the plain version."""
    rng = random.Random(3)
    some = lambda: rectangle(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(1, 50), rng.uniform(1, 30), rng.choice((0, math.pi / 2, rng.uniform(0, 7))))
    pairs = [(some(), some()) for _ in range(3000)]
    for angle in (0.0, 0.3, 2.0):
        a = rectangle(100, 50, 20, 10, angle)
        along = lambda t, w=20, h=10: rectangle(100 + t * math.cos(angle), 50 + t * math.sin(angle), w, h, angle)
        pairs += [(a, a), (a, a[::-1]), (a, a[2:] + a[:2]), (a, along(5)), (a, along(20)), (a, along(30)), (a, along(0, 10, 5)), (a, along(5, 10, 10)), (along(0, 10, 5), a), (a, along(0, 0, 10)), (a, rectangle(100, 50, 20, 10, angle + math.pi))]
    got = D.clip_areas(np.array([p for p, _ in pairs]), np.array([q for _, q in pairs]))
    want = [plain_clip(p, q) for p, q in pairs]
    assert np.allclose(got, want, atol=1e-6), [(g, w) for g, w in zip(got, want) if abs(g - w) > 1e-6][:5]


def test_turned_detections(spark):
    """Pairs and survivors of turned boxes equal plain ones over all pairs of a map."""
    boxes = D.decoded(seed.detections(spark, SMALL, turned=True))
    maps = defaultdict(list)
    for r in boxes.collect():
        maps[r.map_id].append((-r.conf, r.det_id, [(p.x, p.y) for p in r.v]))
    pairs, kept = {}, set()
    size = lambda v: plain_clip(v, v)
    for m, held in maps.items():
        held.sort()
        gone = set()
        for i, (_, a, v) in enumerate(held):
            for _, b, u in held[i + 1 :]:
                shared = plain_clip(v, u)
                if shared > 0:
                    pairs[m, a, b] = shared / (size(v) + size(u) - shared)
        for i, (_, a, _) in enumerate(held):
            if a not in gone:
                kept.add((m, a))
                gone |= {b for _, b, _ in held[i + 1 :] if pairs.get((m, a, b), 0) >= 0.35}
    got = {(r.map_id, r.a, r.b): r.iou for r in catalogue.QUERIES["iou_pairs_turned"](spark, SMALL).collect()}
    big = {k for k, v in pairs.items() if v > 1e-5}
    assert big <= set(got) and all(abs(got[k] - pairs.get(k, 0)) < 1e-5 for k in got)
    assert {tuple(r) for r in catalogue.QUERIES["nms_keep_turned"](spark, SMALL).collect()} == kept


def boxes_of(spark, rows):
    """rows of (map_id, det_id, conf, x, y, w, h) as detections."""
    corners = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return spark.createDataFrame([(m, i, corners(*box), c) for m, i, c, *box in rows], "map_id int, det_id string, v array<struct<x:double,y:double>>, conf double")


def test_pairs_are_met_by_a_sweep(spark):
    """One deal of the boxes, no join of pairs; equal to all pairs, also where a tile's boxes come in many batches."""
    rng = random.Random(5)
    rows = [(rng.randrange(3), f"d{k:03}", rng.choice([0.2, 0.5, 0.9]), float(rng.randrange(-300, 600)), float(rng.randrange(-40, 300)), float(rng.randrange(1, 90)), float(rng.randrange(1, 90))) for k in range(300)]
    found = D.iou_pairs(boxes_of(spark, rows))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for m, i, c, x, y, w, h in rows:
        for n, j, d, s, t, u, v in rows:
            if m == n and (-c, i) < (-d, j) and max(x, s) <= min(x + w, s + u) and max(y, t) <= min(y + h, t + v):
                both = (min(x + w, s + u) - max(x, s)) * (min(y + h, t + v) - max(y, t))
                want[m, i, j] = round(both / (w * h + u * v - both), 6)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("10000", "7"):
        spark.conf.set(key, size)
        try:
            got = [(r.map_id, r.a, r.b, round(r.iou, 6)) for r in found.collect()]
        finally:
            spark.conf.unset(key)
        assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want


def test_many_pairs_are_compared_piece_by_piece(monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 5)
    rng = np.random.default_rng(2)
    g, l = np.sort(rng.integers(0, 4, 60)), rng.integers(0, 20, 60).astype(float)  # noqa: E741
    r = l + rng.integers(0, 6, 60)
    got = [(int(i), int(j)) for a, b in D._near(g, l, r) for i, j in zip(a, b)]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if g[i] == g[j] and l[i] <= r[j] and l[j] <= r[i]]


def test_boxes_that_share_an_id_are_judged_each(spark):
    """The first x goes before y, which is removed by it; the second x overlaps only y, so it stays; the third falls."""
    rows = [(1, "x", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "y", 0.7, 2.0, 0.0, 10.0, 10.0), (1, "x", 0.5, 6.0, 0.0, 10.0, 10.0), (1, "z", 0.8, 100.0, 0.0, 10.0, 10.0), (1, "x", 0.4, 101.0, 0.0, 10.0, 10.0)]
    kept = {(r.det_id, r.conf) for r in D.suppressed(boxes_of(spark, rows)).collect()}
    assert kept == {("x", 0.9), ("x", 0.5), ("z", 0.8)}
