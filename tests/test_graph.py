"""Colours and walking order of the seed maps' rooms against plain versions; landmarks' places."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import kernels as K
from gridloom.plans import catalogue
from gridloom.plans.catalogue import _graph

SMALL = "/root/testdata/sf0.001"


def graphs(spark):
    nodes, edges = _graph(spark, SMALL)
    out = defaultdict(dict)
    for r in nodes.collect():
        out[r.map_id][r.pos] = set()
    for r in edges.collect():
        out[r.map_id][r.i].add(r.j)
        out[r.map_id][r.j].add(r.i)
    return out


def test_colors_and_walks(spark):
    held = graphs(spark)
    assert len(held) == 25 and all(len(g) > 1 for g in held.values())
    colors, ranks = defaultdict(dict), defaultdict(dict)
    for r in catalogue.QUERIES["room_colors"](spark, SMALL).collect():
        colors[r.map_id][r.pos] = r.color
    for r in catalogue.QUERIES["walk_order"](spark, SMALL).collect():
        ranks[r.map_id][r.pos] = r.rank
    for m, g in held.items():
        want = {}
        for room in sorted(g, key=lambda v: (len(g[v]), v)):
            taken = [want[v] for v in g[room] if v in want]
            free = [c for c in range(5) if c not in taken]
            hits = [taken.count(c) for c in range(5)]
            least = [c for c in range(5) if hits[c] == min(hits)]
            want[room] = free[0] if free else least[room % len(least)]
        clash = any(want[a] == want[b] for a in g for b in g[a])
        assert set(colors[m]) == set(g) and set(colors[m].values()) <= set(range(5))
        if not clash:
            assert colors[m] == want
            assert all(colors[m][a] != colors[m][b] for a in g for b in g[a])

        order = []

        def walk(v):
            if v not in order:
                order.append(v)
                for u in sorted(g[v], key=lambda u: (-len(g[u]), u)):
                    walk(u)

        for v in sorted(g, key=lambda v: (-len(g[v]), v)):
            walk(v)
        assert [k for k, _ in sorted(ranks[m].items(), key=lambda p: p[1])] == order


def test_clearest_point_as_columns(spark):
    """The kernel's inside and distance are the column functions'; a grid without a valid point gives none."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(20):
        angle = np.sort(rng.uniform(0, 6.28, 7))
        ring = [(float(a), float(b)) for a, b in zip(np.cos(angle) * rng.uniform(1, 3, 7), np.sin(angle) * rng.uniform(1, 3, 7))]
        table = [(0.1, 0.1), (0.5, 0.1), (0.5, 0.5), (0.1, 0.5)]
        at = K.clearest_point(ring, [table, []], 0.05, 21)
        if at is not None:
            rows.append((k, ring, table, *at))
    assert len(rows) > 10
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"k int, ring {kind}, other {kind}, x double, y double")
    steps = F.sequence(F.lit(0), F.lit(20))
    low = lambda f: F.array_min(F.transform("ring", lambda q: q[f]))
    high = lambda f: F.array_max(F.transform("ring", lambda q: q[f]))
    cells = df.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    cells = G.settled(cells.withColumns({"gx": low("x") + (high("x") - low("x")) * F.col("i") / 20, "gy": low("y") + (high("y") - low("y")) * F.col("j") / 20}))
    far = lambda ring: G.distance_to_polygon(F.col("gx"), F.col("gy"), F.col(ring))
    cells = cells.where(G.inside_polygon(F.col("gx"), F.col("gy"), F.col("ring")) & ~G.inside_polygon(F.col("gx"), F.col("gy"), F.col("other")) & (far("ring") > 0.05) & (far("other") > 0.05))
    want = cells.groupBy("k", "x", "y").agg(F.max_by(F.struct("gx", "gy"), F.struct(F.round(far("ring"), 9), -F.col("i"), -F.col("j"))).alias("b")).collect()
    assert len(want) == len(rows)
    assert all(abs(r.x - r.b.gx) < 1e-9 and abs(r.y - r.b.gy) < 1e-9 for r in want)
    assert K.clearest_point([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [[(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]], 0.05, 21) is None
    assert K.clearest_point([], [], 0.05, 21) is None and K.clearest_point([(0.0, 0.0)] * 3, [], 0.05, 21) is None
