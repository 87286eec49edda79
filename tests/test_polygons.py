"""Final polygons, bridged pieces, expansion and line clean-up against plain versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import detections as D
from gridloom.operators import kernels as K
from gridloom.operators import regions as RG
from gridloom.plans.requests import contour_mask


def plain_fill(mask):
    """Background that reaches the outside by its four sides stays out."""
    big = np.pad(mask, 1)
    out, todo = {(0, 0)}, [(0, 0)]
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if p not in out and 0 <= p[0] < big.shape[0] and 0 <= p[1] < big.shape[1] and not big[p]:
                out.add(p)
                todo.append(p)
    return np.array([[(y + 1, x + 1) not in out for x in range(mask.shape[1])] for y in range(mask.shape[0])])


@settings(max_examples=150, deadline=None)
@given(hnp.arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9))))
def test_filled_and_contour(mask):
    labels = K.components(mask)
    for c in range(1, labels.max() + 1):
        own = labels == c
        assert (K.filled(own) == plain_fill(own)).all()
        ring = K.outer_contour(own)
        if len(ring) > 2:
            assert (contour_mask([tuple(p) for p in ring.tolist()], *own.shape) == plain_fill(own)).all()


def plain_close(mask, size):
    r = size // 2
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round((r * r - dy * dy) ** 0.5)]
    h, w = mask.shape
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    grown = {(y + dy, x + dx) for y, x in np.argwhere(mask).tolist() for dy, dx in disc if inside(y + dy, x + dx)}
    return np.array([[all((y + dy, x + dx) in grown for dy, dx in disc if inside(y + dy, x + dx)) for x in range(w)] for y in range(h)])


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12))), st.sampled_from((3, 5, 7)))
def test_close_disc(mask, size):
    assert (K.close_disc(mask, size) == plain_close(mask, size)).all()


def test_bridged_pieces():
    near = np.zeros((20, 30), bool)
    near[5:15, 5:12] = near[5:15, 14:20] = True  # two columns apart
    one = K.bridged(near)
    assert K.components(one).max() == 1 and (one | ~near).all() and one[10, 12] and one[10, 13]
    far = np.zeros((10, 90), bool)
    far[2:8, 2:8], far[2:8, 70:85] = True, True
    assert not K.bridged(far)[:, :50].any() and K.bridged(far)[2:8, 70:85].all()


def test_final_polygons(spark):
    img = np.zeros((24, 24), np.uint8)
    img[4:20, 4:20] = 255
    img[4:20, 12] = 0
    img[10, 12] = 255  # free, in no label: joins the room that is nearest
    labels = np.zeros((24, 24), np.int32)
    labels[4:20, 4:12], labels[4:20, 13:20] = 1, 2
    labels[8, 8] = 0  # a hole
    settled = K.settled_labels(img, labels)
    assert settled[8, 8] == 1 and settled[10, 12] == 1 and (settled[4:20, 13:20] == 2).all()
    rows = [(1, 24, 24, bytearray(img.tobytes()), bytearray(labels.astype("<i4").tobytes()))]
    both = spark.createDataFrame(rows, "map_id int, h int, w int, data binary, labels binary")
    got = {r.lid: [(p.x, p.y) for p in r.points] for r in RG.final_polygons(both.drop("labels"), both.drop("data")).collect()}
    assert set(got) == {1, 2}
    two = contour_mask(got[2], 24, 24)
    want = np.zeros((24, 24), bool)
    want[4:21, 13:21] = True  # lattice corners as pixels
    want[3, 13:21] = True  # a wall above, beyond steps that touch free space
    want[4:21, 12] = True
    want[10, 12] = False  # free
    assert (two[3] == want[3]).all() and (two[:, 20] == want[:, 20]).all() and two[5:9, 12].all() and not two[:3].any() and not two[21:].any()
    assert (two | ~(labels == 2)).all()


def test_line_clean_up(spark):
    points = lambda *ps: [{"x": x, "y": y} for x, y in ps]
    cases = [(1, points((0, 0), (0, 0), (1, 0), (2, 0), (2, 0), (2, 3), (2, 5))), (2, points((0, 0), (0, 0))), (3, []), (4, None), (5, points((0, 0), (4, 0), (0, 0)))]
    got = {r.id: r.p and [tuple(q) for q in r.p] for r in spark.createDataFrame(cases, "id int, p array<struct<x:int,y:int>>").select("id", G.without_collinear(F.col("p")).alias("p")).collect()}
    assert got == {1: [(0, 0), (2, 0), (2, 5)], 2: [(0, 0), (0, 0)], 3: [], 4: None, 5: [(0, 0), (0, 0)]}
    lines = [(1, 0, 0, 5, 10, 5), (1, 1, 20, 5, 12, 5), (1, 2, 23, 5, 30, 5), (1, 3, 2, 5, 4, 5), (1, 4, 7, 0, 7, 4), (1, 5, 7, 8, 7, 6), (1, 6, 0, 0, 3, 3), (2, 0, 31, 5, 33, 5)]
    got = {tuple(r) for r in D.merged_lines(spark.createDataFrame(lines, "map_id int, seg_id int, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert got == {(1, 0, 0, 5, 30, 5), (1, 3, 2, 5, 4, 5), (1, 4, 7, 0, 7, 8), (1, 6, 0, 0, 3, 3), (2, 0, 31, 5, 33, 5)}


def test_final_polygons_as_on_whole_rasters():
    """Crops give what whole rasters give: pieces bridged near borders, fragments, widened contours."""
    from tests import plain_maps

    rng = np.random.default_rng(8)
    for _ in range(60):
        h, w = rng.integers(8, 60, 2)
        img = np.where(rng.random((h, w)) < 0.85, 255, rng.choice([0, 127], (h, w))).astype(np.uint8)
        labels = np.zeros((h, w), np.int32)
        for c in range(1, rng.integers(2, 8)):
            for _ in range(rng.integers(1, 3)):
                y, x = rng.integers(0, h), rng.integers(0, w)
                labels[y : y + rng.integers(1, 14), x : x + rng.integers(1, 14)] = c
        settled = K.settled_labels(img, labels)
        assert np.array_equal(settled, plain_maps.settled_labels(img, labels))
        for c, ring in K.polygons(settled).items():
            assert np.array_equal(K.expanded(ring, img), plain_maps.expanded(ring, img))
        small = np.where(img == 0, K.components(img == 0), 0)
        assert np.array_equal(K.merge_fragments(labels, small), plain_maps.merge_fragments(labels, small))


def square(x, y, w=2.0, h=2.0):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]])


def test_union_closes_gaps():
    from gridloom.operators import polygons as P

    for gap in (0.0, 1e-5, 5e-5, 1.5e-4):
        ring, parts = P.union_outline([square(0, 0), square(2 + gap, 0)])
        assert parts == 1 and abs(K.shoelace(ring) - 8) < 1e-3 and len(ring) == 4, gap
    ring, parts = P.union_outline([square(0, 0), square(2.001, 0)])
    assert parts == 2 and abs(K.shoelace(ring) - 4) < 1e-9
    ring, parts = P.union_outline([square(0, 0), square(2 + 5e-5, 0), square(0, 2 + 5e-5, 2, 1), square(9, 9, 1, 1)])
    assert parts == 2 and abs(K.shoelace(ring) - 10) < 1e-3
    three = P.union_outline([square(0, 0), square(2, 0), square(4, 0)])
    assert three[1] == 1 and abs(K.shoelace(three[0]) - 12) < 1e-9
    corner, parts = P.union_outline([square(0, 0), square(2, 2)])  # a contact in a point
    assert parts == 1 and abs(K.shoelace(corner) - 8) < 1e-3
    with_hole = [square(0, 0, 6, 2), square(0, 4, 6, 2), square(0, 0, 2, 6), square(4, 0, 2, 6)]
    ring, parts = P.union_outline(with_hole)
    assert parts == 1 and abs(K.shoelace(ring) - 36) < 1e-9


def test_union_repairs_rings():
    from gridloom.operators import polygons as P

    bow = np.array([[0.0, 0], [4, 4], [4, 0], [0, 4]])
    loops = P.region_loops([[bow]])
    assert sorted(round(K.shoelace(r), 6) for r in loops) == [4.0, 4.0]  # both wings
    ring, parts = P.union_outline([bow])
    assert parts == 1 and abs(K.shoelace(ring) - 8) < 1e-3
    ring, parts = P.union_outline([bow], closing=0)
    assert parts == 2 and abs(K.shoelace(ring) - 4) < 1e-9
    turns = np.array([np.cos(np.arange(5) * 4 * np.pi / 5), np.sin(np.arange(5) * 4 * np.pi / 5)]).T  # a star: its middle is wound round twice
    star, parts = P.union_outline([turns])
    assert parts == 1 and len(star) == 10 and K.shoelace(star) > 1.1
    twice = np.concatenate([square(0, 0), square(0, 0)])
    assert abs(K.shoelace(P.union_outline([twice])[0]) - 4) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=6))
def test_union_of_boxes_by_pixels(boxes):
    """Lattice boxes: the largest part's filled area, where parts that touch in a corner are one."""
    from gridloom.operators import polygons as P

    grid = np.zeros((16, 16), bool)
    for x, y, w, h in boxes:
        grid[y : y + h, x : x + w] = True
    want = max(K.filled(K.components(grid) == c).sum() for c in range(1, K.components(grid).max() + 1))
    ring, _ = P.union_outline([square(*map(float, b)) for b in boxes])
    assert abs(K.shoelace(ring) - want) < 1e-2


def test_crossing_edges_share_their_node():
    """Of this room's two wings one was lost: both edges rounded their crossing for themselves, and the loop stayed open."""
    from gridloom.operators import polygons as P

    bow = np.array([[27.0, 1.0], [33.0, 10.0], [33.0, 1.0], [27.0, 10.0]])
    ring, parts = P.union_outline([bow])
    assert parts == 1
    assert round(abs(K.shoelace(ring)), 2) == 27.0


def test_hole_that_touches_the_outer_ring():
    from gridloom.operators import polygons as P

    ring, parts = P.union_outline([np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float) for x, y, w, h in ((0, 0, 1, 2), (0, 0, 2, 1), (0, 2, 2, 1), (2, 0, 3, 2))])
    assert parts == 1 and abs(K.shoelace(ring) - 12) < 1e-9
