"""Per-map kernels against plain versions and the properties that hold without an oracle."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators import kernels as K


def flood(mask):
    h, w = mask.shape
    out, n = np.zeros((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not out[y, x]:
                n += 1
                todo = [(y, x)]
                out[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for d, e in K.EIGHT:
                        if 0 <= a + d < h and 0 <= b + e < w and mask[a + d, b + e] and not out[a + d, b + e]:
                            out[a + d, b + e] = n
                            todo.append((a + d, b + e))
    return out


masks = st.tuples(st.integers(1, 14), st.integers(1, 14), st.integers(0, 2**32), st.floats(0, 1)).map(lambda t: np.random.default_rng(t[2]).random(t[:2]) < t[3])


@settings(max_examples=60, deadline=None)
@given(masks)
def test_components_and_polygons(mask):
    labels = K.components(mask)
    assert (labels == flood(mask)).all()
    for c, p in K.polygons(labels).items():
        inside = K.fill_polygon(p, *mask.shape)
        assert inside[labels == c].all() and inside.sum() == abs(K.shoelace(p))


@settings(max_examples=30, deadline=None)
@given(masks, st.integers(1, 3))
def test_dilate(mask, r):
    want = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        want[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    assert (K.dilate(mask, r) == want).all()


def test_fixture_rasters():
    two = np.zeros((100, 100), np.uint8)
    two[1:45, 1:99] = two[55:99, 1:99] = 255
    labels = K.components(two == 255)
    assert np.bincount(labels.ravel())[1:].tolist() == [4312, 4312]
    assert K.remap(np.array([0, 247, 254, 255, 9], np.uint8)).tolist() == [0, 127, 255, 0, 0]
    dot = np.full((20, 20), 255, np.uint8)
    dot[10, 10] = 0
    out, mask = K.remove_interior_noise(dot)
    assert out[10, 10] == 255 and mask.sum() == 1
    assert K.area_cutoff(1.0, 0.05) == 399


def test_preprocess_layers():
    raw = np.full((32, 32), 254, np.uint8)
    raw[0] = raw[:, 0] = 0
    raw[15, 15] = 247
    for layer in K.preprocess(raw):
        assert layer.shape == raw.shape and set(np.unique(layer)) <= {0, 127, 255}


def test_fragments_and_split():
    normal = np.zeros((20, 20), np.int32)
    normal[4:14, 4:14] = 3
    small = np.zeros_like(normal)
    small[14:16, 8:10] = 7
    for merge in (K.merge_fragments, K.merge_fragments_fixed):
        out = merge(normal, small)
        assert (out[14:16, 8:10] == 3).all() and (out[small == 0] == normal[small == 0]).all()
    labels = np.zeros((12, 12), np.int32)
    labels[:9, :9], labels[10:, 10:] = 1, 2
    big, rest = K.split_by_area(labels, 5)
    assert set(np.unique(big)) == {0, 1} and set(np.unique(rest)) == {0, 2}


def test_graph_walks():
    six = {i: [j for j in range(6) if j != i] for i in range(6)}
    colors = K.greedy_colors(six)
    assert [colors[i] for i in range(5)] == [0, 1, 2, 3, 4] and colors[5] == 0
    path = {0: [1], 1: [0, 2], 2: [1], 3: []}
    assert K.dfs_order(path, 0) == [0, 1, 2, 3] and sorted(K.dfs_order(path)) == [0, 1, 2, 3]
    mended = K.repair_colors(path, {0: 0, 1: 0, 2: 0, 3: 0})
    assert all(mended[a] != mended[b] for a in path for b in path[a])


def test_growth_and_lines():
    mask = np.zeros((20, 20), bool)
    mask[5:15, 5:15] = True
    seeds = np.zeros((20, 20), np.int32)
    seeds[9, 9] = 1
    assert (K.grow_regions(mask, seeds, 20) == mask).all()
    assert K.bresenham(0, 0, 3, 1) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    img = np.zeros((40, 40), bool)
    img[2:38, 2:38] = True
    img &= ~K.draw_line((40, 40), (20, 0), (20, 39), 2)
    assert K.components(img).max() == 2


def test_closing_ignores_the_outside():
    wall = np.zeros((3, 5), bool)
    wall[1, [0, 2, 4]] = True
    assert K.close_line(wall, 1)[1].all() and not K.close_line(wall, 1)[0].any()
    assert K.gauss(np.ones((4, 4))).round(9).tolist() == np.ones((4, 4)).tolist()


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (3, 4, 3)])
def test_png_round_trip(shape):
    from gridloom.sources.maps import decode_png, encode_png

    img = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (decode_png(encode_png(img)) == K.gray(img[..., ::-1] if img.ndim == 3 else img)).all()
