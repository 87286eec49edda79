"""Extension of stored rooms: the rules on small rasters, and whole maps through the requests."""

import json

import numpy as np
import pytest

from gridloom.config import Config
from gridloom.operators import extension as X
from gridloom.operators import kernels as K
from gridloom.plans import requests as plans
from gridloom.sources import maps as source


def box(shape, y0, y1, x0, x1):
    out = np.zeros(shape, bool)
    out[y0:y1, x0:x1] = True
    return out


def test_strips_outside_rooms():
    old, open_ = box((50, 50), 10, 40, 10, 40), np.ones((50, 50), bool)
    assert not X.strips([(20, 20, 30, 30)], old, open_, plans.contour_mask, 10).any()
    crossing = X.strips([(15, 15, 35, 35)], box((50, 50), 10, 25, 10, 25), open_, plans.contour_mask, 10)
    assert crossing.any() and not (crossing & box((50, 50), 10, 25, 10, 25)).any()
    assert not X.strips([], old, open_, plans.contour_mask, 10).any()
    assert not X.strips([(45, 5, 45, 5)], old, open_, plans.contour_mask, 10).any()
    level = X.strips([(10, 25, 30, 25)], ~open_, open_, plans.contour_mask, 10)
    assert np.array_equal(level, box((50, 50), 20, 31, 8, 33))
    walled = open_.copy()
    walled[:, 20:] = False
    assert np.array_equal(X.strips([(10, 25, 30, 25)], ~open_, walled, plans.contour_mask, 10), box((50, 50), 20, 31, 8, 20))


def test_region_joins_what_it_touches():
    room = box((50, 50), 10, 30, 10, 25)
    rooms, changed = X.extend([room], np.ones((50, 50), bool), np.zeros((50, 50), bool), 4)
    assert changed == {0} and len(rooms) == 1 and rooms[0].all()


def test_strip_makes_a_room_of_its_side():
    shape = (50, 50)
    rooms, changed = X.extend([box(shape, 10, 30, 10, 20)], box(shape, 10, 30, 10, 40), box(shape, 10, 30, 20, 23), 4)
    assert changed == {1} and len(rooms) == 2
    assert np.array_equal(rooms[0], box(shape, 10, 30, 10, 20))
    assert np.array_equal(rooms[1], box(shape, 10, 30, 20, 40))  # with its strip


def test_most_contact_wins():
    shape = (60, 80)
    rooms, changed = X.extend([box(shape, 10, 50, 10, 20), box(shape, 10, 20, 30, 40)], box(shape, 10, 50, 20, 30), np.zeros(shape, bool), 4)
    assert changed == {0} and len(rooms) == 2
    assert np.array_equal(rooms[0], box(shape, 10, 50, 10, 30))


def test_later_regions_see_earlier_ones():
    """The second region touches only what the first one brought to its room, across a corner of the wall."""
    shape = (30, 40)
    rooms, changed = X.extend([box(shape, 5, 25, 2, 10)], box(shape, 5, 25, 2, 10) | box(shape, 5, 15, 10, 20) | box(shape, 15, 25, 20, 30), np.zeros(shape, bool), 4)
    assert changed == {0} and len(rooms) == 1 and rooms[0][20, 25]


def test_small_ones():
    """A spot joins the largest neighbour, one apart the nearest room over a line; a large one is a room, by area."""
    shape = (40, 60)
    none = np.zeros(shape, bool)
    big, little = box(shape, 2, 20, 2, 12), box(shape, 2, 8, 14, 20)
    rooms, changed = X.extend([big, little], big | little, box(shape, 2, 5, 12, 14), 50)
    assert changed == {0} and rooms[0][3, 13] and not rooms[1][3, 13]
    apart = box(shape, 2, 5, 26, 29)
    rooms, changed = X.extend([big, little], big | little | apart, none, 50)
    assert changed == {1} and rooms[1][3, 27] and rooms[1][2:5, 20:26].any(axis=0).all() and K.components(rooms[1]).max() == 1
    block = box(shape, 22, 32, 30, 40)  # bounds 81 pixels
    assert len(X.extend([big, little], big | little | block, none, 80)[0]) == 3
    assert len(X.extend([big, little], big | little | block, none, 81)[0]) == 2
    rooms, changed = X.extend([], apart, none, 50)
    assert len(rooms) == 1 and not changed
    assert X.extend([], none, none, 50) == ([], set())


def test_pieces_and_outline():
    ring = box((20, 20), 2, 18, 2, 18) & ~box((20, 20), 5, 15, 5, 15)
    assert len(X.pieces(ring | box((20, 20), 8, 10, 8, 10))) == 1  # what lies in a hole is no piece
    assert np.array_equal(X.pieces(ring)[0], box((20, 20), 2, 18, 2, 18))
    line = X.outline(box((20, 20), 3, 7, 4, 9))
    assert len(line) == 14 and (np.abs(np.roll(line, -1, axis=0) - line).max(axis=1) == 1).all()
    assert X.area(box((20, 20), 3, 13, 3, 13)) == 81
    assert X.outline(box((9, 9), 4, 5, 4, 5)).tolist() == [[4, 4]]


@pytest.fixture(scope="module")
def maps(spark, tmp_path_factory):
    """known: two rooms that cover all free space; wider: one of them, so that the other's place is new."""
    root = tmp_path_factory.mktemp("known")
    img = np.zeros((416, 416), np.uint8)
    img[100:300, 50:350] = 254
    room = lambda i, n, x0, x1, **more: dict({"name": n, "id": i, "type": "polygon", "geometry": [x0, 5.0, x0, 16.5, x1, 16.5, x1, 5.0, x0, 5.0], "colorType": 2, "graph": [7], "groundMaterial": "wood"}, **more)
    mark = {"geometry": [3.3, 9.0, 0.0], "id": "PLATFORM_LANDMARK_009", "roomId": "ROOM_004", "name": "old", "type": "pose"}
    for name, rooms in (("known", [room("ROOM_004", "B", 2.0, 10.0), room("ROOM_002", "Z", 10.0, 18.0)]), ("wider", [room("ROOM_004", "B", 2.0, 10.0)])):
        folder = root / name
        folder.mkdir()
        (folder / "saved_map.png").write_bytes(source.encode_png(img))
        (folder / "saved_map.json").write_text(json.dumps({"resolution": 0.05, "origin": [0.0, 0.0]}))
        (folder / "mapinfo.json").write_text(json.dumps({"robot_model": "S-K20PRO", "uuid": "u"}))
        (folder / "labels.json").write_text(json.dumps({"version": "v", "uuid": "u", "data": [*rooms, mark]}))
    return source.read_maps(spark, str(root)).cache()


def answers(spark, maps, detections=None):
    requests = spark.createDataFrame([("k", "known", "split", None, None), ("w", "wider", "split", None, None)], "request_id string, map_id string, operation string, room_merge_list array<string>, division struct<id:string,A:array<double>,B:array<double>>")
    rows = {r.request_id: r for r in plans.run(requests, maps, Config(target_size=(416, 416)), detections).collect()}
    assert {r.statusCode for r in rows.values()} == {200}
    return {k: json.loads(r.body)["data"] for k, r in rows.items()}


def test_maps_through_requests(spark, maps):
    got = answers(spark, maps)
    first, second, mark = got["k"]  # no new space: all as it was, but for neighbours and colours
    assert [(r["id"], r["name"], r["groundMaterial"], r["graph"]) for r in (first, second)] == [("ROOM_004", "B", "wood", [1]), ("ROOM_002", "Z", "wood", [0])]
    assert first["geometry"] == [2.0, 5.0, 2.0, 16.5, 10.0, 16.5, 10.0, 5.0, 2.0, 5.0] and first["colorType"] != second["colorType"]
    assert (mark["id"], mark["roomId"], mark["name"], mark["geometry"]) == ("PLATFORM_LANDMARK_009", "ROOM_004", "old", [3.3, 9.0, 0.0])
    room, mark = got["w"]  # the new half joins the room that it touches
    assert (room["id"], room["name"], room["colorType"], room["graph"], room["groundMaterial"]) == ("ROOM_004", "B", 2, [], None)
    xs = room["geometry"][::2]
    assert max(xs) > 17.0 and min(xs) <= 2.6 and mark["id"] == "PLATFORM_LANDMARK_001" and mark["roomId"] == "ROOM_004"


def test_doors_cut_new_space(spark, maps):
    """A door beyond the room's border: what lies behind it is a room with an id, a name and a colour of its own."""
    door = [{"x": float(x), "y": float(y)} for x, y in ((208, 100), (212, 100), (212, 300), (208, 300))]
    doors = spark.createDataFrame([("wider", 1, door)], "map_id string, det_id long, v array<struct<x:double,y:double>>")
    data = answers(spark, maps, doors)["w"]
    rooms = {r["id"]: r for r in data if r["type"] == "polygon"}
    assert sorted(rooms) == ["ROOM_004", "ROOM_005"] and rooms["ROOM_005"]["name"] == "A"
    order = [r["id"] for r in data if r["type"] == "polygon"]
    assert all(rooms[a]["graph"] == [order.index(b)] for a, b in (("ROOM_004", "ROOM_005"), ("ROOM_005", "ROOM_004")))
    assert rooms["ROOM_004"]["colorType"] == 2 != rooms["ROOM_005"]["colorType"]
    assert sorted(m["roomId"] for m in data if m["type"] == "pose") == ["ROOM_004", "ROOM_005"]


def random_case(rng):
    """A noisy map, rooms as boxes (some over walls and over each other), strips."""
    h, w = rng.integers(12, 46, 2)
    free = rng.random((h, w)) < rng.choice([0.55, 0.75, 0.93])
    for _ in range(rng.integers(0, 7)):  # walls, with gaps by chance
        if rng.random() < 0.5:
            free[rng.integers(0, h), rng.integers(0, w) : rng.integers(1, w + 1)] = False
        else:
            free[rng.integers(0, h) : rng.integers(1, h + 1), rng.integers(0, w)] = False
    shapes = []
    for _ in range(rng.integers(0, 5)):
        y, x = rng.integers(0, h), rng.integers(0, w)
        shapes.append(box((h, w), y, y + rng.integers(1, 16), x, x + rng.integers(1, 16)))
    strip = np.zeros((h, w), bool)
    for _ in range(rng.integers(0, 4)):
        y, x = rng.integers(0, h), rng.integers(0, w)
        strip |= box((h, w), y, y + rng.integers(1, 4), x, x + rng.integers(1, 12))
    return shapes, free, strip & free & ~np.logical_or.reduce([np.zeros((h, w), bool), *shapes]), float(rng.choice([0, 4, 15, 60]))


def test_extension_as_on_whole_rasters():
    from tests import plain_maps

    rng = np.random.default_rng(11)
    for _ in range(400):
        case = random_case(rng)
        got, changed = X.extend(*case)
        want, plain_changed = plain_maps.extend(*case)
        assert changed == plain_changed and len(got) == len(want)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_rings_and_enclosures():
    """A region that closes a ring brings what it encloses; a room with parts; a region round a whole room."""
    from tests import plain_maps

    shape, none = (40, 40), np.zeros((40, 40), bool)
    ring = box(shape, 5, 35, 5, 35) & ~box(shape, 9, 31, 9, 31)
    inner, far = box(shape, 18, 22, 18, 22), box(shape, 12, 15, 12, 15)
    room = box(shape, 5, 35, 5, 9)
    cases = [([room], ring | inner | far, none, 4), ([room, inner], ring | inner | far, none, 4), ([inner], ring | inner, none, 4), ([box(shape, 0, 12, 0, 40)], box(shape, 0, 4, 0, 40) | box(shape, 8, 20, 0, 20) | box(shape, 4, 8, 30, 33), none, 4)]
    for case in cases:
        got, want = X.extend(*case), plain_maps.extend(*case)
        assert got[1] == want[1] and len(got[0]) == len(want[0]) and all(np.array_equal(a, b) for a, b in zip(got[0], want[0]))


def test_patches_and_areas():
    from tests import plain_maps

    rng = np.random.default_rng(5)
    for _ in range(300):
        mask = rng.random(rng.integers(1, 15, 2)) < rng.choice([0.2, 0.5, 0.8])
        whole = X.pieces(mask)
        assert all(np.array_equal(a, b) for a, b in zip(whole, plain_maps.pieces(mask), strict=True))
        assert all(X.bounded(p) == plain_maps.area(p) for p in whole) and X.area(mask) == (plain_maps.area(mask) if mask.any() else 0)


def test_large_map():
    """2000 x 2000 pixels, twenty rooms, three hundred regions: 20 s at most."""
    import time

    n = 2000
    free = np.ones((n, n), bool)
    free[::400] = free[:, ::500] = False
    shapes = [box((n, n), y + 20, y + 300, x + 20, x + 420) for y in range(0, n, 400) for x in range(0, n, 500)]
    grid = np.zeros((n, n), bool)
    grid[10::26] = True  # walls through what the rooms leave
    held = np.logical_or.reduce(shapes)
    free &= ~grid | held
    began = time.time()
    rooms, changed = X.extended([X.cropped(s) for s in shapes], free, np.zeros((n, n), bool), 400.0)
    assert time.time() - began < 20 and len(X.patches(free & ~held)) >= 300
    assert changed and len(rooms) >= 20
    covered = np.logical_or.reduce([r.painted((n, n)) for r in rooms])
    assert covered[free].all()


def test_contours_that_touch():
    """Crops of contours are the contours' pixels within the map; pairs are those with neighbouring pixels."""
    rng = np.random.default_rng(9)
    for _ in range(120):
        h, w = (int(v) for v in rng.integers(5, 40, 2))
        shapes, masks = [], []
        for name in range(int(rng.integers(1, 7))):
            points = [(int(x), int(y)) for x, y in rng.integers(-4, 44, (int(rng.integers(1, 6)), 2))]
            shapes.append((name, X.contour_patch(points, h, w)))
            masks.append(plans.contour_mask(points, h, w))
            assert np.array_equal(shapes[-1][1].painted((h, w)), masks[-1])
        want = {(i, j) for i in range(len(masks)) for j in range(i + 1, len(masks)) if (K.dilate(masks[i]) & masks[j]).any()}
        assert X.touching(shapes) == want
