"""Stored rooms over new free space, one map's arrays at a time.

What one region becomes changes what the next one meets, so a map's regions are settled in order, each by its topmost,
then leftmost pixel. Rooms are whole masks without holes. Areas are those that a contour of pixel centres bounds, in
pixels (a block of 10 x 10 has 81), where a room is judged; they are never counts of pixels here.

Nothing is looked at as a whole raster twice: regions and rooms are crops, contact is counted once for every (region,
room) and kept up to date by the pixels that a room gains, and whether a region makes one piece with a room follows from
those counts. Holes and areas change by the 2 x 2 windows that a gain touches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from . import kernels as K
from .raster import array_of, per_map

#: Pixels by which a door's line is carried on at both ends before its strip is drawn.
STRIP_EXTRA = 2


class Patch:
    """A piece of the map: a crop of its mask and the place of the crop's corner."""

    def __init__(self, y: int, x: int, mask: np.ndarray):
        self.y, self.x, self.mask = y, x, mask

    @property
    def box(self) -> tuple[int, int, int, int]:
        return self.y, self.y + self.mask.shape[0], self.x, self.x + self.mask.shape[1]

    def window(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """The mask between these rows and columns; nothing lies outside the crop."""
        out = np.zeros((y1 - y0, x1 - x0), bool)
        a, b, c, d = self.box
        top, end, left, right = max(a, y0), min(b, y1), max(c, x0), min(d, x1)
        if top < end and left < right:
            out[top - y0 : end - y0, left - x0 : right - x0] = self.mask[top - a : end - a, left - c : right - c]
        return out

    def pixels(self, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        ys, xs = np.nonzero(self.mask if mask is None else mask)
        return ys + self.y, xs + self.x

    def holds(self, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        h, w = self.mask.shape
        ys, xs = ys - self.y, xs - self.x
        inside = (ys >= 0) & (xs >= 0) & (ys < h) & (xs < w)
        return inside & self.mask[np.where(inside, ys, 0), np.where(inside, xs, 0)] if h and w else inside

    def painted(self, shape: tuple[int, int]) -> np.ndarray:
        return self.window(0, shape[0], 0, shape[1])


def cropped(mask: np.ndarray) -> Patch:
    """A whole raster's mask as a crop; nothing set gives an empty one."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return Patch(0, 0, np.zeros((0, 0), bool))
    return Patch(int(rows[0]), int(cols[0]), mask[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1].copy())


def patches(mask: np.ndarray, y: int = 0, x: int = 0) -> list[Patch]:
    """The components without their holes; one that lies in another's hole is part of it. (y, x): the mask's place."""
    labels = K.components(K.filled(mask))
    return [Patch(a + y, c + x, labels[a:b, c:d] == k) for k, (a, b, c, d) in K.boxes(labels).items()]


def pieces(mask: np.ndarray) -> list[np.ndarray]:
    """`patches` as masks of the whole raster."""
    return [p.painted(mask.shape) for p in patches(mask)]


def area(mask: np.ndarray) -> float:
    """What the largest contour bounds."""
    return max((bounded(p.mask) for p in patches(mask)), default=0.0)


def _windows(mask: np.ndarray) -> np.ndarray:
    """How many pixels each 2 x 2 window holds, and in two: whether they lie across a corner (then 5)."""
    m = np.pad(mask, 1).astype(np.int8)
    a, b, c, d = m[:-1, :-1], m[:-1, 1:], m[1:, :-1], m[1:, 1:]
    n = a + b + c + d
    return np.where((n == 2) & (a == d), 5, n)


#: What a window adds to four times the Euler number (8-connected) and twice the area between pixel centres, by its count.
_EULER, _AREA = np.array([0, 1, 0, -1, 0, -2]), np.array([0, 0, 0, 1, 2, 0])


def bounded(mask: np.ndarray) -> float:
    """The area of one piece without holes."""
    return float(_AREA[_windows(mask)].sum()) / 2


def outline(mask: np.ndarray) -> np.ndarray:
    """The border pixels (x, y) of the piece that bounds most, step by step."""
    return _outline(cropped(mask))


def _outline(patch: Patch) -> np.ndarray:
    ends = K.outer_contour(patch.mask)
    path = [p for a, b in zip(ends.tolist(), np.roll(ends, -1, axis=0).tolist()) for p in (K.bresenham(*a, *b)[:-1] or [tuple(a)])]
    return np.array(path).reshape(-1, 2) + (patch.x, patch.y)


def strips(lines: Iterable[tuple[float, float, float, float]], old: np.ndarray, open_: np.ndarray, drawn, thickness: int) -> np.ndarray:
    """Door lines (x1, y1, x2, y2) as rectangles, where the map is open and no old room lies. drawn(points, h, w) paints
    a contour with its border. A line without length has no strip."""
    h, w = old.shape
    out = np.zeros((h, w), bool)
    for x1, y1, x2, y2 in lines:
        a = np.array([np.clip(round(x1), 0, w - 1), np.clip(round(y1), 0, h - 1)], float)
        b = np.array([np.clip(round(x2), 0, w - 1), np.clip(round(y2), 0, h - 1)], float)
        size = np.hypot(*(b - a))
        if size:
            along = (b - a) / size
            side = np.array([-along[1], along[0]]) * thickness / 2
            a, b = a - along * STRIP_EXTRA, b + along * STRIP_EXTRA
            out |= drawn([(round(x), round(y)) for x, y in (a + side, b + side, b - side, a - side)], h, w)
    return out & ~old & open_


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[float, tuple, tuple]:
    """Least distance of two sets of pixels and the first pair that has it."""
    best = (np.inf, None, None)
    for lo in range(0, len(a), 256):
        far = ((a[lo : lo + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        i, j = np.unravel_index(far.argmin(), far.shape)
        if far[i, j] < best[0]:
            best = (float(far[i, j]), tuple(a[lo + i].tolist()), tuple(b[j].tolist()))
    return best


def contour_patch(points: Sequence[tuple[int, int]], h: int, w: int) -> Patch:
    """Pixels inside a contour or on its border, as far as they lie in the map; fewer than three vertices give none."""
    if len(points) < 3:
        return Patch(0, 0, np.zeros((0, 0), bool))
    x0, y0 = np.min(points, axis=0)
    x1, y1 = np.max(points, axis=0) + 1
    whole = Patch(int(y0), int(x0), K.contour_mask([(int(x - x0), int(y - y0)) for x, y in points], int(y1 - y0), int(x1 - x0)))
    y0, y1, x0, x1 = (int(np.clip(v, 0, m)) for v, m in ((y0, h), (y1, h), (x0, w), (x1, w)))
    return Patch(y0, x0, whole.window(y0, y1, x0, x1))


def touching(shapes: Sequence[tuple[int, Patch]]) -> set[tuple[int, int]]:
    """Pairs a < b of names whose patches overlap or have neighbouring pixels."""
    shapes = [s for s in shapes if s[1].mask.any()]
    boxes = np.array([p.box for _, p in shapes]).reshape(-1, 4)
    out = set()
    for k, (name, patch) in enumerate(shapes):
        a, b, c, d = patch.box
        near = np.flatnonzero((boxes[k + 1 :, 0] <= b) & (boxes[k + 1 :, 1] >= a) & (boxes[k + 1 :, 2] <= d) & (boxes[k + 1 :, 3] >= c)) + k + 1
        out |= {(min(name, shapes[j][0]), max(name, shapes[j][0])) for j in near.tolist() if shapes[j][0] != name and _contact(patch, shapes[j][1])}
    return out


class Room(Patch):
    """A room that grows. size: its area; whole: whether it is one piece without holes."""

    def __init__(self, patch: Patch):
        super().__init__(patch.y, patch.x, patch.mask)
        own = patches(patch.mask)
        self.whole = len(own) == 1 and int(own[0].mask.sum()) == int(patch.mask.sum())
        self.size = max((bounded(p.mask) for p in own), default=0.0)
        self.line: np.ndarray | None = None

    def outline(self) -> np.ndarray:
        if self.line is None:
            self.line = _outline(self)
        return self.line

    def _widen(self, box: tuple[int, int, int, int]) -> None:
        a, b, c, d = self.box
        if not self.mask.size:
            a, b, c, d = box
        y0, y1, x0, x1 = min(a, box[0]), max(b, box[1]), min(c, box[2]), max(d, box[3])
        if (y0, y1, x0, x1) != self.box:
            self.y, self.x, self.mask = y0, x0, self.window(y0, y1, x0, x1)

    def take(self, more: Patch) -> tuple[np.ndarray, np.ndarray, bool]:
        """Become the largest piece, without holes, of the room and a patch that touches it. Returns the pixels gained
        and whether they are the patch's alone."""
        self.line = None
        y0, y1, x0, x1 = more.box
        near = y0 - 1, y1 + 1, x0 - 1, x1 + 1
        before = self.window(*near)
        after = before | more.window(*near)
        euler = int(_EULER[_windows(after)].sum() - _EULER[_windows(before)].sum())
        if self.whole and euler == 0 and (K.dilate(more.window(*near)) & before).any():
            gain = after & ~before
            ys, xs = np.nonzero(gain)
            self.size += float(_AREA[_windows(after)].sum() - _AREA[_windows(before)].sum()) / 2
            self._widen(more.box)
            self.mask[y0 - self.y : y1 - self.y, x0 - self.x : x1 - self.x] |= more.mask
            return ys + near[0], xs + near[2], True
        old = Patch(self.y, self.x, self.mask)
        self._widen(more.box)
        self.mask = self.mask | more.window(*self.box)
        best = max(patches(self.mask, self.y, self.x), key=lambda p: bounded(p.mask))
        self.y, self.x, self.mask, self.size, self.whole = best.y, best.x, best.mask, bounded(best.mask), True
        ys, xs = np.nonzero(self.mask & ~old.window(*self.box))
        return ys + self.y, xs + self.x, False


class Contacts:
    """Counts of room pixels, and of free ones among them, in the rim (with all that it encloses) of every region."""

    def __init__(self, regions: Sequence[Patch], rooms: Sequence[Room], free: np.ndarray):
        h, w = free.shape
        self.free, self.width = free, w
        region, place = [], []
        for i, p in enumerate(regions):
            y0, y1, x0, x1 = p.box
            y0, y1, x0, x1 = max(0, y0 - 1), min(h, y1 + 1), max(0, x0 - 1), min(w, x1 + 1)
            ys, xs = np.nonzero(K.dilate(p.window(y0, y1, x0, x1)))
            place.append((ys + y0) * w + xs + x0)
            region.append(np.full(len(ys), i))
        region, place = (np.concatenate(v) if v else np.zeros(0, int) for v in (region, place))
        turn = np.argsort(place, kind="stable")
        self.region, self.place = region[turn], place[turn]
        self.all = np.zeros((len(regions), len(rooms)), np.int64)
        self.open = self.all.copy()
        for k, room in enumerate(rooms):
            ys, xs = room.pixels()
            self.gained(k, ys, xs)

    def gained(self, k: int, ys: np.ndarray, xs: np.ndarray) -> None:
        """Room k has these pixels as well."""
        at = ys * self.width + xs
        low, high = np.searchsorted(self.place, at), np.searchsorted(self.place, at, side="right")
        met = high > low
        low, count, open_ = low[met], (high - low)[met], self.free[ys[met], xs[met]]
        rows = self.region[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        np.add.at(self.all[:, k], rows, 1)
        np.add.at(self.open[:, k], rows, np.repeat(open_, count))


def extended(shapes: Sequence[Patch], free: np.ndarray, strip: np.ndarray, least: float) -> tuple[list[Patch], set[int]]:
    """The rooms after the extension, old ones first, and the places of those that changed or are new.

    1. Every piece of free space outside rooms and strips joins, of the old rooms with whose free part it makes one
       piece, the one that its rim covers most (the first of equals). Without one it is a room if it bounds more than
       `least` pixels.
    2. Each such new room takes the strip of most contact that makes one piece with it.
    3. What is left, small pieces and strips, becomes rooms where it is large enough; else it joins the room it touches
       that bounds most, or over a line of one pixel the nearest one."""
    h, w = free.shape
    rooms = [Room(s) for s in shapes]
    covered = np.zeros((h, w), bool)
    for s in shapes:
        ys, xs = s.pixels()
        covered[ys, xs] = True
    changed: set[int] = set()
    made: list[int] = []
    left = np.zeros((h, w), bool)

    regions = patches(free & ~covered & ~strip)
    contacts = Contacts(regions, rooms, free)
    tops = [_tops(r, free) for r in rooms]  # the pieces of each room's free part
    for i, piece in enumerate(regions):
        found = []
        for k in np.flatnonzero((contacts.all[i] > 0) | np.array([not t for t in tops], bool)).tolist():
            if not tops[k] or (contacts.open[i, k] > 0 if len(tops[k]) == 1 else _one_piece(piece, tops[k])):
                found.append((int(contacts.all[i, k]), -k))
        if found:
            k = -max(found)[1]
            ys, xs, plain = rooms[k].take(piece)
            contacts.gained(k, ys, xs)
            if not plain or len(tops[k]) != 1:
                tops[k] = _tops(rooms[k], free)
            changed.add(k)
        elif bounded(piece.mask) > least:
            made.append(len(rooms))
            rooms.append(Room(piece))
        else:
            ys, xs = piece.pixels()
            left[ys, xs] = True

    bars = patches(strip)
    taken = set()
    for k in made:
        touching = {j: n for j, n in ((j, _contact(rooms[k], bar)) for j, bar in enumerate(bars)) if n}
        if touching:
            j = max(touching, key=lambda j: (touching[j], -j))
            rooms[k].take(bars[j])
            taken.add(j)
    changed |= set(made)

    for j, bar in enumerate(bars):
        if j not in taken:
            ys, xs = bar.pixels()
            left[ys, xs] = True
    for piece in patches(left):
        if bounded(piece.mask) > least or not rooms:
            if bounded(piece.mask) > least:
                changed.add(len(rooms))
            rooms.append(Room(piece))
            continue
        near = [k for k, r in enumerate(rooms) if _contact(piece, r)]
        if near:
            k = max(near, key=lambda k: (rooms[k].size, -k))
            rooms[k].take(piece)
        else:
            gaps = {k: _gap(_outline(piece), r.outline()) for k, r in enumerate(rooms) if r.mask.any()}
            if not gaps:  # no room has a pixel
                rooms.append(Room(piece))
                continue
            k = min(gaps, key=lambda k: (gaps[k][0], k))
            x, y = np.array(K.bresenham(*gaps[k][1], *gaps[k][2])).T
            y0, y1, x0, x1 = piece.box
            y0, y1, x0, x1 = min(y0, y.min()), max(y1, y.max() + 1), min(x0, x.min()), max(x1, x.max() + 1)
            more = Patch(int(y0), int(x0), piece.window(y0, y1, x0, x1))
            more.mask[y - y0, x - x0] = True
            rooms[k].take(more)
        changed.add(k)
    return rooms, changed


def _tops(room: Patch, free: np.ndarray) -> list[Patch]:
    y0, y1, x0, x1 = room.box
    return patches(room.mask & free[y0:y1, x0:x1], y0, x0) if room.mask.size else []


def _contact(one: Patch, other: Patch) -> int:
    """Pixels of the other patch in the first one with its rim."""
    a, b = one.box, other.box
    if a[0] > b[1] or b[0] > a[1] or a[2] > b[3] or b[2] > a[3]:
        return 0
    near = a[0] - 1, a[1] + 1, a[2] - 1, a[3] + 1
    return int((K.dilate(one.window(*near)) & other.window(*near)).sum())


def _one_piece(piece: Patch, tops: list[Patch]) -> bool:
    """Whether a piece and all of these make one; some may lie in what the others enclose."""
    touched = [t for t in tops if _contact(piece, t)]
    if len(touched) == len(tops):
        return True
    boxes = np.array([p.box for p in (piece, *touched)])
    y0, y1, x0, x1 = boxes[:, 0].min(), boxes[:, 1].max(), boxes[:, 2].min(), boxes[:, 3].max()
    if any(t.y <= y0 or t.x <= x0 or t.box[1] >= y1 or t.box[3] >= x1 for t in tops if t not in touched):
        return False
    window = y0, y1, x0, x1
    return len(patches(np.logical_or.reduce([p.window(*window) for p in (piece, *tops)]))) == 1


def extend(shapes: list[np.ndarray], free: np.ndarray, strip: np.ndarray, least: float) -> tuple[list[np.ndarray], set[int]]:
    """`extended` from and to masks of the whole raster."""
    rooms, changed = extended([cropped(s) for s in shapes], free, strip, least)
    return [r.painted(free.shape) for r in rooms], changed


def contours(rooms: Sequence[Patch], old: int, changed: set[int], img: np.ndarray) -> dict[int, np.ndarray]:
    """Place -> contour (x, y) of what changed: new rooms share their borders with all others, later ones lie on top;
    each is then widened by a pixel to the walls."""
    labels = np.zeros(img.shape, np.int32)
    for k, r in enumerate(rooms):
        ys, xs = r.pixels()
        labels[ys, xs] = k + 1
    rings = K.polygons(labels, only=range(old + 1, len(rooms) + 1))
    out = {}
    for k in sorted(changed | set(range(old, len(rooms)))):
        ring = rings[k + 1] if k >= old and k + 1 in rings else _outline(rooms[k])
        out[k] = K.expanded(ring, img) if k in changed else ring
    return out


def extended_maps(held: DataFrame, least: float, chain: tuple[int, int, int, int] | None = None, threshold: int = 128, thickness: int = 10) -> DataFrame:
    """Maps with their rooms and door lines (map_id, h, w, data, rooms: pos and pixel contours, lines: x1, y1, x2, y2)
    -> map_id, pos, points, pixels: the rooms that changed or are new, with their contours and numbers of pixels. A map
    that has new space at all comes with a row of pos -1 and the pixels that all rooms cover. chain: the cleaning's
    parameters for raw maps; without it the pixels count as they are."""

    def kernel(row: dict) -> Iterator[dict]:
        img = array_of(row)
        cleaned, grid = K.preprocess(img, *chain)[:2] if chain else (img, img)
        free = grid >= threshold
        shapes = [contour_patch([(p["x"], p["y"]) for p in room["points"]], row["h"], row["w"]) for room in row["rooms"] or ()]
        old = np.zeros(free.shape, bool)
        for s in shapes:
            ys, xs = s.pixels()
            old[ys, xs] = True
        if not (free & ~old).any():
            return
        lines = [(s["x1"], s["y1"], s["x2"], s["y2"]) for s in row["lines"] or ()]
        strip = strips(lines, old, cleaned == K.FREE, K.contour_mask, thickness)
        after, changed = extended(shapes, free, strip, least)
        for r in after:
            ys, xs = r.pixels()
            old[ys, xs] = True
        yield {"pos": -1, "points": [], "pixels": int(old.sum())}
        for pos, points in contours(after, len(shapes), changed, cleaned).items():
            yield {"pos": pos, "points": [{"x": int(x), "y": int(y)} for x, y in points], "pixels": int(after[pos].mask.sum())}

    return per_map(held, kernel, "pos int, points array<struct<x:int,y:int>>, pixels long")
