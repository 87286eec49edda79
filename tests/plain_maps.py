"""Plain versions of the per-map rules, on whole rasters: what the crops and counts are held against."""

import numpy as np

from gridloom.operators import kernels as K
from gridloom.operators.extension import _gap


def filled(mask):
    """One component without its holes, by its outer ring."""
    return K.fill_polygon(K.outer_polygon(K.boundary_edges(mask.astype(np.int32))[:, 1:]), *mask.shape)


def pieces(mask: np.ndarray) -> list[np.ndarray]:
    """The components without their holes; one that lies in another's hole is part of it."""
    labels = K.components(mask)
    out: list[np.ndarray] = []
    seen = np.zeros_like(mask, dtype=bool)
    for c in range(1, int(labels.max()) + 1):  # what surrounds a piece has an earlier first pixel
        own = labels == c
        if not (own & seen).any():
            out.append(filled(own))
            seen |= out[-1]
    return out


def area(mask: np.ndarray) -> float:
    """What the largest contour bounds."""
    return abs(K.shoelace(K.outer_contour(mask)))


def outline(mask: np.ndarray) -> np.ndarray:
    """The border pixels (x, y) of the piece that bounds most, step by step."""
    ends = K.outer_contour(mask)
    return np.array([p for a, b in zip(ends.tolist(), np.roll(ends, -1, axis=0).tolist()) for p in (K.bresenham(*a, *b)[:-1] or [tuple(a)])])


def extend(shapes: list[np.ndarray], free: np.ndarray, strip: np.ndarray, least: float) -> tuple[list[np.ndarray], set[int]]:
    """Masks of the rooms after the extension, old ones first, and the places of those that changed or are new.

    1. Every piece of free space outside rooms and strips joins, of the old rooms with whose free part it makes one
       piece, the one that its rim covers most (the first of equals). Without one it is a room if it bounds more than
       `least` pixels.
    2. Each such new room takes the strip of most contact that makes one piece with it.
    3. What is left, small pieces and strips, becomes rooms where it is large enough; else it joins the room it touches
       that bounds most, or over a line of one pixel the nearest one."""
    rooms = [s.copy() for s in shapes]
    covered = np.zeros_like(free, dtype=bool)
    for s in shapes:
        covered |= s
    changed: set[int] = set()
    made: list[int] = []
    left = np.zeros_like(covered)

    def whole(mask: np.ndarray) -> np.ndarray:
        return max(pieces(mask), key=area)

    for piece in pieces(free & ~covered & ~strip):
        rim = K.dilate(piece)
        found = []
        for k in range(len(shapes)):
            contact, inside = int((rim & rooms[k]).sum()), rooms[k] & free
            if (contact or not inside.any()) and len(pieces(inside | piece)) == 1:
                found.append((contact, -k))
        if found:
            k = -max(found)[1]
            rooms[k] = whole(rooms[k] | piece)
            changed.add(k)
        elif area(piece) > least:
            made.append(len(rooms))
            rooms.append(piece)
        else:
            left |= piece

    bars = pieces(strip)
    taken = set()
    for k in made:
        found = [(int((K.dilate(rooms[k]) & bar).sum()), -j) for j, bar in enumerate(bars) if len(pieces(rooms[k] | bar)) == 1]
        if found:
            j = -max(found)[1]
            rooms[k] = whole(rooms[k] | bars[j])
            taken.add(j)
    changed |= set(made)

    for j, bar in enumerate(bars):
        if j not in taken:
            left |= bar
    for piece in pieces(left):
        if area(piece) > least:
            changed.add(len(rooms))
            rooms.append(piece)
        elif not rooms:
            rooms.append(piece)
        else:
            rim = K.dilate(piece)
            near = [k for k in range(len(rooms)) if (rim & rooms[k]).any()]
            more = piece.copy()
            if near:
                k = max(near, key=lambda k: (area(rooms[k]), -k))
            else:
                rings = [outline(r) for r in rooms]
                gaps = {k: _gap(outline(piece), r) for k, r in enumerate(rings) if len(r)}
                if not gaps:  # no room has a pixel
                    rooms.append(piece)
                    continue
                k = min(gaps, key=lambda k: (gaps[k][0], k))
                for x, y in K.bresenham(*gaps[k][1], *gaps[k][2]):
                    more[y, x] = True
            rooms[k] = whole(rooms[k] | more)
            changed.add(k)
    return rooms, changed


def nearest_label(target: np.ndarray, own: np.ndarray) -> int:
    """The label with most pixels in the smallest square ring growth of own that meets any; ties to the smallest."""
    ys, xs = np.nonzero(own)
    h, w = target.shape
    reach = 1
    while True:
        y0, y1, x0, x1 = max(ys.min() - reach, 0), min(ys.max() + reach + 1, h), max(xs.min() - reach, 0), min(xs.max() + reach + 1, w)
        met = target[y0:y1, x0:x1][K.dilate(own[y0:y1, x0:x1], reach)]
        met = met[met > 0]
        if len(met):
            return int(np.bincount(met).argmax())
        if y0 == 0 and x0 == 0 and y1 == h and x1 == w and reach > max(h, w):
            return 0
        reach += 1


def merge_fragments(normal: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Fragments by size descending, then label, join the nearest region; earlier ones count as regions for later."""
    out = normal.copy()
    ids, size = np.unique(small[small > 0], return_counts=True)
    for c in ids[np.lexsort((ids, -size))]:
        own = small == c
        out[own] = nearest_label(out, own) if out.any() else 0
    return out


def merge_fragments_fixed(normal: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Every fragment on its own joins the nearest region of a fixed map."""
    out = normal.copy()
    for c in np.unique(small[small > 0]):
        own = small == c
        out[own] = nearest_label(normal, own) if normal.any() else 0
    return out


def settled_labels(img: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels as whole pieces, later ones over earlier ones; what they leave of free space are fragments, each of which
    joins the nearest label."""
    cover = np.zeros_like(labels)
    for c in np.unique(labels[labels > 0]):
        cover[K.bridged(labels == c)] = c
    return merge_fragments_fixed(cover, K.components((img > 127) & (cover == 0)))


def expanded(ring: np.ndarray, img: np.ndarray) -> np.ndarray:
    """A lattice ring of unit steps, its corners taken as pixels, one pixel wider where a step touches free space and
    what lies beyond isn't free: the contour of the pixels."""
    h, w = img.shape
    mask = K.fill_polygon(ring, h, w)
    step = np.roll(ring, -1, axis=0) - ring
    beyond = np.stack([step[:, 1], -step[:, 0]], axis=1) * int(np.sign(K.shoelace(ring)))
    ends = np.stack([ring, ring + step])

    def free(p: np.ndarray, outside: bool) -> np.ndarray:
        x, y = p[..., 0], p[..., 1]
        held = (x >= 0) & (y >= 0) & (x < w) & (y < h)
        return np.where(held, img[y.clip(0, h - 1), x.clip(0, w - 1)] == 255, outside)

    moved = (ends + beyond)[:, free(ends, False).any(axis=0)].reshape(-1, 2)
    moved = moved[~free(moved, True)]
    drawn = np.concatenate([ring[(ring[:, 0] < w) & (ring[:, 1] < h)], moved])
    mask[drawn[:, 1], drawn[:, 0]] = True
    return K.outer_contour(mask)
