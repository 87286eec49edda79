"""Per-map kernels on dense arrays: components, morphology, lattice polygons, ordered graph walks.

Each is a pure function of one map's arrays; Spark deals maps to tasks, one row a map, so no kernel needs a shuffle.
Rules where implementations may differ are fixed here: components and regions are numbered by their first pixel in
row order, loops start at their smallest vertex, ties fall to smaller labels.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WALL, UNKNOWN, FREE = 0, 127, 255
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def remap(raw: np.ndarray) -> np.ndarray:
    """Raw pixels 0, 247, 254 to wall, unknown, free; every other value is wall."""
    table = np.zeros(256, np.uint8)
    table[247], table[254] = UNKNOWN, FREE
    return table[raw]


def gray(bgr: np.ndarray) -> np.ndarray:
    """One channel, by the usual luma weights, rounded; a single channel is copied."""
    if bgr.ndim == 2:
        return bgr.copy()
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """8-connected components (4-connected without corners), numbered from 1 by first pixel in row order; 0 elsewhere.

    Rows are cut into runs; runs of neighbouring rows that touch are joined by smallest labels and pointer doubling."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    n = len(row)
    out = np.zeros((h, w), np.int32)
    if not n:
        return out
    # runs of the next row that overlap [start - reach, end + reach)
    base, reach = row * (w + 4), int(corners)
    low = np.searchsorted(base + end, base + w + 4 + start - reach, side="right")
    high = np.searchsorted(base + start, base + w + 4 + end + reach, side="left")
    low = np.maximum(low, np.searchsorted(row, row + 1, side="left"))
    high = np.minimum(high, np.searchsorted(row, row + 1, side="right"))
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if len(a) <= 256:  # few runs are joined one by one
        root = list(range(n))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(a.tolist(), b.tolist()):
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        number: dict[int, int] = {}
        dense = np.array([number.setdefault(top(i), len(number)) for i in range(n)])
    else:
        label = np.arange(n)
        while True:
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
            if np.array_equal(before, label):
                break
        _, dense = np.unique(label, return_inverse=True)
    size = end - start
    at = np.repeat(row * w + start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out.ravel()[at] = np.repeat(dense + 1, size)
    return out


def boxes(labels: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """Label -> first row, row past the last, first column, column past the last; in order of labels."""
    ys, xs = np.nonzero(labels)
    if not len(ys):
        return {}
    names, own = np.unique(labels[ys, xs], return_inverse=True)
    low, high = np.full((2, len(names)), max(labels.shape)), np.zeros((2, len(names)), int)
    for k, v in enumerate((ys, xs)):
        np.minimum.at(low[k], own, v)
        np.maximum.at(high[k], own, v + 1)
    return {int(c): (int(a), int(b), int(e), int(f)) for c, a, b, e, f in zip(names, low[0], high[0], low[1], high[1])}


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and all that it encloses: what no path by edges leads out of."""
    out = components(~np.pad(np.asarray(mask, bool), 1), corners=False)
    return out[1:-1, 1:-1] != out[0, 0]


def shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """a moved so that place (y, x) holds a[y + dy, x + dx]."""
    h, w = a.shape
    out = np.full_like(a, fill)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y1 > y0 and x1 > x0:
        out[y0:y1, x0:x1] = a[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def dilate(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """Binary dilation by a square of the given radius (n rounds of k x k make n * (k - 1) / 2)."""
    out = mask.astype(bool)
    for axis in (0, 1):
        wide = np.zeros([s + 2 * radius * (k == axis) for k, s in enumerate(out.shape)], np.int32)
        wide[tuple(slice(radius, -radius or None) if k == axis else slice(None) for k in (0, 1))] = out
        sums = np.cumsum(np.insert(wide, 0, 0, axis=axis), axis=axis)
        n = 2 * radius + 1
        out = (np.take(sums, range(n, sums.shape[axis]), axis) - np.take(sums, range(sums.shape[axis] - n), axis)) > 0
    return out


def close_line(mask: np.ndarray, axis: int) -> np.ndarray:
    """Closing by three pixels in a line; outside the image neither grows nor shrinks."""
    d = (0, 1) if axis == 1 else (1, 0)
    m = mask.astype(bool)
    grown = m | shifted(m, *d, False) | shifted(m, -d[0], -d[1], False)
    return grown & shifted(grown, *d, True) & shifted(grown, -d[0], -d[1], True)


def mirrored(a: np.ndarray) -> np.ndarray:
    """One more pixel on each side, mirrored without the edge pixel itself."""
    h, w = a.shape
    ys = np.abs(np.arange(-1, h + 1))
    xs = np.abs(np.arange(-1, w + 1))
    ys = np.where(ys >= h, np.maximum(2 * h - 2 - ys, 0), ys)
    xs = np.where(xs >= w, np.maximum(2 * w - 2 - xs, 0), xs)
    return a[np.ix_(ys, xs)]


def prune_burrs(wall: np.ndarray, passes: int = 4) -> np.ndarray:
    """Simultaneous passes that delete wall pixels with at most one wall neighbour."""
    wall = wall.astype(bool)
    for _ in range(passes):
        big = mirrored(wall).astype(np.int32)
        h, w = wall.shape
        near = sum(big[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in EIGHT)
        gone = wall & (near <= 1)
        if not gone.any():
            break
        wall = wall & ~gone
    return wall


def gauss_kernel(sigma: float = 0.8) -> np.ndarray:
    side = np.exp(-1 / (2 * sigma * sigma))
    return np.array([side, 1.0, side]) / (1 + 2 * side)


def gauss(wall: np.ndarray, sigma: float = 0.8) -> np.ndarray:
    """3 x 3 Gaussian of a mask, mirrored at the border."""
    k = gauss_kernel(sigma)
    big = mirrored(wall.astype(np.float64))
    rows = k[0] * big[:, :-2] + k[1] * big[:, 1:-1] + k[2] * big[:, 2:]
    return k[0] * rows[:-2] + k[1] * rows[1:-1] + k[2] * rows[2:]


def remove_interior_noise(img: np.ndarray, max_area: int = 30, iterations: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Small wall components that lie wholly near free space become free; also the mask of what changed."""
    comp = components(img == WALL)
    near = dilate(img == FREE, 2 * iterations)
    area = np.bincount(comp.ravel())
    far = np.bincount(comp.ravel(), weights=~near.ravel()) > 0
    gone = (area <= max_area) & ~far
    gone[0] = False
    mask = gone[comp]
    return np.where(mask, FREE, img).astype(np.uint8), mask


def remove_unknown_noise(img: np.ndarray, max_area: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Small unknown components take the majority of the ring around them: wall if it has more walls, else free."""
    h, w = img.shape
    comp = components(img == UNKNOWN)
    area = np.bincount(comp.ravel())
    small = area <= max_area
    small[0] = False
    changed = small[comp]
    ys, xs = np.nonzero(changed)
    own = comp[ys, xs].astype(np.int64)
    ring = []
    for dy, dx in EIGHT:
        y, x = ys + dy, xs + dx
        held = (y >= 0) & (x >= 0) & (y < h) & (x < w)
        y, x, c = y[held], x[held], own[held]
        other = comp[y, x] != c
        ring.append((c * (h * w) + y * w + x)[other])
    c, at = np.divmod(np.unique(np.concatenate(ring)), h * w)  # each pixel of a ring once
    value = img.ravel()[at]
    walls, frees = (np.bincount(c, value == v, len(area)) for v in (WALL, FREE))
    out = img.copy()
    out[ys, xs] = np.where(walls > frees, WALL, FREE)[own]
    return out, changed


def complete_walls(img: np.ndarray) -> np.ndarray:
    """Free pixels beside unknown ones become wall."""
    return np.where((img == FREE) & dilate(img == UNKNOWN), WALL, img).astype(np.uint8)


def smooth_wall(img: np.ndarray, iterations: int = 2, burr: int = 4) -> np.ndarray:
    """Walls closed along both axes, pruned, blurred and cut at one half; what changes takes its neighbourhood's value."""
    wall = img == WALL
    new = wall
    for _ in range(iterations):
        new = close_line(close_line(new, 1), 0)
    new = gauss(prune_burrs(new, burr)) > 0.5
    near_free = dilate(img == FREE)
    out = img.copy()
    out[new & ~wall] = WALL
    out[wall & ~new & near_free] = FREE
    out[wall & ~new & ~near_free] = UNKNOWN
    return out


def preprocess(img: np.ndarray, max_area: int = 30, iterations: int = 2, smooth: int = 2, burr: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three layers of a raw map: cleaned (interior noise gone), cleaned2 (unknown noise gone too), input (walls
    completed and smoothed)."""
    mapped = remap(img)
    cleaned, _ = remove_interior_noise(mapped, max_area, iterations)
    cleaned2, _ = remove_unknown_noise(cleaned, max_area)
    return cleaned, cleaned2, smooth_wall(complete_walls(cleaned2), smooth, burr)


def area_cutoff(min_area: float, resolution: float) -> int:
    """Least pixels of a normal region; in doubles, as 1.0 / 0.05**2 comes to 399."""
    return max(1, int(min_area / (resolution * resolution)))


def split_by_area(labels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(labels.ravel())
    normal = size >= least
    normal[0] = False
    small = ~normal
    small[0] = False
    return np.where(normal[labels], labels, 0), np.where(small[labels], labels, 0)


def _nearest_label(target: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> int:
    """The label with most pixels in the smallest square ring growth of the pixels that meets any; ties to the smallest."""
    h, w = target.shape
    reach = 1
    while True:
        y0, y1, x0, x1 = max(ys.min() - reach, 0), min(ys.max() + reach + 1, h), max(xs.min() - reach, 0), min(xs.max() + reach + 1, w)
        near = target[y0:y1, x0:x1]
        if near.any():
            own = np.zeros(near.shape, bool)
            own[ys - y0, xs - x0] = True
            met = near[dilate(own, reach)]
            met = met[met > 0]
            if len(met):
                return int(np.bincount(met).argmax())
        if y0 == 0 and x0 == 0 and y1 == h and x1 == w and reach > max(h, w):
            return 0
        reach += 1


def _pixels_of(labels: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Label -> its pixels, in one pass over the raster."""
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs]
    turn = np.argsort(own, kind="stable")
    names, first = np.unique(own[turn], return_index=True)
    return {int(c): (ys[t], xs[t]) for c, t in zip(names, np.split(turn, first[1:]))}


def merge_fragments(normal: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Fragments by size descending, then label, join the nearest region; earlier ones count as regions for later."""
    out = normal.copy()
    some = bool(out.any())
    for _, (ys, xs) in sorted(_pixels_of(small).items(), key=lambda f: (-len(f[1][0]), f[0])):
        out[ys, xs] = _nearest_label(out, ys, xs) if some else 0
    return out


def merge_fragments_fixed(normal: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Every fragment on its own joins the nearest region of a fixed map."""
    out = normal.copy()
    some = bool(normal.any())
    for ys, xs in _pixels_of(small).values():
        out[ys, xs] = _nearest_label(normal, ys, xs) if some else 0
    return out


def boundary_edges(labels: np.ndarray) -> np.ndarray:
    """Directed unit edges (label, x0, y0, x1, y1) round every label's pixels, the label on the right-hand side."""
    h, w = labels.shape
    big = np.zeros((h + 2, w + 2), labels.dtype)
    big[1:-1, 1:-1] = labels
    found = []
    for dy, dx, (ax, ay, bx, by) in ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))):
        other = big[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        ys, xs = np.nonzero((labels > 0) & (labels != other))
        found.append(np.stack([labels[ys, xs], xs + ax, ys + ay, xs + bx, ys + by], axis=1))
    return np.concatenate(found).astype(np.int64)


def shoelace(points: np.ndarray) -> float:
    x, y = np.asarray(points, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def trace_loops(edges: np.ndarray) -> list[np.ndarray]:
    """Directed edges (x0, y0, x1, y1) as closed loops; where two leave a corner the left one is taken, so pixels of
    one label that meet in a corner share a loop. Each starts at its smallest vertex."""
    leaving: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sorted(map(tuple, edges.tolist())):
        leaving.setdefault((x0, y0), []).append((x1, y1))
    loops = []
    for first in sorted(leaving):
        while leaving[first]:
            at, loop, came = first, [], None
            while True:
                ways = leaving[at]
                if came is None or len(ways) == 1:
                    to = ways.pop(0)
                else:
                    turn = lambda p: (came[0] * (p[1] - at[1]) - came[1] * (p[0] - at[0]))
                    to = min(ways, key=turn)
                    ways.remove(to)
                loop.append(at)
                came = (to[0] - at[0], to[1] - at[1])
                at = to
                if at == first:
                    break
            loops.append(np.array(loop))
    return loops


def outer_polygon(edges: np.ndarray) -> np.ndarray:
    """The loop with the largest area; holes go. Starts at its smallest vertex."""
    loops = trace_loops(edges)
    best = max(loops, key=lambda p: (abs(shoelace(p)), (-p[0]).tolist()))
    k = np.lexsort((best[:, 1], best[:, 0]))[0]
    return np.roll(best, -k, axis=0)


def polygons(labels: np.ndarray, only: Iterable[int] | None = None) -> dict[int, np.ndarray]:
    """Label -> lattice polygon, of some labels or all; neighbours share their edges exactly."""
    edges = boundary_edges(labels)
    if only is not None:
        edges = edges[np.isin(edges[:, 0], list(only))]
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    names, first = np.unique(edges[:, 0], return_index=True)
    return {int(c): outer_polygon(own[:, 1:]) for c, own in zip(names, np.split(edges, first[1:]))}


def fill_polygon(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels whose centre lies inside a lattice polygon (even-odd)."""
    x0, y0 = np.asarray(points, float).T
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    cy = np.arange(h) + 0.5
    flips = np.zeros((h, w + 1), np.int32)
    for a, b, c, d in zip(x0, y0, x1, y1):
        if b == d:
            continue
        rows = np.flatnonzero((cy >= min(b, d)) & (cy < max(b, d)))  # a vertex on a row counts once
        cross = a + (cy[rows] - b) * (c - a) / (d - b)
        np.add.at(flips, (rows, np.clip(np.ceil(cross - 0.5), 0, w).astype(int)), 1)
    return (np.cumsum(flips, axis=1)[:, :w] % 2).astype(bool)


#: Sizes of the closings that bridge a label's pieces, tried in this order (fixed values).
BRIDGES = (3, 5, 7, 11, 15, 21, 31)


def close_disc(mask: np.ndarray, size: int) -> np.ndarray:
    """Closing by a disc of odd size; outside the image neither grows nor shrinks."""
    r = size // 2
    rows = [(dy, int(np.rint(np.sqrt(r * r - dy * dy)))) for dy in range(-r, r + 1)]
    steps = [(dy, dx) for dy, half in rows for dx in range(-half, half + 1)]
    grown = np.zeros_like(mask)
    for dy, dx in steps:
        grown |= shifted(mask, dy, dx, False)
    out = grown.copy()
    for dy, dx in steps:
        out &= shifted(grown, dy, dx, True)
    return out


def outer_contour(mask: np.ndarray) -> np.ndarray:
    """The border pixels of the component whose contour bounds most, clockwise from its topmost, leftmost pixel;
    straight runs as their ends (x, y)."""
    labels = components(mask)
    found = [_border(labels == c) for c in range(1, int(labels.max()) + 1)]
    return max(found, key=lambda p: abs(shoelace(p))) if found else np.zeros((0, 2), int)


def _border(own: np.ndarray) -> np.ndarray:
    big = np.pad(own, 1)
    y, x = (int(v) for v in np.argwhere(big)[0])
    first, way, came, path = (x, y), None, 5, []
    turns = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    while True:
        to = next((d for d in ((came + k) % 8 for k in range(8)) if big[y + turns[d][1], x + turns[d][0]]), None)
        if to is None:
            return np.array([(x - 1, y - 1)])
        if (x, y) == first and to == way:
            break
        way = to if way is None else way
        path.append((x - 1, y - 1, to))
        x, y = x + turns[to][0], y + turns[to][1]
        came = (to + 6 - to % 2) % 8
    return np.array([p[:2] for k, p in enumerate(path) if p[2] != path[k - 1][2]])


def bridged(mask: np.ndarray) -> np.ndarray:
    """A label's pixels as one piece without holes: closed by growing discs until its pieces meet, else its piece of
    largest contour."""
    pieces = components(mask)
    if pieces.max() <= 1:
        return filled(mask)
    whole = np.zeros_like(mask)
    for c in range(1, int(pieces.max()) + 1):
        whole |= filled(pieces == c)
    ys, xs = np.nonzero(whole)
    room = np.zeros((ys.max() + 3, xs.max() + 3), bool)  # two pixels past the pieces, as far as the closing sees
    room[: mask.shape[0], : mask.shape[1]] = whole[: room.shape[0], : room.shape[1]]
    for size in BRIDGES:
        closed = close_disc(room, size)
        if components(closed).max() == 1:
            out = np.zeros_like(mask)
            part = filled(closed)[: mask.shape[0], : mask.shape[1]]
            out[: part.shape[0], : part.shape[1]] = part
            return out
    best = max(range(1, int(pieces.max()) + 1), key=lambda c: abs(shoelace(_border(pieces == c))))
    return filled(pieces == best)


def settled_labels(img: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels as whole pieces, later ones over earlier ones; what they leave of free space are fragments, each of which
    joins the nearest label."""
    cover = np.zeros_like(labels)
    halo = BRIDGES[-1] + 1  # a closing sees no further than its disc's width
    for c, (y0, y1, x0, x1) in boxes(labels).items():
        part = slice(max(0, y0 - halo), y1 + 3), slice(max(0, x0 - halo), x1 + 3)
        cover[part][bridged(labels[part] == c)] = c
    return merge_fragments_fixed(cover, components((img > 127) & (cover == 0)))


def expanded(ring: np.ndarray, img: np.ndarray) -> np.ndarray:
    """A lattice ring of unit steps, its corners taken as pixels, one pixel wider where a step touches free space and
    what lies beyond isn't free: the contour of the pixels."""
    x0, y0 = np.maximum(ring.min(axis=0) - 2, 0)  # all that the ring can meet
    x1, y1 = ring.max(axis=0) + 3
    img, ring = img[y0:y1, x0:x1], ring - (x0, y0)
    h, w = img.shape
    mask = fill_polygon(ring, h, w)
    step = np.roll(ring, -1, axis=0) - ring
    beyond = np.stack([step[:, 1], -step[:, 0]], axis=1) * int(np.sign(shoelace(ring)))
    ends = np.stack([ring, ring + step])

    def free(p: np.ndarray, outside: bool) -> np.ndarray:
        x, y = p[..., 0], p[..., 1]
        held = (x >= 0) & (y >= 0) & (x < w) & (y < h)
        return np.where(held, img[y.clip(0, h - 1), x.clip(0, w - 1)] == 255, outside)

    moved = (ends + beyond)[:, free(ends, False).any(axis=0)].reshape(-1, 2)
    moved = moved[~free(moved, True)]
    drawn = np.concatenate([ring[(ring[:, 0] < w) & (ring[:, 1] < h)], moved])
    mask[drawn[:, 1], drawn[:, 0]] = True
    return outer_contour(mask) + (x0, y0)


def final_polygons(img: np.ndarray, labels: np.ndarray) -> dict[int, np.ndarray]:
    """Label -> contour in pixels: whole pieces with their fragments, shared borders, widened to the walls."""
    return {c: expanded(ring, img) for c, ring in polygons(settled_labels(img, labels)).items()}


def merge_segments(lines: list[tuple[int, int, int, int]], gap: int = 3) -> list[tuple[int, int, int, int] | None]:
    """Upright or level segments (x0, y0, x1, y1) on one line whose facing ends lie within the gap become one, in
    order, until none does; the place of one that went holds null. Deep overlaps are no facing ends."""
    held: list = list(lines)

    def joined(a: tuple, b: tuple) -> tuple | None:
        for run, line in ((0, 1), (1, 0)):
            if len({a[line], a[line + 2], b[line], b[line + 2]}) == 1:
                (a0, a1), (b0, b1) = sorted(a[run::2]), sorted(b[run::2])
                if min(abs(a1 - b0), abs(b1 - a0)) <= gap:
                    lo, hi = min(a0, b0), max(a1, b1)
                    return (lo, a[1], hi, a[1]) if run == 0 else (a[0], lo, a[0], hi)
        return None

    todo = True
    while todo:
        todo = False
        for i in range(len(held)):
            for j in range(i + 1, len(held)):
                one = joined(held[i], held[j]) if held[i] and held[j] else None
                if one:
                    held[i], held[j], todo = one, None, True
    return held


def fallback_color(room: int, near: list[int], colors: int = 5) -> int:
    """When all colours are taken: among those with fewest conflicts the (room modulo their number)-th."""
    hits = [near.count(c) for c in range(colors)]
    least = [c for c in range(colors) if hits[c] == min(hits)]
    return least[room % len(least)]


def color_one(room: int, graph: dict[int, list[int]], colors: dict[int, int], n: int = 5) -> int:
    near = [colors[v] for v in graph.get(room, []) if v in colors and colors[v] is not None]
    free = [c for c in range(n) if c not in near]
    return free[0] if free else fallback_color(room, near, n)


def greedy_colors(graph: dict[int, list[int]], n: int = 5) -> dict[int, int]:
    """Rooms by ascending degree, then index, take the smallest free colour."""
    colors: dict[int, int] = {}
    for room in sorted(graph, key=lambda v: (len(graph[v]), v)):
        colors[room] = color_one(room, graph, colors, n)
    return colors


def repair_colors(graph: dict[int, list[int]], colors: dict[int, int], rounds: int = 100, n: int = 5) -> dict[int, int]:
    """Rooms in conflict are coloured anew in index order until none is (or after so many rounds)."""
    colors = dict(colors)
    for _ in range(rounds):
        changed = False
        for room in sorted(graph):
            if any(colors.get(v) == colors.get(room) for v in graph[room] if v != room):
                new = color_one(room, graph, {k: c for k, c in colors.items() if k != room}, n)
                changed |= new != colors[room]
                colors[room] = new
        if not changed:
            break
    return colors


def dfs_order(graph: dict[int, list[int]], start: int | None = None) -> list[int]:
    """Preorder; neighbours and further components by descending degree, then index."""
    seen: set[int] = set()
    order: list[int] = []
    rank = lambda v: (-len(graph[v]), v)
    first = [start] if start in graph else []
    for root in [*first, *sorted(graph, key=rank)]:
        stack = [root]
        while stack:
            v = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            order.append(v)
            stack.extend(sorted((u for u in graph[v] if u not in seen), key=rank, reverse=True))
    return order


def grow_regions(mask: np.ndarray, seeds: np.ndarray, iterations: int) -> np.ndarray:
    """Synchronous growth of labels inside a mask; the smallest neighbouring label wins."""
    out = np.where(mask | (seeds > 0), seeds, 0)
    for _ in range(iterations):
        top = np.iinfo(out.dtype).max
        best = np.full_like(out, top)
        for dy, dx in EIGHT:
            near = shifted(out, dy, dx)
            best = np.minimum(best, np.where(near > 0, near, top))
        new = (out == 0) & mask & (best < top)
        if not new.any():
            break
        out = np.where(new, best, out)
    return out


def bresenham(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    err, out = dx + dy, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * err
        if twice >= dy:
            err += dy
            x0 += sx
        if twice <= dx:
            err += dx
            y0 += sy


def draw_line(shape: tuple[int, int], p: tuple[int, int], q: tuple[int, int], thickness: int = 2) -> np.ndarray:
    """A line's pixels, each widened to a square of `thickness`, up and to the left for the even part."""
    out = np.zeros(shape, bool)
    lo, hi = -(thickness // 2), thickness - thickness // 2
    for x, y in bresenham(*p, *q):
        out[max(0, y + lo) : max(0, y + hi), max(0, x + lo) : max(0, x + hi)] = True
    return out


def contour_mask(points: list[tuple[int, int]], h: int, w: int) -> np.ndarray:
    """Pixels inside a contour of pixels or on its border; fewer than three vertices give none."""
    mask = np.zeros((h, w), bool)
    if len(points) < 3:
        return mask
    mask |= fill_polygon(np.array(points) + 0.5, h, w)
    for p, q in zip(points, [*points[1:], points[0]]):
        for x, y in bresenham(*p, *q):
            if 0 <= y < h and 0 <= x < w:
                mask[y, x] = True
    return mask


def _from_ring(px: np.ndarray, py: np.ndarray, ring: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Which points lie inside a ring (even-odd), and how far all are from its edges."""
    inside, far = np.zeros(len(px), bool), np.full(len(px), np.inf)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / size, 0.0, 1.0) if size else 0.0
        far = np.minimum(far, np.hypot(px - (ax + t * dx), py - (ay + t * dy)))
        if dy:
            inside ^= ((ay > py) != (by > py)) & (px < dx * (py - ay) / dy + ax)
    return inside, far


def clearest_point(ring: list[tuple[float, float]], others: list[list[tuple[float, float]]], least: float, grid: int) -> tuple[float, float] | None:
    """Of a grid over a ring's box, the point inside that is farthest from its edges (within a billionth the first by x,
    then y): farther than `least`, and farther than that from every other ring and outside it. None without one."""
    if not ring:
        return None
    (x0, y0), (x1, y1) = np.min(ring, axis=0), np.max(ring, axis=0)
    steps = np.arange(grid)
    px, py = np.repeat(x0 + (x1 - x0) * steps / (grid - 1), grid), np.tile(y0 + (y1 - y0) * steps / (grid - 1), grid)
    good, far = _from_ring(px, py, ring)
    good &= far > least
    for other in others:
        if other:
            inside, off = _from_ring(px, py, other)
            good &= ~inside & (off > least)
    if not good.any():
        return None
    k = int(np.argmax(np.where(good, np.round(far, 9), -1.0)))
    return float(px[k]), float(py[k])
