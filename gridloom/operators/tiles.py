"""Large maps in tiles, so that one map isn't one task.

Local steps run on tiles with a halo: what lies further away than the halo can't reach the tile's own pixels, and where
a map ends the crop ends too, so each tile gives what the whole map gives there. Components are labelled tile by tile;
labels that touch across a border are pairs, and pointer doubling over those pairs gives each label its component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, stored
from . import kernels as K
from .raster import array_of, met, per_map, spread

#: Rows and columns of a tile.
TILE = 1024


def cut(rasters: DataFrame, size: int = TILE, halo: int = 0) -> DataFrame:
    """rasters -> map_id (with ty, tx: the tile's place), y, x (its first own pixel), oh, ow (own rows and columns),
    up, left (halo before them), h, w, data (with the halo), mh, mw (the map's size), top (its greatest value). Tiles are
    few bytes of much work, so they are dealt over all tasks."""

    def kernel(row: dict) -> Iterator[dict]:
        img = array_of(row)
        top = int(img.max(initial=0))
        for y in range(0, row["h"], size):
            for x in range(0, row["w"], size):
                up, left = min(halo, y), min(halo, x)
                part = img[y - up : y + size + halo, x - left : x + size + halo]
                yield {
                    "ty": y // size, "tx": x // size, "y": y, "x": x, "oh": min(size, row["h"] - y), "ow": min(size, row["w"] - x),
                    "up": up, "left": left, "h": part.shape[0], "w": part.shape[1], "data": part.tobytes(), "mh": row["h"], "mw": row["w"], "top": top,
                }

    return spread(per_map(rasters, kernel, "ty int, tx int, y int, x int, oh int, ow int, up int, left int, h int, w int, data binary, mh int, mw int, top int"), "map_id", "ty", "tx")


def over_tiles(tiles: DataFrame, kernel: Callable[[dict, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """kernel(row, image with halo) -> rows for every tile by itself: map_id, ty, tx, then the schema's columns."""

    def run(row: dict) -> Iterator[dict]:
        for got in kernel(row, array_of(row)):
            yield {"ty": row["ty"], "tx": row["tx"], **got}

    return per_map(tiles, run, f"ty int, tx int, {schema}")


def own(row: dict, img: np.ndarray) -> np.ndarray:
    """A tile's own pixels."""
    return img[row["up"] : row["up"] + row["oh"], row["left"] : row["left"] + row["ow"]]


def assembled(tiles: DataFrame, name: str = "data", width: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tiles (map_id, keys, y, x, oh, ow, mh, mw and packed own pixels) -> one packed raster a map: h, w and the column."""
    held = tiles.groupBy("map_id", *keys).agg(F.first("mh").alias("h"), F.first("mw").alias("w"), F.collect_list(F.struct("y", "x", "oh", "ow", name)).alias("tiles"))

    def kernel(row: dict) -> Iterator[dict]:
        out = np.zeros((row["h"], row["w"]), f"<u{width}")
        for t in row["tiles"]:
            out[t["y"] : t["y"] + t["oh"], t["x"] : t["x"] + t["ow"]] = np.frombuffer(t[name], f"<u{width}").reshape(t["oh"], t["ow"])
        yield {**{k: row[k] for k in keys}, "h": row["h"], "w": row["w"], name: out.tobytes()}

    return per_map(held, kernel, ", ".join([*(f"{k} string" for k in keys), f"h int, w int, {name} binary"]))


def chain_reach(max_area: int = 30, iterations: int = 2, smooth: int = 2, burr: int = 4) -> int:
    """How far the cleaning sees: a small component's length and the space round it, twice, a wall's completion, the
    closings along both axes (two pixels each), the burrs and the blur."""
    return (max_area + 2 * iterations + 1) + (max_area + 2) + 1 + (2 * smooth + burr + 1 + 1)


def preprocessed(rasters: DataFrame, max_area: int = 30, iterations: int = 2, smooth: int = 2, burr: int = 4, size: int = TILE) -> DataFrame:
    """As raster.preprocessed (map_id, layer, h, w, data), tile by tile."""
    place = ["y", "x", "oh", "ow", "mh", "mw"]

    def kernel(row: dict, img: np.ndarray) -> Iterator[dict]:
        for name, layer in zip(("cleaned", "cleaned2", "input"), K.preprocess(img, max_area, iterations, smooth, burr)):
            yield {"layer": name, **{k: row[k] for k in place}, "data": own(row, layer).tobytes()}

    tiles = cut(rasters, size, chain_reach(max_area, iterations, smooth, burr))
    return assembled(over_tiles(tiles, kernel, "layer string, y int, x int, oh int, ow int, mh int, mw int, data binary"), keys=("layer",))


def connected(pairs: DataFrame) -> DataFrame:
    """pairs(map_id, a, b) -> map_id, node, root: the smallest node of each node's component. Every round each node
    takes the smallest root among its neighbours' and then its root's own root."""
    both = pairs.select("map_id", "a", "b").unionByName(pairs.select("map_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    state = stored(both.groupBy("map_id", F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = met(both, state.select("map_id", F.col("node").alias("b"), "root"), ["map_id", "b"]).groupBy("map_id", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = met(state, near, ["map_id", "node"]).select("map_id", "node", "root", F.least("root", "near").alias("low"))
        # a root's own new root; roots are nodes themselves
        jump = low.select("map_id", F.col("node").alias("low"), F.col("low").alias("top"))
        after = stored(met(low, jump, ["map_id", "low"]).select("map_id", "node", F.col("root").alias("before"), F.col("top").alias("root")))
        release(state)
        if after.where("root != before").isEmpty():
            release(both)
            return after.select("map_id", "node", "root")
        state = after


def component_tiles(rasters: DataFrame, least: int = 200, size: int = TILE) -> DataFrame:
    """8-connected components of the pixels of at least `least` (of a map without any, of all above 0): map_id, ty, tx,
    y, x, oh, ow, mh, mw and labels (own pixels, four bytes each), numbered over the whole map by first pixel."""
    def label(row: dict, img: np.ndarray) -> Iterator[dict]:
        labels = K.components(img >= least if row["top"] >= least else img > 0)
        # a node is a local component's first pixel; borders are the pixels on the tile's sides that a map's neighbour may touch
        first = np.zeros(int(labels.max()) + 1, np.int64)
        flat = labels.ravel()
        at = np.flatnonzero(flat)
        names, index = np.unique(flat[at], return_index=True)
        y, x = np.divmod(at[index], row["ow"])
        first[names] = (y + row["y"]) * row["mw"] + x + row["x"]
        side = np.zeros(labels.shape, bool)
        side[[0, -1]] = side[:, [0, -1]] = True
        ys, xs = np.nonzero(side & (labels > 0))
        rim = [{"y": int(a + row["y"]), "x": int(b + row["x"]), "node": int(first[labels[a, b]])} for a, b in zip(ys, xs)]
        yield {**{k: row[k] for k in ("y", "x", "oh", "ow", "mh", "mw")}, "labels": labels.astype("<i4").tobytes(), "nodes": first[1:].tolist(), "rim": rim}

    found = stored(over_tiles(cut(rasters, size), label, "y int, x int, oh int, ow int, mh int, mw int, labels binary, nodes array<long>, rim array<struct<y:int,x:int,node:long>>"))
    rim = found.select("map_id", "ty", "tx", F.explode("rim").alias("p")).select("map_id", "ty", "tx", "p.*")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    ahead = rim.withColumn("s", steps).select("map_id", F.col("ty").alias("ty0"), F.col("tx").alias("tx0"), F.col("node").alias("a"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    pairs = met(ahead, rim.withColumnRenamed("node", "b"), ["map_id", "y", "x"]).where("ty != ty0 OR tx != tx0")
    roots = connected(pairs.select("map_id", "a", "b").distinct())
    nodes = met(found.select("map_id", "ty", "tx", F.posexplode("nodes").alias("k", "node")), roots, ["map_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    number = nodes.select("map_id", "root").distinct().withColumn("lid", F.row_number().over(Window.partitionBy("map_id").orderBy("root")))
    names = met(nodes, number, ["map_id", "root"]).groupBy("map_id", "ty", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lid"))), lambda v: v["lid"]).alias("lids"))

    def renamed(row: dict) -> Iterator[dict]:
        lids = np.array([0, *(row["lids"] or ())], np.int32)
        yield {**{k: row[k] for k in ("ty", "tx", "y", "x", "oh", "ow", "mh", "mw")}, "labels": lids[np.frombuffer(row["labels"], "<i4")].astype("<i4").tobytes()}

    held = met(found.drop("nodes", "rim"), names, ["map_id", "ty", "tx"], "left")
    return per_map(held, renamed, "ty int, tx int, y int, x int, oh int, ow int, mh int, mw int, labels binary")


def component_labels(rasters: DataFrame, least: int = 200, size: int = TILE) -> DataFrame:
    """As raster.component_labels (map_id, h, w, labels), tile by tile."""
    return assembled(component_tiles(rasters, least, size), "labels", 4)
