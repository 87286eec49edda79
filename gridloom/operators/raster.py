"""Raster operators: packed rasters (one row a map, no shuffle) and pixel tables (relational, for sets of pixels).

rasters(map_id, h, w, data): row-major bytes. labels are packed alike, four bytes a pixel, little endian, 0 for none.
pixels(map_id, y, x, v) and regions(map_id, y, x, lid) are their exploded forms; regions leaves 0 out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import kernels as K

AT = ["map_id", "y", "x"]
#: Bytes of rows that go to a Python worker, or come back, at a time; a larger row goes alone.
ARROW_BYTES = 16 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def per_map(rasters: DataFrame, kernel: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """kernel(row) -> rows, for each map by itself; map_id is put in front of what it yields."""
    key = rasters.schema["map_id"]
    out = StructType([StructField("map_id", key.dataType), *_parse_datatype_string(f"struct<{schema}>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one map's objects at a time
                row = batch.slice(i, 1).to_pylist()[0]
                columns: dict[str, list] = {f.name: [] for f in arrow}
                for got in kernel(row):
                    columns["map_id"].append(row["map_id"])
                    for k, v in got.items():
                        columns[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    conf = rasters.sparkSession.conf  # by rows alone, large rasters would make batches of any size
    if rasters.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_ARROW).strip()) > ARROW_BYTES:
        conf.set(_ARROW, ARROW_BYTES)
    return rasters.mapInArrow(run, out)


def met(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """left.join(right) by sorting both. Spark's estimate of a table doesn't count what an explode adds, so tables of
    pixels, and what is derived from them, would pass for small and be broadcast, whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows that become much work, dealt over as many tasks as a shuffle has: a small file is one task, and small
    parts of a shuffle are put together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def array_of(row: dict, name: str = "data", kind=np.uint8) -> np.ndarray:
    return np.frombuffer(row[name], kind).reshape(row["h"], row["w"])


def pack(pixels: DataFrame, value: str = "v") -> DataFrame:
    """pixels -> rasters; every pixel of the rectangle must be there."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    joined = F.array_join(F.transform(ordered, lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0")), "")
    return pixels.groupBy("map_id").agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), F.unhex(joined).alias("data"))


def drawn(h: int, w: int, value: Callable[[Column, Column], Column]) -> Column:
    """Packed bytes of a raster whose pixels (two hex digits each) follow from y, x and the row's own columns: nothing is
    exploded or gathered."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: value(F.floor(i / w).cast("int"), i % w))
    return F.unhex(F.array_join(cells, ""))


def _explode(rows: DataFrame, name: str, value: str, kind, keep_zero: bool, sql: str) -> DataFrame:
    key = rows.schema["map_id"]
    out = StructType([StructField("map_id", key.dataType), *_parse_datatype_string(f"struct<y:int,x:int,{value}:{sql}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                a = array_of(row, name, kind)
                ys, xs = np.nonzero(np.ones_like(a, bool) if keep_zero else a)
                ids = pa.array([row["map_id"]] * len(ys), batch.schema.field("map_id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(ys.astype(np.int32)), pa.array(xs.astype(np.int32)), pa.array(a[ys, xs].astype(np.int32))], names=[*AT, value])

    return rows.select("map_id", "h", "w", name).mapInArrow(run, out)


def unpack(rasters: DataFrame) -> DataFrame:
    return _explode(rasters, "data", "v", np.uint8, True, "int")


def unpack_labels(rows: DataFrame, name: str = "labels") -> DataFrame:
    return _explode(rows, name, "lid", np.int32, False, "int")


def remapped(v: Column) -> Column:
    """Raw pixel to wall 0, unknown 127, free 255."""
    return F.when(v == 254, 255).when(v == 247, 127).otherwise(0)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.rint(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def free_pixels(pixels: DataFrame, least: int = 200) -> DataFrame:
    """Pixels of at least `least`; of maps that have none, all above 0."""
    any_free = F.max((F.col("v") >= least).cast("int")).over(Window.partitionBy("map_id"))
    return pixels.withColumn("_any", any_free).where(F.when(F.col("_any") == 1, F.col("v") >= least).otherwise(F.col("v") > 0)).drop("_any")


def _by_size(rasters: DataFrame, tile: int, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Maps that fit a tile each in one task, larger ones in tiles. Tiles are planned only where there are such maps."""
    fits = (F.col("h") <= tile) & (F.col("w") <= tile)
    rest = rasters.where(~fits)
    done = small(rasters.where(fits))
    return done if rest.isEmpty() else done.unionByName(large(rest))


def component_labels(rasters: DataFrame, least: int = 200, tile: int = 1024) -> DataFrame:
    """rasters -> map_id, h, w, labels: 8-connected components of free space."""
    from . import tiles

    def kernel(row: dict) -> Iterator[dict]:
        img = array_of(row)
        mask = img >= least
        yield {"h": row["h"], "w": row["w"], "labels": K.components(mask if mask.any() else img > 0).astype("<i4").tobytes()}

    return _by_size(rasters, tile, lambda r: per_map(r, kernel, "h int, w int, labels binary"), lambda r: tiles.component_labels(r, least, tile))


def components_of(rasters: DataFrame, value: int) -> DataFrame:
    """Components of the pixels with one value."""
    return per_map(rasters, lambda row: iter([{"h": row["h"], "w": row["w"], "labels": K.components(array_of(row) == value).astype("<i4").tobytes()}]), "h int, w int, labels binary")


def preprocessed(rasters: DataFrame, max_area: int = 30, iterations: int = 2, smooth: int = 2, burr: int = 4, tile: int = 1024) -> DataFrame:
    """Three rows a map: layers cleaned, cleaned2 and input. Maps of more than a tile are cleaned tile by tile."""
    from . import tiles

    def kernel(row: dict) -> Iterator[dict]:
        for name, img in zip(("cleaned", "cleaned2", "input"), K.preprocess(array_of(row), max_area, iterations, smooth, burr)):
            yield {"layer": name, "h": row["h"], "w": row["w"], "data": img.tobytes()}

    return _by_size(rasters, tile, lambda r: per_map(r, kernel, "layer string, h int, w int, data binary"), lambda r: tiles.preprocessed(r, max_area, iterations, smooth, burr, tile))


def offsets(radius: int, centre: bool = False) -> Column:
    """Array of (dy, dx) of a square."""
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if centre or dy or dx])


def around(pixels: DataFrame, radius: int = 1, centre: bool = False) -> DataFrame:
    """Each row once for every place of the square round it: y, x move there, y0, x0 stay."""
    moved = pixels.withColumn("_o", F.explode(offsets(radius, centre))).withColumnsRenamed({"y": "y0", "x": "x0"})
    return moved.withColumn("y", F.col("y0") + F.col("_o.dy")).withColumn("x", F.col("x0") + F.col("_o.dx")).drop("_o")


def dilated(pixels: DataFrame, radius: int) -> DataFrame:
    """Places within the square distance of any pixel: along rows first, then columns."""
    side = lambda name: F.explode(F.sequence(F.col(name) - radius, F.col(name) + radius))
    wide = pixels.select("map_id", "y", side("x").alias("x")).distinct()
    return wide.select("map_id", side("y").alias("y"), "x").distinct()


def interior_noise(pixels: DataFrame, walls: DataFrame, max_area: int = 30, reach: int = 4) -> DataFrame:
    """Pixels of small wall components (walls: map_id, y, x, lid) all of which lie near free space: they become free."""
    near = dilated(pixels.where("v = 255"), reach)
    marked = met(walls, near.withColumn("near", F.lit(1)), AT, "left")
    good = marked.groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("near", F.lit(0))).alias("near")).where((F.col("n") <= max_area) & (F.col("near") == 1))
    return met(walls, good.select("map_id", "lid"), ["map_id", "lid"], "left_semi").select(*AT)


def unknown_noise(pixels: DataFrame, unknown: DataFrame, max_area: int = 30) -> DataFrame:
    """Small unknown components with the value they take: map_id, lid, n, v."""
    sizes = unknown.groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_area)
    ring = around(unknown).select("map_id", "lid", "y", "x").distinct()
    ring = met(met(ring, unknown, ["map_id", "lid", "y", "x"], "left_anti"), pixels, AT)
    votes = ring.groupBy("map_id", "lid").agg(F.sum((F.col("v") == 0).cast("int")).alias("walls"), F.sum((F.col("v") == 255).cast("int")).alias("frees"))
    taken = F.when(F.coalesce("walls", F.lit(0)) > F.coalesce("frees", F.lit(0)), 0).otherwise(255)
    return met(sizes, votes, ["map_id", "lid"], "left").select("map_id", "lid", F.col("n").cast("long"), taken.alias("v"))


def wall_completion(pixels: DataFrame) -> DataFrame:
    """Free pixels beside unknown ones."""
    near = around(pixels.where("v = 127").select(*AT)).select(*AT).distinct()
    return met(pixels.where("v = 255").select(*AT), near, AT, "left_semi")


def closed(pixels: DataFrame, axis: str) -> DataFrame:
    """Wall flag after closing by three along an axis ('x' or 'y'): running maximum, then minimum."""
    other = "y" if axis == "x" else "x"
    line = Window.partitionBy("map_id", other).orderBy(axis).rowsBetween(-1, 1)
    grown = pixels.withColumn("wall", (F.col("v") == 0).cast("int")).withColumn("wall", F.max("wall").over(line))
    return grown.withColumn("wall", F.min("wall").over(line)).select(*AT, "wall")


def _mirror(column: Column, last: Column) -> Column:
    return F.when(column < 0, -column).when(column > last, 2 * last - column).otherwise(column)


def mirrored_around(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each pixel with the places of its 3 x 3 square, mirrored at the border: dy, dx, and the place's y, x."""
    moved = met(pixels, sizes, "map_id").withColumn("_o", F.explode(offsets(1, True))).withColumnsRenamed({"y": "y0", "x": "x0"})
    return moved.select("map_id", "y0", "x0", F.col("_o.dy").alias("dy"), F.col("_o.dx").alias("dx"), _mirror(F.col("y0") + F.col("_o.dy"), F.col("h") - 1).alias("y"), _mirror(F.col("x0") + F.col("_o.dx"), F.col("w") - 1).alias("x"))


def burrs(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Wall pixels with at most one wall neighbour: what one pruning pass deletes."""
    walls = pixels.where("v = 0").select(*AT)
    near = met(mirrored_around(walls, sizes).where("dy != 0 OR dx != 0"), walls, AT, "left_semi")
    count = near.groupBy("map_id", F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return met(walls, count, AT, "left").where(F.coalesce("n", F.lit(0)) <= 1).select(*AT)


def blurred(pixels: DataFrame, sizes: DataFrame, sigma: float = 0.8) -> DataFrame:
    """3 x 3 Gaussian of the wall mask, mirrored at the border: map_id, y, x, g."""
    k = K.gauss_kernel(sigma)
    weight = lambda d: F.when(d == 0, float(k[1])).otherwise(float(k[0]))
    walls = pixels.where("v = 0").select(*AT)
    hit = met(mirrored_around(pixels.select(*AT), sizes), walls, AT, "left_semi").withColumn("g", weight(F.col("dy")) * weight(F.col("dx")))
    total = hit.groupBy("map_id", F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.sum("g").alias("g"))
    return met(pixels.select(*AT), total, AT, "left").select(*AT, F.coalesce("g", F.lit(0.0)).alias("g"))


def recomposed(pixels: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Pixels after a new wall mask (map_id, y, x, wall): new walls, and lost walls by whether free space is near."""
    near = around(pixels.where("v = 255").select(*AT)).select(*AT).distinct().withColumn("near", F.lit(True))
    joined = met(met(pixels, smoothed, AT), near, AT, "left")
    new, old = F.col("wall") == 1, F.col("v") == 0
    v = F.when(new & ~old, 0).when(old & ~new & F.coalesce("near", F.lit(False)), 255).when(old & ~new, 127).otherwise(F.col("v"))
    return joined.select(*AT, v.alias("v"))


def disc_closed(rasters: DataFrame, value: int, size: int) -> DataFrame:
    """Pixels of a value closed by a disc of odd size, packed as 255 and 0; what lies outside neither grows nor shrinks."""

    def kernel(row: dict) -> Iterator[dict]:
        closed = K.close_disc(array_of(row) == value, size)
        yield {"h": row["h"], "w": row["w"], "data": (closed * np.uint8(255)).tobytes()}

    return per_map(rasters, kernel, "h int, w int, data binary")


def widened(data: Column) -> Column:
    """Packed bytes as packed labels, four bytes a pixel."""
    return F.unhex(F.regexp_replace(F.hex(data), "(..)", "$1000000"))
