"""Rasters, rooms, detections and requests derived from the star-schema tables, for checks against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import raster

WIDTH, HEIGHT = 64, 48
RESOLUTION = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for every nation and for every 60 customers: their number grows with the table."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("map_id"))
    return nations.union(table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 60).cast("int"))).distinct()


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 48 map each: a grid of rooms with doors, and noise from part sizes (a part has a place in
    25 maps, so the noise stays as dense)."""
    held = maps(spark, sf_dir)
    number = held.count()
    cells = raster.spread(held, "map_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))))
    noise = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("j"))
    noise = noise.withColumn("map_id", F.pmod(F.col("p_partkey") + F.col("j"), F.lit(number)).cast("int"))
    noise = noise.groupBy("map_id", F.pmod(F.col("p_partkey") + 17 * F.col("map_id"), F.lit(WIDTH * HEIGHT)).cast("int").alias("i")).agg(F.min("p_size").alias("s"))
    x, y = F.col("i") % WIDTH, F.floor(F.col("i") / WIDTH).cast("int")
    door = (x % 16 == 0) & ((y + F.col("map_id")) % 12 == 5) & (x % 32 == 0) & (x > 0)
    v = F.when(((x % 16 == 0) | (y % 12 == 0)) & ~door, 0).when(F.col("s") <= 2, 0).when(F.col("s") >= 49, 247).otherwise(254)
    return raster.met(cells, noise, ["map_id", "i"], "left").select("map_id", y.alias("y"), x.alias("x"), v.alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_pixels(spark, sf_dir).withColumn("v", raster.remapped(F.col("v")))


def rasters(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    return raster.pack(raw_pixels(spark, sf_dir) if raw else pixels(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.unpack_labels(raster.component_labels(rasters(spark, sf_dir)))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps(spark, sf_dir).select("map_id", F.lit(HEIGHT).alias("h"), F.lit(WIDTH).alias("w"))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on the cell grid from supplier keys: map_id, pos, corner pixels, id, name, flat geometry."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_nationkey").alias("map_id"))
    x0, y0 = F.pmod(F.col("k") * 7, F.lit(40)), F.pmod(F.col("k") * 11, F.lit(30))
    x1, y1 = x0 + 4 + F.pmod(F.col("k"), F.lit(9)), y0 + 4 + F.pmod(F.col("k"), F.lit(7))
    corners = s.select("map_id", F.col("k").alias("pos"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    points = F.array(*[G.point(F.col(a) * RESOLUTION, F.col(b) * RESOLUTION) for a, b in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"))])
    rounded = F.transform(points, lambda p: G.point(F.round(p["x"], 3), F.round(p["y"], 3)))
    return corners.withColumn("geometry", G.flat(G.closed(rounded))).withColumn("id", F.format_string("ROOM_%03d", F.pmod("pos", F.lit(1000)).cast("int"))).withColumn("name", F.concat(F.lit("R"), F.col("pos").cast("string")))


def detections(spark: SparkSession, sf_dir: str, orders: int = 16, turned: bool = False) -> DataFrame:
    """A box for every line item, upright or turned by an angle of its key, and a map for every so many order keys: maps
    stay small, their number grows. Line numbers repeat within an order, so an order's items are counted anew."""
    li = table(spark, sf_dir, "lineitem")
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    k = F.col("_k")
    angle = F.pmod(k * 31, F.lit(628)) / 100 if turned else F.lit(0.0)
    cx, cy = F.pmod(F.col("l_partkey") * 13, F.lit(300)).cast("double"), F.pmod(F.col("l_suppkey") * 29, F.lit(200)).cast("double")
    channels = F.array(cx, cy, 10 + F.col("l_quantity"), 6 + F.col("l_quantity") / 2, (F.pmod(k * 7919, F.lit(100003)) / 100003).cast("double"), angle)
    boxes = li.withColumn("_k", F.col("l_orderkey") * 1000 + turn)
    return boxes.select(F.floor(F.col("l_orderkey") / orders).cast("int").alias("map_id"), k.alias("cell"), channels.alias("channels"))
