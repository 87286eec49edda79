"""Maps in tiles give what whole maps give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators import raster as R
from gridloom.operators import tiles as T
from gridloom.sources.scratch import stored


def noisy(rng, h, w, free=0.7):
    """Raw pixels: blobs of wall, unknown and free of all sizes."""
    coarse = rng.choice([0, 247, 254], (h // 7 + 1, w // 7 + 1), p=[0.2, 0.1, 0.7])
    img = np.kron(coarse, np.ones((7, 7), int))[:h, :w]
    fine = rng.random((h, w))
    return np.where(fine < 0.06, 0, np.where(fine < 0.1, 247, np.where(fine < 0.2, 254, img))).astype(np.uint8)


def table(spark, images):
    return spark.createDataFrame([(i, *img.shape, img.tobytes()) for i, img in enumerate(images)], "map_id int, h int, w int, data binary")


def whole(row, name="data", kind=np.uint8):
    return np.frombuffer(row[name], kind).reshape(row.h, row.w)


@pytest.mark.parametrize("size", [40, 97])
def test_cleaning(spark, size):
    rng = np.random.default_rng(size)
    images = [noisy(rng, 230, 170), noisy(rng, 95, 310), noisy(rng, 20, 30), np.zeros((90, 90), np.uint8), np.full((1, 200), 254, np.uint8)]
    got = {(r.map_id, r.layer): whole(r) for r in R.preprocessed(table(spark, images), tile=size).collect()}
    assert len(got) == 3 * len(images)
    for i, img in enumerate(images):
        for name, want in zip(("cleaned", "cleaned2", "input"), K.preprocess(img)):
            assert np.array_equal(got[i, name], want), (i, name)


def test_reach_is_needed(spark):
    """A long thin component of 30 pixels lies within the reach, whatever tiles it crosses."""
    img = np.full((80, 200), 254, np.uint8)
    img[40, 60:90] = 0
    img[20, 100:131] = 247
    got = {r.layer: whole(r) for r in T.preprocessed(table(spark, [img]), size=16).collect()}
    assert all(np.array_equal(got[name], want) for name, want in zip(("cleaned", "cleaned2", "input"), K.preprocess(img)))


def spiral(n):
    img = np.zeros((n, n), np.uint8)
    y, x, dy, dx = 0, 0, 0, 1
    for leg in range(n - 1, 0, -2):
        for _ in range(2):
            for _ in range(leg):
                img[y, x] = 255
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
    return img


@pytest.mark.parametrize("size", [16, 33])
def test_components(spark, size):
    rng = np.random.default_rng(size)
    images = [np.where(rng.random((100, 120)) < 0.4, 255, 0).astype(np.uint8), np.where(rng.random((70, 40)) < 0.6, 255, 0).astype(np.uint8), spiral(90), np.full((50, 50), 255, np.uint8), np.zeros((64, 64), np.uint8), np.where(rng.random((60, 60)) < 0.4, 90, 0).astype(np.uint8), np.eye(80, dtype=np.uint8) * 255]
    got = {r.map_id: whole(r, "labels", "<i4") for r in R.component_labels(table(spark, images), tile=size).collect()}
    for i, img in enumerate(images):
        mask = img >= 200
        assert np.array_equal(got[i], K.components(mask if mask.any() else img > 0)), i


def test_large_map_in_tiles(spark):
    """4096 x 4096 pixels in 16 tiles: layers and components as on the whole map."""
    rng = np.random.default_rng(1)
    img = noisy(rng, 4096, 4096)
    maps = table(spark, [img])
    assert T.cut(maps, 1024).count() == 16
    got = {r.layer: whole(r) for r in R.preprocessed(maps).collect()}
    layers = dict(zip(("cleaned", "cleaned2", "input"), K.preprocess(img)))
    assert all(np.array_equal(got[k], v) for k, v in layers.items())
    row = R.component_labels(table(spark, [layers["input"]])).first()
    assert np.array_equal(whole(row, "labels", "<i4"), K.components(layers["input"] >= 200))


def test_tiles_are_dealt_over_tasks(spark):
    """Tiles are few bytes, so Spark would put them all into one task; a map's greatest value is known to each."""
    dark, lit = np.full((40, 40), 90, np.uint8), np.zeros((40, 40), np.uint8)
    lit[39, 39] = 255
    tiles = T.cut(table(spark, [dark, lit]), 10)
    assert tiles.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.map_id, r.top) for r in tiles.collect()} == {(0, 90), (1, 255)} and tiles.count() == 32


def test_connected(spark):
    """A long chain, a star, a ring and pairs of another map."""
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    pairs = [(1, names[i], names[i + 1]) for i in range(199)] + [(1, names[250], names[i]) for i in range(251, 300)] + [(1, names[300 + i], names[300 + (i + 1) % 50]) for i in range(50)] + [(2, 5, 3), (2, 3, 9)]
    got = {(r.map_id, r.node): r.root for r in T.connected(spark.createDataFrame(pairs, "map_id int, a long, b long")).collect()}
    for part in (names[:200], names[250:300], names[300:350]):
        assert {got[1, v] for v in part} == {min(part)}
    assert {got[2, v] for v in (3, 5, 9)} == {3} and len(got) == 303


def test_spark_forms_make_the_layers(spark):
    """The relational forms of the steps, one after the other, give the layers of the kernel."""
    rng = np.random.default_rng(4)
    images = [noisy(rng, 40, 50), noisy(rng, 31, 23)]
    maps = table(spark, images)
    sizes = maps.select("map_id", "h", "w")
    px = stored(R.unpack(maps).withColumn("v", R.remapped(F.col("v"))))
    walls = R.unpack_labels(R.components_of(R.pack(px), K.WALL))
    gone = R.interior_noise(px, walls).withColumn("gone", F.lit(1))
    cleaned = stored(px.join(gone, R.AT, "left").select(*R.AT, F.when(F.col("gone") == 1, 255).otherwise(F.col("v")).alias("v")))
    unknown = stored(R.unpack_labels(R.components_of(R.pack(cleaned), K.UNKNOWN)))
    taken = unknown.join(R.unknown_noise(cleaned, unknown).select("map_id", "lid", F.col("v").alias("new")), ["map_id", "lid"]).select(*R.AT, "new")
    cleaned2 = stored(cleaned.join(taken, R.AT, "left").select(*R.AT, F.coalesce("new", "v").alias("v")))
    done = R.wall_completion(cleaned2).withColumn("wall", F.lit(1))
    full = stored(cleaned2.join(done, R.AT, "left").select(*R.AT, F.when(F.col("wall") == 1, 0).otherwise(F.col("v")).alias("v")))
    wall = full
    as_wall = lambda df: df.select(*R.AT, F.when(F.col("wall") == 1, 0).otherwise(255).alias("v"))
    for _ in range(2):
        wall = stored(as_wall(R.closed(as_wall(R.closed(wall, "x")), "y")))
    for _ in range(4):
        wall = stored(wall.join(R.burrs(wall, sizes).withColumn("burr", F.lit(1)), R.AT, "left").select(*R.AT, F.when(F.col("burr") == 1, 255).otherwise(F.col("v")).alias("v")))
    smooth = R.blurred(wall, sizes).select(*R.AT, (F.col("g") > 0.5).cast("int").alias("wall"))
    layers = (cleaned, cleaned2, R.recomposed(full, smooth))
    for layer, k in zip(layers, range(3)):
        for r in R.pack(layer).collect():
            assert np.array_equal(whole(r), K.preprocess(images[r.map_id])[k]), k
