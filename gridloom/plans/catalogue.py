"""Named queries over the seeds, and the same as DuckDB SQL.

Each query applies library operators to rasters, rooms and detections derived from the driver's tables. The SQL starts
from the same derivation, written independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as G
from ..functions import labels as L
from ..operators import beautify as B
from ..operators import detections as D
from ..operators import extension as X
from ..operators import graph as N
from ..operators import kernels as K
from ..operators import landmarks as M
from ..operators import polygons as P
from ..operators import raster as R
from ..operators import regions as RG
from ..sources import maps as S
from ..sources import seed
from ..sources.scratch import fresh_path
from ..streaming import requests as stream
from . import requests as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RAW = """
m AS (SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation UNION SELECT CAST(c_custkey // 60 AS INTEGER) FROM customer), mc AS (SELECT count(*) AS maps FROM m),
cell AS (SELECT k, CAST(range AS INTEGER) AS i, CAST(range % 64 AS INTEGER) AS x, CAST(range // 64 AS INTEGER) AS y FROM m, range(3072)),
pk AS (SELECT CAST((p_partkey + range) % maps AS INTEGER) AS k, p_partkey, p_size FROM part, range(25), mc),
nz AS (SELECT k, CAST((p_partkey + 17 * k) % 3072 AS INTEGER) AS i, min(p_size) AS s FROM pk GROUP BY 1, 2),
raw AS (SELECT cell.k AS map_id, y, x, CASE WHEN (x % 16 = 0 OR y % 12 = 0) AND NOT (x % 16 = 0 AND (y + cell.k) % 12 = 5 AND x % 32 = 0 AND x > 0) THEN 0 WHEN s <= 2 THEN 0 WHEN s >= 49 THEN 247 ELSE 254 END AS v FROM cell LEFT JOIN nz ON nz.k = cell.k AND nz.i = cell.i),
px AS MATERIALIZED (SELECT map_id, y, x, CASE v WHEN 254 THEN 255 WHEN 247 THEN 127 ELSE 0 END AS v FROM raw)
"""
OFFSETS = "o8 AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE a.dy <> 0 OR b.dx <> 0)"


def _components(name: str, source: str) -> str:
    """CTEs: 8-connected components of source(map_id, y, x) as name(map_id, y, x, lid)."""
    # nodes are the runs of a row
    return f"""
{name}_g AS (SELECT map_id, y, x, x - row_number() OVER (PARTITION BY map_id, y ORDER BY x) AS g FROM {source}),
{name}_n AS MATERIALIZED (SELECT map_id, y, min(x) AS x0, max(x) AS x1, y * 64 + min(x) AS id FROM {name}_g GROUP BY map_id, y, g),
{name}_e AS MATERIALIZED (SELECT a.map_id, a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON b.map_id = a.map_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
{name}_r AS (SELECT map_id, id AS a, id AS b FROM {name}_n UNION SELECT r.map_id, r.a, e.b FROM {name}_r r JOIN {name}_e e ON e.map_id = r.map_id AND e.a = r.b),
{name}_m AS MATERIALIZED (SELECT map_id, b AS id, min(a) AS root FROM {name}_r GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT s.map_id, s.y, s.x, CAST(dense_rank() OVER (PARTITION BY s.map_id ORDER BY m.root) AS INTEGER) AS lid FROM {source} s JOIN {name}_n n ON n.map_id = s.map_id AND n.y = s.y AND s.x BETWEEN n.x0 AND n.x1 JOIN {name}_m m ON m.map_id = n.map_id AND m.id = n.id)"""


FREE = "fr AS (SELECT map_id, y, x FROM px WHERE v = 255)"
COMP = f"{RAW}, {OFFSETS}, {FREE}, {_components('lab', 'fr')}"
TILES = f"{RAW}, {OFFSETS}, t AS (SELECT map_id, y, x, CAST((y // 6) * 8 + x // 8 + 1 AS INTEGER) AS lid FROM px WHERE v = 255)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _regions(spark, sf_dir):
    return seed.regions(spark, sf_dir)


def _tiles(spark, sf_dir):
    """Free pixels dealt to tiles of 8 x 6: many small neighbouring regions."""
    free = seed.pixels(spark, sf_dir).where("v = 255")
    return free.select("map_id", "y", "x", (F.floor(F.col("y") / 6) * 8 + F.floor(F.col("x") / 8) + 1).cast("int").alias("lid"))


# --- rasters -------------------------------------------------------------------------------------------------------


@query(f"WITH {RAW} SELECT map_id, v, count(*) AS n FROM px GROUP BY 1, 2")
def pixel_remap_hist(spark, sf_dir):
    return seed.pixels(spark, sf_dir).groupBy("map_id", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RAW} SELECT map_id, round(avg(CASE WHEN v >= 200 THEN 1.0 ELSE 0.0 END), 6) AS free_ratio FROM px GROUP BY 1")
def free_ratio(spark, sf_dir):
    return seed.pixels(spark, sf_dir).groupBy("map_id").agg(F.round(F.avg((F.col("v") >= 200).cast("double")), 6).alias("free_ratio"))


@query(f"WITH RECURSIVE {COMP} SELECT map_id, y, x, lid FROM lab")
def components(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(f"WITH RECURSIVE {COMP} SELECT map_id, lid, count(*) AS n FROM lab GROUP BY 1, 2")
def component_sizes(spark, sf_dir):
    return _regions(spark, sf_dir).groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {COMP} SELECT map_id, lid, count(*) AS pixels, CAST(round(count(*) * (0.05 * 0.05), 6) AS DOUBLE) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab GROUP BY 1, 2 HAVING count(*) >= 39"""
)
def room_stats(spark, sf_dir):
    """Rooms of at least 0.1 square metres (39 pixels in doubles) with area, centre and box."""
    least = K.area_cutoff(0.1, seed.RESOLUTION)
    stats = RG.room_stats(_regions(spark, sf_dir), seed.RESOLUTION).where(F.col("pixels") >= least)
    return stats.withColumns({c: F.round(c, 6) for c in ("area", "cx", "cy")})


@query(
    f"""WITH RECURSIVE {RAW}, {OFFSETS}, wl AS (SELECT map_id, y, x FROM px WHERE v = 0), {_components("w", "wl")},
near AS (SELECT DISTINCT w.map_id, w.y, w.x FROM w JOIN px f ON f.map_id = w.map_id AND f.v = 255 AND abs(f.y - w.y) <= 4 AND abs(f.x - w.x) <= 4),
good AS (SELECT w.map_id, w.lid FROM w LEFT JOIN near n USING (map_id, y, x) GROUP BY 1, 2 HAVING count(*) <= 30 AND count(n.map_id) = count(*))
SELECT w.map_id, w.y, w.x FROM w JOIN good USING (map_id, lid)"""
)
def interior_noise(spark, sf_dir):
    walls = R.unpack_labels(R.components_of(seed.rasters(spark, sf_dir), K.WALL))
    return R.interior_noise(seed.pixels(spark, sf_dir), walls)


@query(
    f"""WITH RECURSIVE {RAW}, {OFFSETS}, ul AS (SELECT map_id, y, x FROM px WHERE v = 127), {_components("u", "ul")},
ring AS (SELECT DISTINCT u.map_id, u.lid, u.y + o.dy AS y, u.x + o.dx AS x FROM u, o8 o),
votes AS (SELECT r.map_id, r.lid, sum(CASE WHEN p.v = 0 THEN 1 ELSE 0 END) AS w, sum(CASE WHEN p.v = 255 THEN 1 ELSE 0 END) AS f FROM ring r JOIN px p USING (map_id, y, x)
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.map_id = r.map_id AND u.lid = r.lid AND u.y = r.y AND u.x = r.x) GROUP BY 1, 2)
SELECT s.map_id, s.lid, s.n, CASE WHEN coalesce(w, 0) > coalesce(f, 0) THEN 0 ELSE 255 END AS v FROM (SELECT map_id, lid, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) <= 30) s LEFT JOIN votes USING (map_id, lid)"""
)
def unknown_noise(spark, sf_dir):
    unknown = R.unpack_labels(R.components_of(seed.rasters(spark, sf_dir), K.UNKNOWN))
    return R.unknown_noise(seed.pixels(spark, sf_dir), unknown)


@query(f"WITH {RAW}, {OFFSETS} SELECT DISTINCT a.map_id, a.y, a.x FROM px a, o8 o, px b WHERE a.v = 255 AND b.v = 127 AND b.map_id = a.map_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx")
def wall_completion(spark, sf_dir):
    return R.wall_completion(seed.pixels(spark, sf_dir))


def _close_sql(axis: str, other: str) -> str:
    line = f"OVER (PARTITION BY map_id, {other} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"WITH {RAW}, g AS (SELECT map_id, y, x, max(CASE WHEN v = 0 THEN 1 ELSE 0 END) {line} AS wall FROM px) SELECT map_id, y, x, min(wall) {line} AS wall FROM g"


@query(_close_sql("x", "y"))
def closing_h(spark, sf_dir):
    return R.closed(seed.pixels(spark, sf_dir), "x")


@query(_close_sql("y", "x"))
def closing_v(spark, sf_dir):
    return R.closed(seed.pixels(spark, sf_dir), "y")


_MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {m} THEN 2 * {m} - ({c}) ELSE {c} END"
_MIRRORED = f"b.y = {_MIRROR.format(c='a.y + o.dy', m=47)} AND b.x = {_MIRROR.format(c='a.x + o.dx', m=63)}"


@query(f"WITH {RAW}, {OFFSETS}, n AS (SELECT a.map_id, a.y, a.x, sum(CASE WHEN b.v = 0 THEN 1 ELSE 0 END) AS c FROM px a, o8 o, px b WHERE a.v = 0 AND b.map_id = a.map_id AND {_MIRRORED} GROUP BY 1, 2, 3) SELECT map_id, y, x FROM n WHERE c <= 1")
def burr_prune_1(spark, sf_dir):
    return R.burrs(seed.pixels(spark, sf_dir), seed.sizes(spark, sf_dir))


@query(
    f"""WITH {RAW}, o9 AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)), s AS (SELECT exp(-1 / (2 * 0.8 * 0.8)) AS e), k AS (SELECT e / (1 + 2 * e) AS side, 1 / (1 + 2 * e) AS mid FROM s)
SELECT a.map_id, a.y, a.x, round(sum(CASE WHEN b.v = 0 THEN (CASE WHEN o.dy = 0 THEN k.mid ELSE k.side END) * (CASE WHEN o.dx = 0 THEN k.mid ELSE k.side END) ELSE 0.0 END), 6) AS g
FROM px a, o9 o, k, px b WHERE b.map_id = a.map_id AND {_MIRRORED} GROUP BY 1, 2, 3"""
)
def gauss_wall(spark, sf_dir):
    return R.blurred(seed.pixels(spark, sf_dir), seed.sizes(spark, sf_dir)).withColumn("g", F.round("g", 6))


def _layers_sql() -> str:
    """CTEs c1, c2, c3: the layers cleaned, cleaned2 and input as pixels, step by step."""
    line = lambda a, b: f"OVER (PARTITION BY map_id, {b} ORDER BY {a} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    steps = [
        f"wl AS (SELECT map_id, y, x FROM px WHERE v = 0), {_components('w', 'wl')}",
        "near AS (SELECT DISTINCT w.map_id, w.y, w.x FROM w JOIN px f ON f.map_id = w.map_id AND f.v = 255 AND abs(f.y - w.y) <= 4 AND abs(f.x - w.x) <= 4)",
        "good AS (SELECT w.map_id, w.lid FROM w LEFT JOIN near n USING (map_id, y, x) GROUP BY 1, 2 HAVING count(*) <= 30 AND count(n.map_id) = count(*))",
        "gone AS (SELECT w.map_id, w.y, w.x FROM w JOIN good USING (map_id, lid))",
        "c1 AS MATERIALIZED (SELECT p.map_id, p.y, p.x, CASE WHEN g.y IS NOT NULL THEN 255 ELSE p.v END AS v FROM px p LEFT JOIN gone g USING (map_id, y, x))",
        f"ul AS (SELECT map_id, y, x FROM c1 WHERE v = 127), {_components('u', 'ul')}",
        "ring AS (SELECT DISTINCT u.map_id, u.lid, u.y + o.dy AS y, u.x + o.dx AS x FROM u, o8 o)",
        "votes AS (SELECT r.map_id, r.lid, sum(CASE WHEN p.v = 0 THEN 1 ELSE 0 END) AS w, sum(CASE WHEN p.v = 255 THEN 1 ELSE 0 END) AS f FROM ring r JOIN c1 p USING (map_id, y, x) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.map_id = r.map_id AND u.lid = r.lid AND u.y = r.y AND u.x = r.x) GROUP BY 1, 2)",
        "taken AS (SELECT s.map_id, s.lid, CASE WHEN coalesce(w, 0) > coalesce(f, 0) THEN 0 ELSE 255 END AS v FROM (SELECT map_id, lid FROM u GROUP BY 1, 2 HAVING count(*) <= 30) s LEFT JOIN votes USING (map_id, lid))",
        "c2 AS MATERIALIZED (SELECT p.map_id, p.y, p.x, coalesce(t.v, p.v) AS v FROM c1 p LEFT JOIN (SELECT u.map_id, u.y, u.x, taken.v FROM u JOIN taken USING (map_id, lid)) t USING (map_id, y, x))",
        "beside AS (SELECT DISTINCT a.map_id, a.y, a.x FROM c2 a, o8 o, c2 b WHERE a.v = 255 AND b.v = 127 AND b.map_id = a.map_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx)",
        "full_ AS MATERIALIZED (SELECT p.map_id, p.y, p.x, CASE WHEN b.y IS NOT NULL THEN 0 ELSE p.v END AS v FROM c2 p LEFT JOIN beside b USING (map_id, y, x))",
        "w0 AS (SELECT map_id, y, x, CASE WHEN v = 0 THEN 1 ELSE 0 END AS wall FROM full_)",
    ]
    at = "w0"
    for k in range(2):
        for a, b in (("x", "y"), ("y", "x")):
            now = f"w{k}{a}"
            steps += [f"{now}g AS (SELECT map_id, y, x, max(wall) {line(a, b)} AS wall FROM {at})", f"{now} AS (SELECT map_id, y, x, min(wall) {line(a, b)} AS wall FROM {now}g)"]
            at = now
    steps.append(f"b0 AS MATERIALIZED (SELECT map_id, y, x FROM {at} WHERE wall = 1)")
    for k in range(4):
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT a.map_id, a.y, a.x FROM b{k} a, o8 o LEFT JOIN b{k} b ON b.map_id = a.map_id AND {_MIRRORED} GROUP BY 1, 2, 3 HAVING count(b.map_id) > 1)")
    steps += [
        "o9 AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)), se AS (SELECT exp(-1 / (2 * 0.8 * 0.8)) AS e), ke AS (SELECT e / (1 + 2 * e) AS side, 1 / (1 + 2 * e) AS mid FROM se)",
        f"gs AS (SELECT a.map_id, a.y, a.x, sum((CASE WHEN o.dy = 0 THEN mid ELSE side END) * (CASE WHEN o.dx = 0 THEN mid ELSE side END)) AS g FROM px a, o9 o, ke, b4 b WHERE b.map_id = a.map_id AND {_MIRRORED} GROUP BY 1, 2, 3)",
        "nf AS (SELECT DISTINCT a.map_id, a.y, a.x FROM px a, o8 o, full_ b WHERE b.v = 255 AND b.map_id = a.map_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx)",
        """c3 AS (SELECT p.map_id, p.y, p.x, CASE WHEN coalesce(g, 0) > 0.5 AND p.v <> 0 THEN 0 WHEN coalesce(g, 0) <= 0.5 AND p.v = 0 AND nf.y IS NOT NULL THEN 255 WHEN coalesce(g, 0) <= 0.5 AND p.v = 0 THEN 127 ELSE p.v END AS v
FROM full_ p LEFT JOIN gs USING (map_id, y, x) LEFT JOIN nf USING (map_id, y, x))""",
    ]
    return ", ".join(steps)


_LAYERS = f"{RAW}, {OFFSETS}, {_layers_sql()}"


@query(f"WITH RECURSIVE {_LAYERS} SELECT map_id, layer, v, count(*) AS n, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM (SELECT 'cleaned' AS layer, * FROM c1 UNION ALL SELECT 'cleaned2', * FROM c2 UNION ALL SELECT 'input', * FROM c3) GROUP BY 1, 2, 3")
def preprocess_layers(spark, sf_dir):
    """All cleaning steps, tile by tile; counts of values and sums of their places by layer."""
    layers = R.preprocessed(seed.rasters(spark, sf_dir, raw=True), tile=32)
    keyed = layers.select(F.struct("map_id", "layer").alias("map_id"), "h", "w", "data")
    counted = R.unpack(keyed).groupBy("map_id", "v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 64 + F.col("x")).cast("long").alias("places"))
    return counted.select("map_id.map_id", "map_id.layer", "v", "n", "places")


@query(f"WITH RECURSIVE {COMP} SELECT map_id, y, x, lid FROM lab")
def component_tiles(spark, sf_dir):
    """The components of free space, labelled in tiles of 16 x 16 and joined over their borders."""
    return R.unpack_labels(R.component_labels(seed.rasters(spark, sf_dir), tile=16))


@query(
    f"""WITH {RAW}, {OFFSETS}, c AS (SELECT map_id, y, x, CASE WHEN y % 2 = 0 AND v = 0 THEN 1 WHEN v = 0 AND x % 3 > 0 THEN 1 WHEN v <> 0 AND (x + y) % 29 = 0 THEN 1 ELSE 0 END AS wall FROM px),
nf AS (SELECT DISTINCT a.map_id, a.y, a.x FROM px a, o8 o, px b WHERE b.v = 255 AND b.map_id = a.map_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx)
SELECT p.map_id, p.y, p.x, CASE WHEN c.wall = 1 AND p.v <> 0 THEN 0 WHEN c.wall = 0 AND p.v = 0 AND nf.y IS NOT NULL THEN 255 WHEN c.wall = 0 AND p.v = 0 THEN 127 ELSE p.v END AS v
FROM px p JOIN c USING (map_id, y, x) LEFT JOIN nf USING (map_id, y, x)"""
)
def recomposition(spark, sf_dir):
    """A made-up smoothed wall mask laid over the map."""
    px = seed.pixels(spark, sf_dir)
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    wall = F.when((y % 2 == 0) & (v == 0), 1).when((v == 0) & (x % 3 > 0), 1).when((v != 0) & ((x + y) % 29 == 0), 1).otherwise(0)
    return R.recomposed(px, px.select("map_id", "y", "x", wall.alias("wall")))


# --- regions -------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {COMP} SELECT map_id, y, x FROM px WHERE v >= 128 AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.map_id = px.map_id AND lab.y = px.y AND lab.x = px.x AND lab.lid % 2 = 0)")
def new_space(spark, sf_dir):
    """Old rooms are the even components; what else is free is new."""
    return RG.new_space(seed.pixels(spark, sf_dir), _regions(spark, sf_dir).where("lid % 2 = 0"))


@query(f"WITH RECURSIVE {COMP}, nsp AS (SELECT map_id, y, x FROM lab WHERE lid % 2 = 1), {_components('nl', 'nsp')} SELECT map_id, lid, count(*) AS n, min(y * 64 + x) AS first_pixel FROM nl GROUP BY 1, 2")
def new_regions(spark, sf_dir):
    px = seed.pixels(spark, sf_dir)
    fresh = RG.new_space(px, _regions(spark, sf_dir).where("lid % 2 = 0")).withColumn("v", F.lit(255))
    whole = R.met(px.select("map_id", "y", "x"), fresh, R.AT, "left").withColumn("v", F.coalesce("v", F.lit(0)))
    labels = R.unpack_labels(R.components_of(R.pack(whole), K.FREE))
    return labels.groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("y") * 64 + F.col("x")).alias("first_pixel"))


@query(f"WITH RECURSIVE {COMP}, s AS (SELECT map_id, lid, count(*) >= 179 AS normal FROM lab GROUP BY 1, 2) SELECT lab.map_id, lab.y, lab.x, lab.lid, s.normal FROM lab JOIN s USING (map_id, lid)")
def area_split(spark, sf_dir):
    return RG.by_area(_regions(spark, sf_dir), K.area_cutoff(0.45, seed.RESOLUTION)).select("map_id", "y", "x", "lid", "normal")


@query(
    f"""WITH RECURSIVE {COMP}, s AS (SELECT map_id, lid, count(*) >= 179 AS normal FROM lab GROUP BY 1, 2),
f AS (SELECT lab.* FROM lab JOIN s USING (map_id, lid) WHERE NOT normal), n AS (SELECT lab.* FROM lab JOIN s USING (map_id, lid) WHERE normal),
d AS (SELECT f.map_id, f.lid, n.lid AS target, n.y, n.x, min(greatest(abs(f.y - n.y), abs(f.x - n.x))) AS d FROM f JOIN n USING (map_id) GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT map_id, lid, min(d) AS d FROM d GROUP BY 1, 2), c AS (SELECT map_id, lid, target, count(*) AS n FROM d JOIN b USING (map_id, lid, d) GROUP BY 1, 2, 3)
SELECT map_id, lid, target FROM (SELECT *, row_number() OVER (PARTITION BY map_id, lid ORDER BY n DESC, target) AS rn FROM c) WHERE rn = 1"""
)
def fragment_nearest(spark, sf_dir):
    split = RG.by_area(_regions(spark, sf_dir), K.area_cutoff(0.45, seed.RESOLUTION))
    return RG.fragment_targets(split.where("NOT normal").drop("normal"), split.where("normal").drop("normal"))


@query(f"WITH {TILES} SELECT map_id, y, x, CAST(dense_rank() OVER (PARTITION BY map_id ORDER BY lid) AS INTEGER) AS lid FROM t WHERE lid % 3 <> 1")
def relabel(spark, sf_dir):
    return RG.relabelled(_tiles(spark, sf_dir).where("lid % 3 <> 1"))


@query(f"WITH {TILES} SELECT map_id, CASE WHEN lid IN (2, 3, 10) THEN 2 ELSE lid END AS lid, count(*) AS n FROM t GROUP BY 1, 2")
def merge_labels(spark, sf_dir):
    return RG.merged(_tiles(spark, sf_dir), [2, 3, 10]).groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {TILES}, p AS (SELECT k AS map_id, 1 + k AS x1, 2 AS y1, 20 + k AS x2, 15 AS y2 FROM m),
j AS (SELECT p.map_id, a.lid AS keep, b.lid AS gone FROM p JOIN t a ON a.map_id = p.map_id AND a.x = x1 AND a.y = y1 JOIN t b ON b.map_id = p.map_id AND b.x = x2 AND b.y = y2 WHERE a.lid <> b.lid)
SELECT t.map_id, CASE WHEN t.lid = j.gone THEN j.keep ELSE t.lid END AS lid, count(*) AS n FROM t LEFT JOIN j USING (map_id) GROUP BY 1, 2"""
)
def merge_by_point(spark, sf_dir):
    points = seed.sizes(spark, sf_dir).select("map_id", (1 + F.col("map_id")).alias("x1"), F.lit(2).alias("y1"), (20 + F.col("map_id")).alias("x2"), F.lit(15).alias("y2"))
    return RG.merged_at(_tiles(spark, sf_dir), points).groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {COMP}, t AS (SELECT map_id, y, x, CAST((y // 6) * 8 + x // 8 + 1 AS INTEGER) AS old_lid FROM px WHERE v = 255),
o AS (SELECT map_id, lid, old_lid, count(*) AS n FROM lab JOIN t USING (map_id, y, x) GROUP BY 1, 2, 3)
SELECT map_id, lid, old_lid FROM (SELECT *, row_number() OVER (PARTITION BY map_id, lid ORDER BY n DESC, old_lid) AS rn FROM o) WHERE rn = 1"""
)
def old_room_mapping(spark, sf_dir):
    return RG.old_room_mapping(_regions(spark, sf_dir), _tiles(spark, sf_dir))


@query(
    f"""WITH {TILES}, ring AS (SELECT DISTINCT a.map_id, a.lid, a.y + o.dy AS y, a.x + o.dx AS x FROM t a, o8 o WHERE a.lid % 2 = 1)
SELECT r.map_id, r.lid, b.lid AS old_lid, count(*) AS contact FROM ring r JOIN t b ON b.map_id = r.map_id AND b.y = r.y AND b.x = r.x AND b.lid % 2 = 0 GROUP BY 1, 2, 3"""
)
def region_contact(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    return RG.region_contact(tiles.where("lid % 2 = 1"), tiles.where("lid % 2 = 0"))


@query(
    f"""WITH {TILES}, nw AS (SELECT * FROM t WHERE lid % 5 = 1), ol AS (SELECT * FROM t WHERE lid % 5 <> 1),
s AS (SELECT map_id, lid, count(*) AS n FROM nw GROUP BY 1, 2),
e AS (SELECT a.map_id, a.lid, count(DISTINCT a.y * 64 + a.x) AS edge FROM nw a, o8 o WHERE NOT EXISTS (SELECT 1 FROM nw b WHERE b.map_id = a.map_id AND b.lid = a.lid AND b.y = a.y + o.dy AND b.x = a.x + o.dx) GROUP BY 1, 2),
ring AS (SELECT DISTINCT a.map_id, a.lid, a.y + o.dy AS y, a.x + o.dx AS x FROM nw a, o8 o),
c AS (SELECT r.map_id, r.lid, b.lid AS target, count(*) AS contact FROM ring r JOIN ol b ON b.map_id = r.map_id AND b.y = r.y AND b.x = r.x GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, lid ORDER BY contact DESC, target) AS rn FROM c) WHERE rn = 1)
SELECT s.map_id, s.lid, CASE WHEN b.target IS NOT NULL AND (s.n * (0.05 * 0.05) < 0.08 OR b.contact / e.edge > 0.5) THEN 'merge' ELSE 'new' END AS verdict,
CASE WHEN b.target IS NOT NULL AND (s.n * (0.05 * 0.05) < 0.08 OR b.contact / e.edge > 0.5) THEN b.target END AS target
FROM s JOIN e USING (map_id, lid) LEFT JOIN b USING (map_id, lid)"""
)
def classify_regions(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    return RG.classified(tiles.where("lid % 5 = 1"), tiles.where("lid % 5 <> 1"), seed.RESOLUTION, 0.08, 0.5)


_EDGES = """sd(dy, dx, ax, ay, ex, ey) AS (VALUES (-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0)),
ed AS (SELECT t.map_id, t.lid, t.x + ax AS x0, t.y + ay AS y0, t.x + ex AS x1, t.y + ey AS y1 FROM t, sd WHERE NOT EXISTS (SELECT 1 FROM t n WHERE n.map_id = t.map_id AND n.lid = t.lid AND n.y = t.y + sd.dy AND n.x = t.x + sd.dx))"""


@query(f"WITH {TILES}, {_EDGES} SELECT map_id, lid, x0, y0, x1, y1 FROM ed")
def boundary_edges(spark, sf_dir):
    return RG.boundary_edges(_tiles(spark, sf_dir))


@query(
    f"""WITH {TILES}, {_EDGES}, u AS (SELECT map_id, lid, CASE WHEN (x0, y0) < (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS e FROM ed),
p AS (SELECT DISTINCT a.map_id, a.lid AS i, b.lid AS j, a.e FROM u a JOIN u b ON a.map_id = b.map_id AND a.e = b.e AND a.lid < b.lid) SELECT map_id, i, j, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def shared_edges(spark, sf_dir):
    """Length of the edge that each two regions share."""
    both = RG.shared_edges(RG.boundary_edges(_tiles(spark, sf_dir))).where("size(lids) = 2")
    return both.groupBy("map_id", F.col("lids")[0].alias("i"), F.col("lids")[1].alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TILES}, {_EDGES} SELECT map_id, lid, count(*) AS perimeter FROM ed GROUP BY 1, 2")
def perimeter(spark, sf_dir):
    return RG.boundary_edges(_tiles(spark, sf_dir)).groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("perimeter"))


@query(
    f"""WITH RECURSIVE {TILES}, s AS (SELECT map_id * 100 + lid AS map_id, y, x FROM t), {_components('c', 's')},
q AS (SELECT map_id, lid, y, x, (map_id % 100 - 1) // 8 * 6 - 1 AS y0, (map_id % 100 - 1) % 8 * 8 - 1 AS x0 FROM c),
b AS MATERIALIZED (SELECT DISTINCT map_id, lid, y0, x0, y0 + i.range AS y, x0 + j.range AS x FROM q, range(8) i, range(10) j),
e AS MATERIALIZED (SELECT b.* FROM b ANTI JOIN q USING (map_id, lid, y, x)),
o AS (SELECT map_id, lid, y, x FROM e WHERE y = y0 AND x = x0 UNION SELECT e.map_id, e.lid, e.y, e.x FROM o, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dy, dx), e WHERE e.map_id = o.map_id AND e.lid = o.lid AND e.y = o.y + dy AND e.x = o.x + dx),
n AS (SELECT map_id, lid, 80 - count(*) AS area FROM o GROUP BY 1, 2)
SELECT CAST(map_id // 100 AS INTEGER) AS map_id, CAST(map_id % 100 AS INTEGER) AS lid, max(area)::DOUBLE AS area FROM n GROUP BY 1, 2"""
)
def outline_areas(spark, sf_dir):
    """What the outlines of tiles of free pixels bound: their largest piece with its holes."""
    cells = seed.pixels(spark, sf_dir).select("map_id", "y", "x", F.when(F.col("v") == 255, F.floor(F.col("y") / 6) * 8 + F.floor(F.col("x") / 8) + 1).otherwise(0).cast("int").alias("v"))
    labels = R.pack(cells).select("map_id", "h", "w", R.widened(F.col("data")).alias("labels"))
    return RG.region_polygons(labels).select("map_id", "lid", G.polygon_area(F.col("points")).alias("area"))


@query()
def region_polygons(spark, sf_dir):
    """Outlines of the rooms that the fallback partition finds, with area and length."""
    labels = RG.fallback_regions(seed.rasters(spark, sf_dir), seed.RESOLUTION, 0.1)
    return RG.region_polygons(labels).select("map_id", "lid", F.size("points").alias("n_points"), G.polygon_area(F.col("points")).alias("area"))


@query()
def final_polygons(spark, sf_dir):
    """The contours of the seed maps' rooms as documents carry them: pieces whole, fragments joined, widened to the
    walls. Tested against plain versions."""
    rasters = seed.rasters(spark, sf_dir)
    labels = RG.fallback_regions(rasters, seed.RESOLUTION, 0.1)
    return RG.final_polygons(rasters, labels).select("map_id", "lid", F.size("points").alias("n_points"), G.polygon_area(F.col("points")).alias("area"))


_SEGMENTS = "sg AS (SELECT CAST(l_orderkey // 16 AS INTEGER) AS map_id, CAST(l_suppkey * 29 % 200 AS INTEGER) AS y, CAST(l_partkey * 13 % 300 AS INTEGER) AS x, CAST(l_quantity AS INTEGER) AS n FROM lineitem)"


@query(
    f"""WITH {_SEGMENTS}, l AS (SELECT map_id, y, x, n, ((x + y) % 3) AS k FROM sg)
SELECT map_id, y, x, n, CAST(CASE WHEN k = 0 OR n = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_points FROM l"""
)
def collinear_points(spark, sf_dir):
    """Lines of three points out of line items, every third of them straight, with repeats."""
    li = seed.table(spark, sf_dir, "lineitem")
    c = {"map_id": F.floor(F.col("l_orderkey") / 16), "y": F.pmod(F.col("l_suppkey") * 29, F.lit(200)), "x": F.pmod(F.col("l_partkey") * 13, F.lit(300)), "n": F.col("l_quantity")}
    held = G.settled(li.select(*[v.cast("int").alias(k) for k, v in c.items()]))
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    bend = F.when((x + y) % 3 == 0, y).otherwise(y + 1)
    points = F.array(G.point(x, y), G.point(x, y), G.point(x + n, bend), G.point(x + 2 * n, y))
    return held.select("map_id", "y", "x", "n", F.size(G.without_collinear(points)).alias("n_points"))


@query(
    """WITH s AS (SELECT CAST(c_custkey AS INTEGER) AS k, c_custkey % 7 AS side, 3 + c_custkey % 5 AS a, 3 + c_custkey % 4 AS b FROM customer)
SELECT k AS map_id, CAST(1 + CASE WHEN (a - 1) * (b - 1) > 8 THEN 1 ELSE 0 END AS INTEGER) AS rooms, CAST(100 + 10 * side + a * b + CASE WHEN (a - 1) * (b - 1) > 8 THEN 0 ELSE 5 END AS BIGINT) AS covered FROM s"""
)
def extension_rooms(spark, sf_dir):
    """A map for every customer: a stored room of 10 x 10, new space along one side of it, which it takes, and a block
    apart, which is a room of its own where it bounds more than 8 pixels and else joins over a line of 5 pixels."""
    k = F.col("c_custkey")
    keys = seed.table(spark, sf_dir, "customer").select(k.cast("int").alias("map_id"), (k % 7).alias("side"), (3 + k % 5).alias("a"), (3 + k % 4).alias("b"))
    room = lambda y, x: y.between(10, 19) & x.between(10, F.col("side") + 19)
    block = lambda y, x: y.between(25, F.col("a") + 24) & x.between(5, F.col("b") + 4)
    data = R.drawn(36, 30, lambda y, x: F.when(room(y, x) | block(y, x), "FF").otherwise("00"))
    rasters = R.spread(keys, "map_id").select("map_id", F.lit(36).alias("h"), F.lit(30).alias("w"), data.alias("data"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    stored = F.array(F.struct(F.lit(0).alias("pos"), F.array(corner(10, 10), corner(19, 10), corner(19, 19), corner(10, 19)).alias("points")))
    held = rasters.withColumn("rooms", stored).withColumn("lines", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    grown = X.extended_maps(held, 8.0)
    return grown.groupBy("map_id").agg(F.greatest(F.max("pos") + 1, F.lit(1)).cast("int").alias("rooms"), F.max(F.when(F.col("pos") < 0, F.col("pixels"))).alias("covered"))


@query(
    f"WITH RECURSIVE {COMP}, s AS (SELECT map_id, lid, count(*) AS n FROM lab GROUP BY 1, 2) SELECT s.map_id, CAST(sum(n) AS BIGINT) AS pixels, count(*) FILTER (n >= 39) AS rooms FROM s WHERE s.map_id IN (SELECT map_id FROM s WHERE n >= 39) GROUP BY 1"
)
def fallback_partition(spark, sf_dir):
    """Every free pixel ends in a room; as many rooms as components of enough area."""
    labels = R.unpack_labels(RG.fallback_regions(seed.rasters(spark, sf_dir), seed.RESOLUTION, 0.1))
    return labels.groupBy("map_id").agg(F.count(F.lit(1)).alias("pixels"), F.countDistinct("lid").alias("rooms"))


@query(
    f"""WITH {TILES}, g0 AS (SELECT map_id, y, x, lid FROM t WHERE x % 8 = 4 AND y % 6 = 3),
g1 AS (SELECT p.map_id, p.y, p.x, coalesce(min(g.lid), NULL) AS lid FROM (SELECT map_id, y, x FROM px WHERE v = 255) p LEFT JOIN g0 s ON s.map_id = p.map_id AND s.y = p.y AND s.x = p.x JOIN g0 g ON g.map_id = p.map_id AND CASE WHEN s.lid IS NOT NULL THEN g.y = p.y AND g.x = p.x ELSE abs(g.y - p.y) <= 1 AND abs(g.x - p.x) <= 1 END GROUP BY 1, 2, 3)
SELECT map_id, lid, count(*) AS n FROM g1 GROUP BY 1, 2"""
)
def region_grow_1(spark, sf_dir):
    """One step of growth from the tiles' centres."""
    raster = R.pack(seed.pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") == 255, 255).otherwise(0)))
    tiles = _tiles(spark, sf_dir).where("x % 8 = 4 AND y % 6 = 3")

    def kernel(row):
        import numpy as np

        labels = np.zeros((row["h"], row["w"]), np.int32)
        for s in row["seeds"] or ():
            labels[s["y"], s["x"]] = s["lid"]
        yield {"h": row["h"], "w": row["w"], "labels": labels.astype("<i4").tobytes()}

    seeds = R.met(raster.drop("data"), tiles.groupBy("map_id").agg(F.collect_list(F.struct("y", "x", "lid")).alias("seeds")), "map_id", "left")
    grown = RG.grown(R.per_map(seeds, kernel, "h int, w int, labels binary"), raster, 1)
    return R.unpack_labels(grown).groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"))


# --- graph ---------------------------------------------------------------------------------------------------------

_ADJ = "adj AS (SELECT DISTINCT a.map_id, a.lid AS i, b.lid AS j FROM t a, o8 o, t b WHERE b.map_id = a.map_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND a.lid < b.lid)"


@query(f"WITH {TILES}, {_ADJ} SELECT map_id, i, j FROM adj")
def room_adjacency(spark, sf_dir):
    return RG.adjacency(_tiles(spark, sf_dir))


def _graph(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    return tiles.select("map_id", F.col("lid").alias("pos")).distinct(), RG.adjacency(tiles)


@query(f"WITH {TILES}, {_ADJ}, e AS (SELECT map_id, i FROM adj UNION ALL SELECT map_id, j FROM adj), r AS (SELECT DISTINCT map_id, lid AS pos FROM t) SELECT r.map_id, r.pos, count(e.i) AS degree FROM r LEFT JOIN e ON e.map_id = r.map_id AND e.i = r.pos GROUP BY 1, 2")
def degree(spark, sf_dir):
    return N.degrees(*_graph(spark, sf_dir))


@query(f"WITH {TILES}, {_ADJ} SELECT map_id, count(DISTINCT lid) AS rooms, CAST(0 AS BIGINT) AS out_of_range FROM t GROUP BY 1")
def color_valid(spark, sf_dir):
    """Every room has a colour of 0..4."""
    return N.coloured(*_graph(spark, sf_dir)).groupBy("map_id").agg(F.countDistinct("pos").alias("rooms"), F.sum((~F.col("color").between(0, 4)).cast("long")).alias("out_of_range"))


@query(f"WITH {TILES} SELECT map_id, count(DISTINCT lid) AS n, count(DISTINCT lid) AS ranks, CAST(0 AS INTEGER) AS first_rank, CAST(count(DISTINCT lid) - 1 AS INTEGER) AS last_rank FROM t GROUP BY 1")
def dfs_permutation(spark, sf_dir):
    """The walk visits every room once."""
    order = N.walked(*_graph(spark, sf_dir))
    return order.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


_WALK_NODES = "e AS MATERIALIZED (SELECT map_id, i, j FROM adj UNION ALL SELECT map_id, j, i FROM adj), dg AS MATERIALIZED (SELECT r.map_id, r.pos, count(e.i) AS degree FROM (SELECT DISTINCT map_id, lid AS pos FROM t) r LEFT JOIN e ON e.map_id = r.map_id AND e.i = r.pos GROUP BY 1, 2)"


@query(
    f"""WITH RECURSIVE {TILES}, {_ADJ}, {_WALK_NODES}, nbl AS (SELECT e.map_id, e.i AS pos, list(e.j ORDER BY d.degree, e.j DESC) AS near FROM e JOIN dg d ON d.map_id = e.map_id AND d.pos = e.j GROUP BY 1, 2),
k AS (SELECT map_id, list(pos ORDER BY degree, pos DESC) AS stack, CAST([] AS INTEGER[]) AS seen FROM dg GROUP BY 1
  UNION ALL SELECT k.map_id, CASE WHEN list_contains(seen, stack[len(stack)]) THEN stack[1:len(stack) - 1] ELSE list_concat(stack[1:len(stack) - 1], list_filter(coalesce(near, []), lambda v: NOT list_contains(seen, v))) END,
  CASE WHEN list_contains(seen, stack[len(stack)]) THEN seen ELSE list_append(seen, stack[len(stack)]) END FROM k LEFT JOIN nbl ON nbl.map_id = k.map_id AND nbl.pos = k.stack[len(k.stack)] WHERE len(stack) > 0)
SELECT map_id, unnest(seen) AS pos, CAST(unnest(range(len(seen))) AS INTEGER) AS rank FROM k WHERE len(stack) = 0"""
)
def walk_order(spark, sf_dir):
    return N.walked(*_graph(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {TILES}, {_ADJ}, {_WALK_NODES}, o AS MATERIALIZED (SELECT map_id, pos, row_number() OVER (PARTITION BY map_id ORDER BY degree, pos) AS rn FROM dg),
bf AS MATERIALIZED (SELECT a.map_id, a.rn, list(b.rn) AS before FROM o a JOIN e ON e.map_id = a.map_id AND e.i = a.pos JOIN o b ON b.map_id = a.map_id AND b.pos = e.j AND b.rn < a.rn GROUP BY 1, 2),
k AS (SELECT map_id, 0 AS rn, CAST([] AS INTEGER[]) AS cs FROM (SELECT DISTINCT map_id FROM o)
  UNION ALL SELECT map_id, rn, list_append(cs, CAST(CASE WHEN len(list_filter([0, 1, 2, 3, 4], lambda c: NOT list_contains(near, c))) > 0 THEN list_filter([0, 1, 2, 3, 4], lambda c: NOT list_contains(near, c))[1]
    ELSE list_filter([0, 1, 2, 3, 4], lambda c: hits[c + 1] = list_min(hits))[pos % len(list_filter([0, 1, 2, 3, 4], lambda c: hits[c + 1] = list_min(hits))) + 1] END AS INTEGER))
  FROM (SELECT *, list_transform([0, 1, 2, 3, 4], lambda c: len(list_filter(near, lambda v: v = c))) AS hits FROM (SELECT k.map_id, o.rn, o.pos, k.cs, list_transform(coalesce(bf.before, []), lambda i: k.cs[i]) AS near FROM k JOIN o ON o.map_id = k.map_id AND o.rn = k.rn + 1 LEFT JOIN bf ON bf.map_id = o.map_id AND bf.rn = o.rn)))
SELECT o.map_id, o.pos, k.cs[o.rn] AS color FROM o JOIN (SELECT map_id, cs FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY rn DESC) AS q FROM k) WHERE q = 1) k USING (map_id)"""
)
def room_colors(spark, sf_dir):
    return N.coloured(*_graph(spark, sf_dir))


@query(
    f"""WITH {TILES}, {_ADJ}, c AS (SELECT map_id, lid AS pos, CAST(lid % 3 AS INTEGER) AS color FROM (SELECT DISTINCT map_id, lid FROM t))
SELECT adj.map_id, count(*) AS edges, CAST(sum(CASE WHEN a.color = b.color THEN 1 ELSE 0 END) AS BIGINT) AS before, CAST(0 AS BIGINT) AS after FROM adj JOIN c a ON a.map_id = adj.map_id AND a.pos = adj.i JOIN c b ON b.map_id = adj.map_id AND b.pos = adj.j GROUP BY 1"""
)
def color_repair(spark, sf_dir):
    """Conflicts of neighbours before and after a colouring by threes is mended."""
    rooms, edges = _graph(spark, sf_dir)
    given = rooms.withColumn("color", (F.col("pos") % 3).cast("int"))
    mended = N.coloured(given, edges, kept=True)
    both = edges
    for name, table in (("a", given), ("b", mended)):
        for end in "ij":
            both = R.met(both, table.select("map_id", F.col("pos").alias(end), F.col("color").alias(name + end)), ["map_id", end])
    same = lambda n: F.sum((F.col(f"{n}i") == F.col(f"{n}j")).cast("long"))
    return both.groupBy("map_id").agg(F.count(F.lit(1)).alias("edges"), same("a").alias("before"), same("b").alias("after"))


ROOMS = """rm AS (SELECT CAST(s_nationkey AS INTEGER) AS map_id, CAST(s_suppkey AS INTEGER) AS pos, CAST(s_suppkey * 7 % 40 AS INTEGER) AS x0, CAST(s_suppkey * 11 % 30 AS INTEGER) AS y0,
CAST(s_suppkey * 7 % 40 + 4 + s_suppkey % 9 AS INTEGER) AS x1, CAST(s_suppkey * 11 % 30 + 4 + s_suppkey % 7 AS INTEGER) AS y1 FROM supplier)"""


def _corner_rooms(spark, sf_dir):
    points = F.array(*[G.point(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return seed.rooms(spark, sf_dir).withColumn("points", points)


@query(f"WITH {ROOMS}, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY (x1 - x0) * (y1 - y0) DESC, pos) AS rn FROM rm) SELECT map_id, pos AS start FROM r WHERE rn = 1")
def start_room_area(spark, sf_dir):
    return N.start_rooms(_corner_rooms(spark, sf_dir))


@query(
    f"""WITH {ROOMS}, g AS (SELECT *, CASE WHEN 20.5 > x0 AND 20.5 < x1 AND 15.5 > y0 AND 15.5 < y1 THEN 0.0 ELSE sqrt(power(greatest(x0 - 20.5, 0.0, 20.5 - x1), 2) + power(greatest(y0 - 15.5, 0.0, 15.5 - y1), 2)) END AS gap FROM rm),
r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY round(gap, 9), pos) AS rn FROM g) SELECT map_id, pos AS start FROM r WHERE rn = 1"""
)
def start_room_dock(spark, sf_dir):
    rooms = _corner_rooms(spark, sf_dir)
    return N.start_rooms(rooms, rooms.select("map_id").distinct().select("map_id", F.lit(20.5).alias("dx"), F.lit(15.5).alias("dy")))


# --- coordinates and polygons --------------------------------------------------------------------------------------


@query(f"WITH {ROOMS} SELECT pos, CAST(round(x0 * 0.05 + (-1.5) + 0.025, 3) AS DOUBLE) AS wx, CAST(round((48 - y0 - 1) * 0.05 + (-2.25) - 0.025, 3) AS DOUBLE) AS wy FROM rm")
def pixel_to_world(spark, sf_dir):
    p = G.pixel_to_world(F.col("x0"), F.col("y0"), F.lit(0.05), F.lit(-1.5), F.lit(-2.25), F.lit(48))
    return seed.rooms(spark, sf_dir).select("pos", p.alias("p")).select("pos", F.col("p.x").alias("wx"), F.col("p.y").alias("wy"))


_HALF = "CAST(CASE WHEN {v} >= 0 THEN floor({v} + 0.5) ELSE ceil({v} - 0.5) END AS INTEGER)"


@query(f"SELECT c_custkey, {_HALF.format(v='((c_acctbal / 100.0 - (-1.5) - 0.025) / 0.05)')} AS px, {_HALF.format(v='(48 - 1 - (c_acctbal / 300.0 - (-2.25) + 0.025) / 0.05)')} AS py FROM customer")
def world_to_pixel(spark, sf_dir):
    p = G.world_to_pixel(F.col("c_acctbal") / 100.0, F.col("c_acctbal") / 300.0, F.lit(0.05), F.lit(-1.5), F.lit(-2.25), F.lit(48))
    return seed.table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"WITH {ROOMS} SELECT pos, 4 AS n, x0, y0, x1, y1 FROM rm")
def geometry_roundtrip(spark, sf_dir):
    """Pixels to a closed world geometry and back."""
    rooms = _corner_rooms(spark, sf_dir).select("pos", G.contour_to_geometry(F.col("points"), F.lit(0.05), F.lit(-1.5), F.lit(-2.25), F.lit(48)).alias("g"))
    back = rooms.select("pos", G.geometry_to_contour(F.col("g"), F.lit(0.05), F.lit(-1.5), F.lit(-2.25), F.lit(48)).alias("p"))
    xs, ys = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    return back.select("pos", F.size("p").alias("n"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


@query(f"WITH {ROOMS} SELECT pos, pos % 2 = 1 AS clockwise FROM rm")
def clockwise(spark, sf_dir):
    """Rooms with odd keys are turned round."""
    p = F.when(F.col("pos") % 2 == 1, F.reverse("points")).otherwise(F.col("points"))
    return _corner_rooms(spark, sf_dir).select("pos", G.is_clockwise(p).alias("clockwise"))


@query(f"WITH {ROOMS} SELECT pos, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM rm")
def shoelace(spark, sf_dir):
    return _corner_rooms(spark, sf_dir).select("pos", G.polygon_area(F.col("points")).alias("area"))


@query(f"WITH {ROOMS} SELECT pos, CAST(2 AS INTEGER) AS n, round(x0 + (x1 - x0) / 3.0, 6) AS lo_x, CAST(y0 AS DOUBLE) AS lo_y, CAST(y1 AS DOUBLE) AS hi_y FROM rm")
def line_crossings(spark, sf_dir):
    x = F.col("x0") + (F.col("x1") - F.col("x0")) / 3.0
    c = G.line_crossings(x, F.col("y0") - 1.0, x, F.col("y1") + 1.0, F.col("points"))
    found = _corner_rooms(spark, sf_dir).select("pos", c.alias("c"))
    return found.select("pos", F.size("c").alias("n"), F.round(F.col("c")[0]["x"], 6).alias("lo_x"), F.round(F.col("c")[0]["y"], 6).alias("lo_y"), F.round(F.col("c")[1]["y"], 6).alias("hi_y"))


@query(f"WITH {ROOMS} SELECT pos, round((x1 - x0) * (y1 - y0) * 2 / 3.0, 6) AS larger, round((x1 - x0) * (y1 - y0) / 3.0, 6) AS smaller FROM rm")
def split_axis_line(spark, sf_dir):
    x = F.col("x0") + (F.col("x1") - F.col("x0")) / 3.0
    pair = P.chord(x, F.col("y0") - 1.0, x, F.col("y1") + 1.0, F.col("points"))
    halves = _corner_rooms(spark, sf_dir).select("pos", "points", pair.alias("pair")).select("pos", P.cut(F.col("points"), F.col("pair")).alias("h"))
    return halves.select("pos", F.round(G.polygon_area(F.col("h")[0]), 6).alias("larger"), F.round(G.polygon_area(F.col("h")[1]), 6).alias("smaller"))


@query(f"WITH {ROOMS} SELECT pos AS map_id, CAST(1 AS INTEGER) AS parts, CAST((x1 - x0) * (y1 - y0) + (x1 - x0 - 2) * 3 AS DOUBLE) AS area FROM rm")
def merge_rect_union_area(spark, sf_dir):
    """Each room with a strip of height 3 on its upper edge that begins 2 further right."""
    strip = F.array(*[G.point(F.col(x) + dx, F.col("y1") + dy) for x, dx, dy in (("x0", 2.0, 0.0), ("x1", 0.0, 0.0), ("x1", 0.0, 3.0), ("x0", 2.0, 3.0))])
    groups = _corner_rooms(spark, sf_dir).select(F.col("pos").alias("map_id"), F.array("points", strip).alias("rings"))
    return P.unions(groups).select("map_id", "parts", F.round(G.polygon_area(F.col("points")), 6).alias("area"))


@query(f"WITH {ROOMS} SELECT pos AS map_id, CAST(CASE WHEN pos % 4 = 3 THEN 2 ELSE 1 END AS INTEGER) AS parts, CAST((x1 - x0) * (y1 - y0) * CASE WHEN pos % 4 = 3 THEN 1 ELSE 2 END AS DOUBLE) AS area FROM rm")
def merge_gap_union_area(spark, sf_dir):
    """Each room with its like on the right: touching, or 5e-5 or 1e-5 apart (one room then), or too far (the larger)."""
    gap = F.element_at(F.array(F.lit(0.0), F.lit(5e-5), F.lit(1e-5), F.lit(1e-2)), (F.col("pos") % 4 + 1).cast("int"))
    beside = F.transform("points", lambda p: G.point(p["x"] + F.col("x1") - F.col("x0") + gap, p["y"]))
    groups = _corner_rooms(spark, sf_dir).select(F.col("pos").alias("map_id"), F.array("points", beside).alias("rings"))
    return P.unions(groups).select("map_id", "parts", F.round(G.polygon_area(F.col("points")), 2).alias("area"))


@query(f"WITH {ROOMS} SELECT pos AS map_id, CAST(1 AS INTEGER) AS parts, CAST((x1 - x0) * (y1 - y0) / 2.0 AS DOUBLE) AS area FROM rm")
def merge_bow_tie_area(spark, sf_dir):
    """Rooms whose ring crosses itself: both wings stay, joined where they touch."""
    bow = F.array(*[F.col("points")[k] for k in (0, 2, 1, 3)])
    groups = _corner_rooms(spark, sf_dir).select(F.col("pos").alias("map_id"), F.array(bow).alias("rings"))
    return P.unions(groups).select("map_id", "parts", F.round(G.polygon_area(F.col("points")), 2).alias("area"))


_LI = "li AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, CAST(l_partkey % 41 - 20 AS INTEGER) AS dx, CAST(l_suppkey % 23 - 11 AS INTEGER) AS dy, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"


def _line_items(spark, sf_dir):
    """Steps and numbers out of line items: k, dx, dy, q."""
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return seed.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1000 + turn).alias("k"), (F.col("l_partkey") % 41 - 20).cast("int").alias("dx"), (F.col("l_suppkey") % 23 - 11).cast("int").alias("dy"), F.col("l_quantity").cast("int").alias("q"))


_KIND = "CASE WHEN dy = 0 THEN 'H' WHEN dx = 0 THEN 'V' ELSE 'D' END"


@query(
    f"WITH {_LI}, s AS (SELECT k, dx, dy, {_KIND} AS kind, CASE WHEN q % 2 = 0 THEN 1 ELSE -1 END AS sg FROM li) SELECT k, kind, CAST(CASE WHEN kind = 'H' THEN 0 ELSE sign(dy) * sg * 2 END AS INTEGER) AS ox, CAST(CASE WHEN kind = 'V' THEN 0 ELSE -sign(dx) * sg * 2 END AS INTEGER) AS oy FROM s"
)
def segment_steps(spark, sf_dir):
    """Class of every line item's step (none lies within a degree of an axis without lying on it) and two pixels outward."""
    kind = G.segment_class(F.col("dx"), F.col("dy"))
    step = G.segment_offset(kind, F.col("dx"), F.col("dy"), F.when(F.col("q") % 2 == 0, 1).otherwise(-1), 2)
    return _line_items(spark, sf_dir).select("k", kind.alias("kind"), step.alias("s")).select("k", "kind", F.col("s.x").alias("ox"), F.col("s.y").alias("oy"))


@query(
    f"WITH {ROOMS}, c AS (SELECT *, sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS diag FROM rm) SELECT pos, CASE WHEN pos % 5 > 0 THEN round(x0 - 0.6 * greatest(4 * diag, 10.0), 6) END AS ax, CASE WHEN pos % 5 > 0 THEN round(y0 + 1 - 0.8 * greatest(4 * diag, 10.0), 6) END AS ay, CASE WHEN pos % 5 > 0 THEN round(x0 + 3 + 0.6 * greatest(4 * diag, 10.0), 6) END AS bx, CASE WHEN pos % 5 > 0 THEN round(y0 + 5 + 0.8 * greatest(4 * diag, 10.0), 6) END AS by FROM c"
)
def cut_lines(spark, sf_dir):
    """Cuts of the seed rooms along (3, 4), long enough to cross them; every fifth has no direction."""
    ax, ay = F.col("x0").cast("double"), F.col("y0") + 1.0
    far = F.when(F.col("pos") % 5 > 0, 1.0).otherwise(0.0)
    line = G.cut_line(ax, ay, ax + 3 * far, ay + 4 * far, F.col("points"))
    found = _corner_rooms(spark, sf_dir).select("pos", line.alias("l"))
    return found.select("pos", *[F.round(F.col("l")[i][c], 6).alias(n) for i, c, n in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by"))])


@query(f"WITH {ROOMS}, i AS (SELECT map_id, list(pos ORDER BY pos) AS ps FROM rm GROUP BY 1) SELECT rm.map_id, pos, CAST(coalesce(list_position(ps, pos), 0) - 1 AS INTEGER) AS own, CAST(coalesce(list_position(ps, pos + 25), 0) - 1 AS INTEGER) AS later FROM rm JOIN i USING (map_id)")
def index_by_id(spark, sf_dir):
    """Places of ids among a map's rooms, -1 for those that aren't there."""
    rooms = seed.rooms(spark, sf_dir).select("map_id", "pos")
    ids = rooms.groupBy("map_id").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    return rooms.join(ids, "map_id").select("map_id", "pos", L.index_of(F.col("ps"), F.col("pos")).alias("own"), F.coalesce(L.index_of(F.col("ps"), F.col("pos") + 25), F.lit(-1)).alias("later"))


@query(f"WITH {TILES} SELECT DISTINCT lid, CAST(lid * 97 % 200 + 56 AS INTEGER) AS r, CAST(lid * 57 % 200 + 56 AS INTEGER) AS g, CAST(lid * 23 % 200 + 56 AS INTEGER) AS b FROM t")
def label_colors(spark, sf_dir):
    return _tiles(spark, sf_dir).select("lid").distinct().select("lid", L.label_color(F.col("lid")).alias("c")).select("lid", "c.*")


@query(f"WITH {_LI}, c AS (SELECT k, abs(dx) * 6 AS r, abs(dy) * 11 AS g, q * 5 AS b FROM li) SELECT k, CAST(round_even(0.299 * r + 0.587 * g + 0.114 * b, 0) AS INTEGER) AS grey FROM c")
def luma_grey(spark, sf_dir):
    """Grey values of colours out of line items."""
    return _line_items(spark, sf_dir).select("k", R.luma(F.abs("dx") * 6, F.abs("dy") * 11, F.col("q") * 5).alias("grey"))


@query(f"WITH {RAW}, d AS (SELECT map_id, y, x, CASE WHEN map_id % 3 = 0 AND v >= 200 THEN 150 ELSE v END AS v FROM px), a AS (SELECT map_id, max(v) >= 200 AS bright FROM d GROUP BY 1) SELECT d.map_id, count(*) AS n, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM d JOIN a USING (map_id) WHERE CASE WHEN bright THEN v >= 200 ELSE v > 0 END GROUP BY 1")
def free_space(spark, sf_dir):
    """Free pixels; every third map has none that is bright enough, so all above 0 count there."""
    v = F.when((F.col("map_id") % 3 == 0) & (F.col("v") >= 200), 150).otherwise(F.col("v"))
    free = R.free_pixels(seed.pixels(spark, sf_dir).withColumn("v", v))
    return free.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 64 + F.col("x")).cast("long").alias("places"))


@query(f"WITH {RAW} SELECT DISTINCT w.map_id, w.y + dy.range - 2 AS y, w.x + dx.range - 2 AS x FROM px w, range(5) dy, range(5) dx WHERE w.v = 127")
def dilate_unknown(spark, sf_dir):
    """Places within two pixels of unknown space, beyond the map's border too."""
    grown = R.dilated(seed.pixels(spark, sf_dir).where("v = 127"), 2)
    return grown.select("map_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query(f"WITH {ROOMS} SELECT map_id, pos, CAST(10 AS INTEGER) AS closed_size, CAST(4 AS INTEGER) AS ring_size FROM rm")
def closed_geometry(spark, sf_dir):
    """Closed flat arrays hold five points whether the first was repeated or not; rings hold four, also where the last
    point misses the first by less than a millionth."""
    p = F.col("points")
    given = F.when(F.col("pos") % 2 == 0, p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    near = F.concat(p, F.array(G.point(p[0]["x"] + 5e-7, p[0]["y"] - 5e-7)))
    return _corner_rooms(spark, sf_dir).select("map_id", "pos", F.size(G.flat(G.closed(given))).alias("closed_size"), F.size(G.ring(F.when(F.col("pos") % 3 == 0, near).otherwise(given), 1e-6)).alias("ring_size"))


@query(
    f"""WITH {RAW}, dc AS (SELECT * FROM (VALUES (-2, 0), (2, 0), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (1, -2), (1, -1), (1, 0), (1, 1), (1, 2), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2)) v(dy, dx)),
gr AS (SELECT DISTINCT map_id, y + dy AS y, x + dx AS x FROM px, dc WHERE v = 0 AND y + dy BETWEEN 0 AND 47 AND x + dx BETWEEN 0 AND 63),
lost AS (SELECT DISTINCT p.map_id, p.y + dy AS y, p.x + dx AS x FROM px p LEFT JOIN gr ON gr.map_id = p.map_id AND gr.y = p.y AND gr.x = p.x, dc WHERE gr.x IS NULL)
SELECT p.map_id, p.y, p.x FROM px p WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.map_id = p.map_id AND l.y = p.y AND l.x = p.x)"""
)
def disc_closing(spark, sf_dir):
    """Walls closed by a disc of five pixels, as the pieces of a room are."""
    return R.unpack(R.disc_closed(seed.rasters(spark, sf_dir), K.WALL, 5)).where("v = 255").select("map_id", "y", "x")


# --- detections ----------------------------------------------------------------------------------------------------

DET = """li AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
dt AS MATERIALIZED (SELECT CAST(l_orderkey // 16 AS INTEGER) AS map_id, k AS det_id, CAST(l_partkey * 13 % 300 AS DOUBLE) AS cx, CAST(l_suppkey * 29 % 200 AS DOUBLE) AS cy,
10 + l_quantity AS w, 6 + l_quantity / 2 AS h, CAST((k * 7919 % 100003) AS DOUBLE) / 100003 AS conf, (k * 31 % 628) / 100.0::DOUBLE AS angle FROM li)"""


@query(f"WITH {DET} SELECT map_id, det_id, round(conf, 6) AS conf, round(w * h, 6) AS area FROM dt WHERE conf >= 0.1")
def obb_decode(spark, sf_dir):
    d = D.decoded(seed.detections(spark, sf_dir))
    return d.select("map_id", "det_id", F.round("conf", 6).alias("conf"), F.round(G.polygon_area(F.col("v")), 6).alias("area"))


@query(f"WITH {DET} SELECT det_id, round(cx - w / 2, 6) AS ax, round(cy - h / 2, 6) AS ay, round(cx + w / 2, 6) AS cx, round(cy + h / 2, 6) AS cy FROM dt WHERE conf >= 0.1")
def obb_vertices(spark, sf_dir):
    v = F.col("v")
    return D.decoded(seed.detections(spark, sf_dir)).select("det_id", *[F.round(v[i][c], 6).alias(n) for i, c, n in ((0, "x", "ax"), (0, "y", "ay"), (2, "x", "cx"), (2, "y", "cy"))])


@query(f"WITH {DET} SELECT det_id, round(cx + w / 2, 3) AS x1, round(cy, 3) AS y1, round(cx - w / 2, 3) AS x2, round(cy, 3) AS y2 FROM dt WHERE conf >= 0.1")
def obb_centerline(spark, sf_dir):
    line = G.box_centerline(F.col("v"))
    d = D.decoded(seed.detections(spark, sf_dir)).select("det_id", line.alias("l"))
    return d.select("det_id", *[F.round(F.col("l")[i][c].cast("double"), 3).alias(n) for i, c, n in ((0, "x", "x1"), (0, "y", "y1"), (1, "x", "x2"), (1, "y", "y2"))])


@query(
    f"""WITH {RAW}, ln AS (SELECT CAST(k AS INTEGER) AS map_id, 10 + k % 5 AS a, 20 + k % 5 AS b, 5 + k AS yy FROM m),
l AS (SELECT ln.map_id, k, min(CASE WHEN p.v = 255 THEN 1 ELSE 0 END) OVER (PARTITION BY ln.map_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM ln, (VALUES (1), (2), (3)) q(k) LEFT JOIN px p ON p.map_id = ln.map_id AND p.y = ln.yy AND p.x = ln.a - q.k),
r AS (SELECT ln.map_id, k, min(CASE WHEN p.v = 255 THEN 1 ELSE 0 END) OVER (PARTITION BY ln.map_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM ln, (VALUES (1), (2), (3)) q(k) LEFT JOIN px p ON p.map_id = ln.map_id AND p.y = ln.yy AND p.x = ln.b + q.k)
SELECT ln.map_id, CAST(a - (SELECT sum(s) FROM l WHERE l.map_id = ln.map_id) AS DOUBLE) AS x1, CAST(yy AS DOUBLE) AS y1, CAST(b + (SELECT sum(s) FROM r WHERE r.map_id = ln.map_id) AS DOUBLE) AS x2, CAST(yy AS DOUBLE) AS y2 FROM ln"""
)
def ray_extend(spark, sf_dir):
    k = F.col("map_id")
    lines = seed.sizes(spark, sf_dir).select("map_id", F.lit(0).alias("seg_id"), F.array(G.point((10 + k % 5).cast("float"), (5 + k).cast("float")), G.point((20 + k % 5).cast("float"), (5 + k).cast("float"))).alias("line"))
    free = seed.pixels(spark, sf_dir).where("v = 255").select("map_id", "y", "x")
    return D.ray_extended(lines, free).select("map_id", "x1", "y1", "x2", "y2")


_IOU = f"""{DET}, c AS (SELECT * FROM dt WHERE conf >= 0.1),
pr AS (SELECT p.map_id, p.det_id AS a, q.det_id AS b, p.conf AS ca, q.conf AS cb, greatest(0, least(p.cx + p.w / 2, q.cx + q.w / 2) - greatest(p.cx - p.w / 2, q.cx - q.w / 2)) * greatest(0, least(p.cy + p.h / 2, q.cy + q.h / 2) - greatest(p.cy - p.h / 2, q.cy - q.h / 2)) AS i, p.w * p.h + q.w * q.h AS s
  FROM c p JOIN c q ON p.map_id = q.map_id AND (p.conf > q.conf OR (p.conf = q.conf AND p.det_id < q.det_id)))"""


@query(f"WITH {_IOU} SELECT map_id, a, b, round(i / (s - i), 6) AS iou FROM pr WHERE i > 0")
def iou_pairs(spark, sf_dir):
    return D.iou_pairs(D.decoded(seed.detections(spark, sf_dir))).where("iou > 0").withColumn("iou", F.round("iou", 6))


@query(
    f"""WITH RECURSIVE {_IOU}, h AS MATERIALIZED (SELECT a, b FROM pr WHERE i / (s - i) >= 0.35), o AS MATERIALIZED (SELECT map_id, det_id, row_number() OVER (PARTITION BY map_id ORDER BY conf DESC, det_id) AS rn FROM c),
k AS (SELECT map_id, 0 AS rn, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT map_id FROM o)
  UNION ALL SELECT k.map_id, k.rn + 1, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.b = o.det_id AND list_contains(k.kept, h.a)) THEN k.kept ELSE list_append(k.kept, o.det_id) END FROM k JOIN o ON o.map_id = k.map_id AND o.rn = k.rn + 1),
z AS (SELECT map_id, kept FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY rn DESC) AS q FROM k) WHERE q = 1)
SELECT map_id, unnest(kept) AS det_id FROM z"""
)
def nms_keep(spark, sf_dir):
    return D.suppressed(D.decoded(seed.detections(spark, sf_dir))).select("map_id", "det_id")


@query(f"WITH {DET} SELECT det_id, round(cx - w / 2 * cos(angle) + h / 2 * sin(angle), 6) AS ax, round(cy - w / 2 * sin(angle) - h / 2 * cos(angle), 6) AS ay, round(cx + w / 2 * cos(angle) - h / 2 * sin(angle), 6) AS cx, round(cy + w / 2 * sin(angle) + h / 2 * cos(angle), 6) AS cy FROM dt WHERE conf >= 0.1")
def obb_vertices_turned(spark, sf_dir):
    v = F.col("v")
    return D.decoded(seed.detections(spark, sf_dir, turned=True)).select("det_id", *[F.round(v[i][c], 6).alias(n) for i, c, n in ((0, "x", "ax"), (0, "y", "ay"), (2, "x", "cx"), (2, "y", "cy"))])


@query(f"WITH {DET} SELECT det_id, CAST(round(cx, 6) AS DOUBLE) AS cx, CAST(round(cy, 6) AS DOUBLE) AS cy, round(conf, 6) AS conf, round(w * h, 4) AS area FROM dt WHERE conf >= 0.1")
def obb_decode_formats(spark, sf_dir):
    """The same boxes by their angle's other place, and by their corners: centre and area of both, which must agree."""
    raw = seed.detections(spark, sf_dir, turned=True)
    c = F.col("channels")
    swapped = F.array(c[0], c[1], c[2], c[3], c[5], c[4], F.lit(0.0))
    v = G.box_vertices(c[0], c[1], c[2], c[3], c[5])
    corners = G.settled(raw.select("map_id", "cell", v.alias("v"), c[4].alias("conf")))
    flat = F.array(*[F.col("v")[i][n] for i in range(4) for n in ("x", "y")], F.col("conf"), F.lit(0.0))
    one = D.decoded(raw.select("map_id", "cell", swapped.alias("channels")), "xywha").select("det_id", "conf", F.col("v").alias("a"))
    two = D.decoded(corners.select("map_id", "cell", flat.alias("channels")), "xyxyxyxy").select("det_id", F.col("v").alias("b"))
    middle = lambda p, n: F.round((F.col(p)[0][n] + F.col(p)[2][n]) / 2, 6)
    return one.join(two, "det_id").select("det_id", middle("a", "x").alias("cx"), middle("b", "y").alias("cy"), F.round("conf", 6).alias("conf"), F.round((G.polygon_area(F.col("a")) + G.polygon_area(F.col("b"))) / 2, 4).alias("area"))


@query()
def iou_pairs_turned(spark, sf_dir):
    return D.iou_pairs(D.decoded(seed.detections(spark, sf_dir, turned=True))).where("iou > 0").withColumn("iou", F.round("iou", 6))


@query()
def nms_keep_turned(spark, sf_dir):
    return D.suppressed(D.decoded(seed.detections(spark, sf_dir, turned=True))).select("map_id", "det_id")


@query(
    f"""WITH RECURSIVE {RAW}, fr AS (SELECT map_id, y, x FROM px WHERE v = 255 AND NOT (y BETWEEN 3 + map_id % 40 AND 4 + map_id % 40 AND x BETWEEN 1 AND 30 + map_id % 7) AND NOT (x BETWEEN 38 + map_id % 9 AND 39 + map_id % 9 AND y >= 2)), {_components('lab', 'fr')}
SELECT map_id, lid, count(*) AS n, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM lab GROUP BY 1, 2"""
)
def door_cuts(spark, sf_dir):
    """The pieces of free space without a level line and an upright one, each two pixels wide, the latter past the map's
    edge."""
    k = F.col("map_id")
    ends = [(F.lit(2), 4 + k % 40, 30 + k % 7, 4 + k % 40), (39 + k % 9, F.lit(60), 39 + k % 9, F.lit(3))]
    line = lambda e: F.struct(*[v.cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)])
    lines = seed.maps(spark, sf_dir).select("map_id", F.explode(F.array(*map(line, ends))).alias("l")).select("map_id", "l.*")
    pieces = R.unpack_labels(D.split_by_lines(seed.rasters(spark, sf_dir), lines))
    return pieces.groupBy("map_id", "lid").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") * 64 + F.col("x")).cast("long")).alias("places"))


_LB = "(SELECT CAST(c_custkey AS INTEGER) AS id, CAST(100 + c_custkey * 37 % 1900 AS INTEGER) AS w, CAST(100 + c_custkey * 53 % 1500 AS INTEGER) AS h FROM customer)"


@query(
    f"""WITH a AS (SELECT *, w < 416 AND h < 416 AS small FROM {_LB}), b AS (SELECT *, CASE WHEN small THEN 416 ELSE w END AS pw, CASE WHEN small THEN 416 ELSE h END AS ph FROM a),
c AS (SELECT *, least(1280.0::DOUBLE / pw, 1280.0::DOUBLE / ph) AS scale FROM b), d AS (SELECT *, CAST(round_even(pw * scale, 0) AS INTEGER) AS nw, CAST(round_even(ph * scale, 0) AS INTEGER) AS nh FROM c)
SELECT id, round(scale, 9) AS scale, nw, nh, CAST((1280 - nw) // 2 AS INTEGER) AS pad_x, CAST((1280 - nh) // 2 AS INTEGER) AS pad_y, CASE WHEN small THEN (416 - w) // 2 ELSE 0 END AS pre_x FROM d"""
)
def letterbox_params(spark, sf_dir):
    c = F.col("c_custkey")
    sized = seed.table(spark, sf_dir, "customer").select(c.cast("int").alias("id"), (100 + c * 37 % 1900).cast("int").alias("w"), (100 + c * 53 % 1500).cast("int").alias("h"))
    b = sized.select("id", G.letterbox(F.col("w"), F.col("h"), 1280, 1280).alias("b"))
    return b.select("id", F.round("b.scale", 9).alias("scale"), F.col("b.w").alias("nw"), F.col("b.h").alias("nh"), "b.pad_x", "b.pad_y", "b.pre_x")


_TENSOR = (
    "cl AS (SELECT k AS map_id, CAST(c AS INTEGER) AS channel, cy.range * 160 + cx.range AS place, CAST(floor(cy.range * 416 / 120.0) AS INTEGER) - 184 AS sy, CAST(floor((cx.range - 20) * 416 / 120.0) AS INTEGER) - 176 AS sx, cx.range BETWEEN 20 AND 139 AS inside, me, sd"
    " FROM m, range(120) cy, range(160) cx, (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) ch(c, me, sd))"
)


@query(
    f"""WITH {RAW}, {_TENSOR}, vl AS (SELECT cl.map_id, channel, place, CASE WHEN inside AND px.v IS NOT NULL THEN px.v ELSE 127 END AS v, me, sd FROM cl LEFT JOIN px ON px.map_id = cl.map_id AND px.y = cl.sy AND px.x = cl.sx)
SELECT map_id, channel, CAST(round((v / 255.0 - me) / sd, 4) AS DOUBLE) AS v, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM vl GROUP BY 1, 2, 3"""
)
def letterbox_cells(spark, sf_dir):
    """Every cell of the seed maps' normalised tensors of 160 x 120: a value's number of cells and the sum of their places."""
    c = Config(normalize=True)
    tensors = D.letterbox_tensor(seed.rasters(spark, sf_dir), (160, 120), c.min_input_size, c.mean, c.std)
    return D.tensor_cells(tensors).withColumn("v", F.round("v", 4))


# --- contours made plain -------------------------------------------------------------------------------------------


@query(
    f"""WITH {RAW}, {ROOMS}, sz AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM rm), ch AS (SELECT *, 2 * (w + h) AS n, CAST(unnest(range(2 * (w + h))) AS INTEGER) AS t FROM sz),
pt AS (SELECT map_id, pos, n, t, CASE WHEN t < w THEN x0 + t WHEN t < w + h THEN x1 WHEN t < 2 * w + h THEN x1 - (t - w - h) ELSE x0 END AS x, CASE WHEN t < w THEN y0 WHEN t < w + h THEN y0 + (t - w) WHEN t < 2 * w + h THEN y1 ELSE y1 - (t - 2 * w - h) END AS y FROM ch),
f0 AS MATERIALIZED (SELECT pt.*, CASE WHEN p.v = 255 THEN 1 ELSE 0 END AS f FROM pt LEFT JOIN px p USING (map_id, y, x)),
il AS (SELECT DISTINCT a.map_id, a.y, a.x FROM f0 a JOIN f0 b ON b.pos = a.pos AND b.t = (a.t + a.n - 1) % a.n JOIN f0 c ON c.pos = a.pos AND c.t = (a.t + 1) % a.n WHERE a.f = 0 AND b.f = 1 AND c.f = 1),
f1 AS MATERIALIZED (SELECT f0.map_id, pos, n, t, f0.x, f0.y, CASE WHEN f = 1 OR il.x IS NOT NULL THEN 1 ELSE 0 END AS f FROM f0 LEFT JOIN il ON il.map_id = f0.map_id AND il.y = f0.y AND il.x = f0.x),
bg AS (SELECT a.*, CASE WHEN a.f = 1 AND b.f = 0 THEN 1 ELSE 0 END AS b FROM f1 a JOIN f1 b ON b.pos = a.pos AND b.t = (a.t + a.n - 1) % a.n),
rn AS (SELECT *, sum(b) OVER (PARTITION BY pos ORDER BY t) AS run, sum(b) OVER (PARTITION BY pos) AS last FROM bg),
op AS (SELECT map_id, pos, CASE WHEN run = 0 THEN last ELSE run END AS run, t + CASE WHEN run = 0 AND last > 0 THEN n ELSE 0 END AS u, x, y FROM rn WHERE f = 1),
nb AS (SELECT *, lag(x) OVER q AS xa, lag(y) OVER q AS ya, lead(x) OVER q AS xb, lead(y) OVER q AS yb FROM op WINDOW q AS (PARTITION BY pos, run ORDER BY u)),
kp AS (SELECT * FROM nb WHERE xa IS NULL OR xb IS NULL OR (x - xa) * (yb - ya) <> (y - ya) * (xb - xa)),
sg AS (SELECT map_id, pos, run, u, x AS x1, y AS y1, lead(x) OVER (PARTITION BY pos, run ORDER BY u) AS x2, lead(y) OVER (PARTITION BY pos, run ORDER BY u) AS y2 FROM kp)
SELECT map_id, pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY run, u) - 1 AS INTEGER) AS seg_id, x1, y1, x2, y2 FROM sg WHERE x2 IS NOT NULL"""
)
def doorways(spark, sf_dir):
    """Where the borders of the seed rooms run over free pixels of their map."""
    return B.doorways(_pixel_rooms(spark, sf_dir), seed.pixels(spark, sf_dir).where("v = 255").select("map_id", "y", "x"))


@query()
def doorways_merged(spark, sf_dir):
    """The same with facing ends within three pixels joined. Merging goes on in order, which SQL can't say; tested by hand."""
    return B.merged_doorways(doorways(spark, sf_dir))


def _pixel_rooms(spark, sf_dir):
    whole = F.array(*[F.struct(F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return seed.rooms(spark, sf_dir).select("map_id", "pos", whole.alias("points"))


@query(
    f"""WITH {ROOMS}, sz AS (SELECT pos, x1 - x0 AS w, y1 - y0 AS h FROM rm)
SELECT pos AS map_id, CAST(k AS INTEGER) AS pos, CAST(CASE WHEN k = 0 THEN w * h ELSE w * h - (w - 2) * (h - 1) END AS DOUBLE) AS area, CAST(0 AS INTEGER) AS slanted FROM sz, (VALUES (0), (1)) v(k)"""
)
def beautified_rooms(spark, sf_dir):
    """A map for each room, with the room and its like two columns and a row further on: contours with points that aren't
    needed come out plain, and the second one loses what both share."""
    sizes = seed.rooms(spark, sf_dir).select(F.col("pos").alias("map_id"), (F.col("x1") - F.col("x0")).cast("int").alias("w"), (F.col("y1") - F.col("y0")).cast("int").alias("h"))
    cells = R.spread(sizes, "map_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20 * 24 - 1)))).withColumn("y", F.floor(F.col("i") / 24).cast("int")).withColumn("x", F.col("i") % 24)
    within = lambda dx, dy: (F.col("x") > 2 + dx) & (F.col("x") < 2 + dx + F.col("w")) & (F.col("y") > 2 + dy) & (F.col("y") < 2 + dy + F.col("h"))
    rasters = R.pack(cells.select("map_id", "y", "x", F.when(within(0, 0) | within(2, 1), 255).otherwise(127).alias("v")))

    def ring(dx, dy):
        at = lambda x, y: F.struct((x + 2 + dx).cast("int").alias("x"), (y + 2 + dy).cast("int").alias("y"))
        none, w, h = F.lit(0), F.col("w"), F.col("h")
        return F.array(at(none, none), at(F.lit(2), none), at(w, none), at(w, h), at(w - 1, h), at(none, h), at(none, h - 2))

    contours = sizes.select("map_id", F.posexplode(F.array(ring(0, 0), ring(2, 1))).alias("pos", "points"))
    done = B.beautified(rasters, contours)
    edge = F.transform("points", lambda p, i: F.when((p["x"] != F.col("points")[F.pmod(i + 1, F.size("points"))]["x"]) & (p["y"] != F.col("points")[F.pmod(i + 1, F.size("points"))]["y"]), 1).otherwise(0))
    return done.select("map_id", "pos", G.polygon_area(F.col("points")).alias("area"), F.aggregate(edge, F.lit(0), lambda a, b: a + b).alias("slanted"))


# --- landmarks -----------------------------------------------------------------------------------------------------


@query(f"WITH {ROOMS} SELECT pos, 20.5 > x0 AND 20.5 < x1 AND 15.5 > y0 AND 15.5 < y1 AS inside FROM rm")
def point_in_polygon(spark, sf_dir):
    return _corner_rooms(spark, sf_dir).select("pos", G.inside_polygon(F.lit(20.5), F.lit(15.5), F.col("points")).alias("inside"))


@query(
    f"""WITH {ROOMS} SELECT pos, round(CASE WHEN 20.5 > x0 AND 20.5 < x1 AND 15.5 > y0 AND 15.5 < y1 THEN least(20.5 - x0, x1 - 20.5, 15.5 - y0, y1 - 15.5)
ELSE sqrt(power(greatest(x0 - 20.5, 0.0, 20.5 - x1), 2) + power(greatest(y0 - 15.5, 0.0, 15.5 - y1), 2)) END, 6) AS d FROM rm"""
)
def dist_to_boundary(spark, sf_dir):
    return _corner_rooms(spark, sf_dir).select("pos", F.round(G.distance_to_polygon(F.lit(20.5), F.lit(15.5), F.col("points")), 6).alias("d"))


@query(f"WITH {ROOMS} SELECT map_id, pos, round((round(x0 * 0.05, 3) + round(x1 * 0.05, 3)) / 2, 6) AS x, round((round(y0 * 0.05, 3) + round(y1 * 0.05, 3)) / 2, 6) AS y FROM rm")
def landmark_center(spark, sf_dir):
    """Rectangles without furniture: the box centre (rooms are at least 0.2 m wide: the rest falls back to it)."""
    rooms = seed.rooms(spark, sf_dir).withColumn("markers", F.lit(None).cast("array<array<double>>"))
    return M.centers(rooms, least=0.05).select("map_id", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def landmarks_with_furniture(spark, sf_dir):
    """A table over each room's centre: the point moves away from it."""
    return M.generated(_furnished(spark, sf_dir), least=0.02).select("map_id", "id", "roomId", "name", "type", "geometry")


@query(
    f"""WITH {ROOMS}, c AS (SELECT map_id, pos, x0 * 0.05::DOUBLE AS a, y0 * 0.05::DOUBLE AS b, x1 * 0.05::DOUBLE AS c, y1 * 0.05::DOUBLE AS d FROM rm),
g AS (SELECT map_id, pos, (a + c) / 2 AS mx, (b + d) / 2 AS my, a + (c - a) * i.range / 50 AS x, b + (d - b) * j.range / 50 AS y, a, b, c, d FROM c, range(51) i, range(51) j),
e AS (SELECT map_id, pos, x, y, least(x - a, c - x, y - b, d - y) AS clear, sqrt(power(greatest(abs(x - mx) - 0.02, 0), 2) + power(greatest(abs(y - my) - 0.02, 0), 2)) AS off FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY map_id, pos ORDER BY round(clear, 9) DESC, round(x, 6), y) AS rn FROM e WHERE clear > 0.021 AND off > 0.021)
SELECT map_id, pos, round(x, 3) AS x, round(y, 3) AS y, round(clear, 5) AS clearance, true AS apart FROM o WHERE rn = 1"""
)
def landmark_clearance(spark, sf_dir):
    """Points of rooms with a table in their middle, how far they lie from the walls, the most that a grid allows, and
    whether they keep off the table."""
    rooms = _furnished(spark, sf_dir)
    at = M.centers(rooms, least=0.021).join(rooms, ["map_id", "pos"])
    clear = G.distance_to_polygon(F.col("x"), F.col("y"), G.ring(G.points_of(F.col("geometry"))))
    table = G.ring(G.points_of(F.col("markers")[0]))
    apart = ~G.inside_polygon(F.col("x"), F.col("y"), table) & (G.distance_to_polygon(F.col("x"), F.col("y"), table) > 0.021)
    return at.select("map_id", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(clear, 5).alias("clearance"), apart.alias("apart"))


def _furnished(spark, sf_dir):
    cx, cy = (F.col("x0") + F.col("x1")) * seed.RESOLUTION / 2, (F.col("y0") + F.col("y1")) * seed.RESOLUTION / 2
    table = F.array(*[v for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)) for v in (cx + sx * 0.02, cy + sy * 0.02)])
    return seed.rooms(spark, sf_dir).withColumn("markers", F.array(table))


# --- labels and requests -------------------------------------------------------------------------------------------


@query(f"WITH {ROOMS} SELECT map_id, 'ROOM_' || lpad(CAST(max(pos % 1000) + 1 AS VARCHAR), 3, '0') AS next_id FROM rm GROUP BY 1 HAVING max(pos % 1000) < 999")
def next_room_id(spark, sf_dir):
    ids = seed.rooms(spark, sf_dir).groupBy("map_id").agg(F.collect_list("id").alias("ids"))
    return ids.select("map_id", L.next_room_id(F.col("ids")).alias("next_id")).where("next_id IS NOT NULL")


_NAMES = "c AS (SELECT CAST(range AS INTEGER) AS i, chr(CAST(65 + range % 26 AS INTEGER)) || CASE WHEN range >= 26 THEN CAST(range // 26 AS VARCHAR) ELSE '' END AS name FROM range(2000))"


@query(
    f"""WITH {ROOMS}, {_NAMES}, u AS (SELECT DISTINCT r.map_id, c.name FROM rm r JOIN c ON c.i = r.pos % 40)
SELECT map_id, name AS next_name FROM (SELECT k.map_id, c.name, row_number() OVER (PARTITION BY k.map_id ORDER BY c.i) AS rn FROM (SELECT DISTINCT map_id FROM rm) k, c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.map_id = k.map_id AND u.name = c.name)) WHERE rn = 1"""
)
def next_room_name(spark, sf_dir):
    names = seed.rooms(spark, sf_dir).groupBy("map_id").agg(F.collect_set(L.room_name(F.col("pos") % 40)).alias("names"))
    return names.select("map_id", L.next_room_name(F.col("names")).alias("next_name"))


def _documents(spark, sf_dir, rooms=None):
    rooms = seed.rooms(spark, sf_dir) if rooms is None else rooms
    none = lambda kind: F.lit(None).cast(kind)
    room = F.struct("name", "id", F.lit("polygon").alias("type"), "geometry", none("int").alias("colorType"), none("array<int>").alias("graph"), none("string").alias("groundMaterial"), none("string").alias("roomId"))
    mark = F.struct("name", F.format_string("PLATFORM_LANDMARK_%03d", F.pmod("pos", F.lit(1000)).cast("int")).alias("id"), F.lit("pose").alias("type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("geometry"), none("int").alias("colorType"), none("array<int>").alias("graph"), none("string").alias("groundMaterial"), F.col("id").alias("roomId"))
    other = F.struct("name", F.lit("DOOR_1").alias("id"), F.lit("line").alias("type"), F.array(F.lit(0.0)).alias("geometry"), none("int").alias("colorType"), none("array<int>").alias("graph"), none("string").alias("groundMaterial"), none("string").alias("roomId"))
    return rooms.withColumn("item", F.explode(F.array(room, mark, other))).groupBy("map_id").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.lit("u").alias("uuid"), F.sort_array(F.collect_list("item")).alias("data"))).alias("doc"))


@query(f"WITH {ROOMS} SELECT map_id, CAST(count(*) AS INTEGER) AS rooms, CAST(count(*) AS INTEGER) AS landmarks, CAST(3 * count(*) AS INTEGER) AS items FROM rm GROUP BY 1")
def labels_split(spark, sf_dir):
    """Documents written as JSON, read with a schema, split by id; other items drop out."""
    data = F.col("j.data")
    read = _documents(spark, sf_dir).select("map_id", F.from_json("doc", L.DOCUMENT).alias("j"))
    return read.select("map_id", F.size(L.rooms_of(data)).alias("rooms"), F.size(L.landmarks_of(data)).alias("landmarks"), F.size(data).alias("items"))


@query(f"WITH {ROOMS}, i AS (SELECT map_id, pos % 1000 AS p FROM rm) SELECT map_id, '[' || string_agg('\"ROOM_' || lpad(CAST(p AS VARCHAR), 3, '0') || '\"', ',' ORDER BY p) || ']' AS ids FROM i GROUP BY 1")
def labels_json(spark, sf_dir):
    ids = seed.rooms(spark, sf_dir).groupBy("map_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select("map_id", F.to_json("ids").alias("ids"))


@query(
    """WITH k AS (SELECT p_partkey, ['float16', 'float32', 'float64', 'bool', 'uint8', 'int64', 'complex64', NULL][p_partkey % 8 + 1] AS kind FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'float16' THEN 'FP16' WHEN 'float32' THEN 'FP32' WHEN 'float64' THEN 'FP64' WHEN 'bool' THEN 'BOOL' WHEN 'uint8' THEN 'UINT8' WHEN 'int64' THEN 'INT64' ELSE 'FP32' END AS wire FROM k"""
)
def wire_names(spark, sf_dir):
    """A kind for every part, by its key; unknown ones and null too."""
    kinds = F.array(*map(F.lit, ("float16", "float32", "float64", "bool", "uint8", "int64", "complex64", None)))
    part = seed.table(spark, sf_dir, "part").select("p_partkey", kinds[(F.col("p_partkey") % 8).cast("int")].alias("kind"))
    return part.select("p_partkey", "kind", L.wire_name(F.col("kind")).alias("wire"))


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN [1.0, 2.0, 3.0] ELSE [0.0, 0.0, 0.0] END::DOUBLE[] AS pose FROM supplier"
)
def charge_pose(spark, sf_dir):
    """Every second robot has the right model, and of those every second a charger among its markers."""
    k = F.col("s_suppkey")
    marker = lambda name, g: F.struct(F.lit(name).alias("name"), F.lit("pose").alias("type"), F.array(*map(F.lit, g)).alias("geometry"))
    markers = F.when(k % 4 == 1, F.array(marker("TABLE", [9.0]), marker("MY_CHARGE_1", [1.0, 2.0, 3.0]))).otherwise(F.array(marker("TABLE", [9.0])))
    return seed.table(spark, sf_dir, "supplier").select("s_suppkey", L.charge_pose(markers, F.when(k % 2 == 1, "S-K20PRO").otherwise("s10")).alias("pose"))


def _named_rooms(spark, sf_dir):
    """The seed rooms with ids that no two share: their key's last three digits, and before them the thousands, if any."""
    thousands = F.floor(F.col("pos") / 1000)
    number = F.lpad(F.pmod("pos", F.lit(1000)).cast("string"), 3, "0")
    return seed.rooms(spark, sf_dir).withColumn("id", F.concat(F.lit("ROOM_"), F.when(thousands > 0, F.concat(thousands.cast("string"), F.lit("_"))).otherwise(""), number))


def _maps(spark, sf_dir, rooms=None):
    """Seed rasters as maps; every seventh lacks a resolution, every second has labels."""
    k = F.col("map_id")
    documents = _documents(spark, sf_dir, rooms).select("map_id", F.from_json("doc", L.DOCUMENT).alias("labels"))
    base = R.met(seed.rasters(spark, sf_dir, raw=True), documents, "map_id", "left")
    return base.select(
        "map_id", "h", "w", "data", F.when(k % 7 == 0, 0.0).otherwise(seed.RESOLUTION).alias("resolution"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.when(k % 2 == 0, "S-K20PRO").otherwise("s10").alias("robot_model"),
        F.lit("u").alias("uuid"), F.array(*[F.lit(0.0)] * 3).alias("charge_pose"), F.array().cast("array<array<double>>").alias("furniture"), F.when(k % 2 == 0, F.col("labels")).alias("labels"),
    )


@query(
    """SELECT s_suppkey AS request_id, CAST(CASE WHEN s_nationkey % 7 = 0 THEN 2 WHEN s_suppkey % 5 = 4 THEN 9 WHEN s_suppkey % 5 IN (2, 3) AND s_nationkey % 2 = 1 THEN 3
WHEN s_suppkey % 5 = 2 AND s_suppkey % 3 = 0 THEN 4 WHEN s_suppkey % 5 = 2 AND s_suppkey % 2 = 1 THEN 7 WHEN s_suppkey % 5 = 3 AND s_suppkey % 3 <> 1 THEN 4 WHEN s_suppkey % 5 = 3 THEN 7 END AS INTEGER) AS code FROM supplier"""
)
def request_status(spark, sf_dir):
    k = F.col("s_suppkey")
    own = F.format_string("ROOM_%03d", F.pmod(k, F.lit(1000)).cast("int"))
    operation = F.element_at(F.array(*map(F.lit, ("split", "repartition", "division", "merge", "dance"))), (k % 5 + 1).cast("int"))
    listed = F.when(k % 3 == 1, F.array(own, F.lit("ROOM_none"))).when(k % 3 == 2, F.array(own))
    point = F.when(k % 3 != 0, F.array(F.lit(0.0), F.lit(1.0)))
    division = F.struct(F.when(k % 2 == 0, own).otherwise("ROOM_none").alias("id"), point.alias("A"), point.alias("B"))
    requests = seed.table(spark, sf_dir, "supplier").select(k.alias("request_id"), F.col("s_nationkey").alias("map_id"), operation.alias("operation"), listed.alias("room_merge_list"), division.alias("division"))
    return plans.validated(requests, _maps(spark, sf_dir)).select("request_id", "code")


@query(
    f"""WITH {ROOMS}, g AS (SELECT map_id, count(*) AS n, max(pos % 1000) AS top, sum((x1 - x0) * (y1 - y0)) * 0.0025 AS total FROM rm GROUP BY 1)
SELECT rm.pos AS request_id, CAST(CASE WHEN top >= 999 THEN 0 WHEN pos % 5 = 0 THEN 5 END AS INTEGER) AS code, CAST(CASE WHEN top < 999 AND pos % 5 > 0 THEN n + 1 END AS INTEGER) AS rooms, CASE WHEN top < 999 AND pos % 5 > 0 THEN round(total, 6)::DOUBLE END AS total
FROM rm JOIN g USING (map_id) WHERE map_id % 2 = 0"""
)
def division_documents(spark, sf_dir):
    """Every room of the maps with labels cut in two level halves: the documents hold one room more and the same area.
    Every fifth cut misses its room (code 5)."""
    held = _named_rooms(spark, sf_dir)
    rooms = held.where("map_id % 2 = 0")
    middle = (F.col("y0") + F.col("y1")) * seed.RESOLUTION / 2 + F.when(F.col("pos") % 5 == 0, 50.0).otherwise(0.0)
    end = lambda x, by: F.array(F.col(x) * seed.RESOLUTION + by, middle)
    division = F.struct("id", end("x0", -1.0).alias("A"), end("x1", 1.0).alias("B"))
    requests = rooms.select(F.col("pos").alias("request_id"), "map_id", division.alias("division"))
    maps = _maps(spark, sf_dir, held).withColumn("resolution", F.lit(seed.RESOLUTION))
    done = plans.division(requests, maps, Config(min_part_area=0.001)).select("request_id", "code", L.rooms_of(F.from_json("body", L.DOCUMENT)["data"]).alias("rooms"))
    area = F.aggregate("rooms", F.lit(0.0), lambda a, r: a + G.polygon_area(G.ring(G.points_of(r["geometry"]))))
    return done.select("request_id", "code", F.when(F.col("rooms").isNotNull(), F.size("rooms")).alias("rooms"), F.round(area, 6).alias("total"))


@query(
    f"""WITH RECURSIVE {_LAYERS}, fl AS (SELECT map_id, y, x FROM c3 WHERE v >= 200), {_components('fc', 'fl')}, s AS (SELECT map_id, lid, count(*) AS n FROM fc GROUP BY 1, 2)
SELECT map_id, count(*) FILTER (n >= 39) AS rooms FROM s GROUP BY 1 HAVING count(*) FILTER (n >= 39) > 0"""
)
def auto_partition_rooms(spark, sf_dir):
    """How many rooms the documents of the automatic partition hold: as many as the cleaned maps have components of
    enough area."""
    bodies = auto_partition(spark, sf_dir).select("map_id", F.from_json("body", L.DOCUMENT).alias("d"))
    return bodies.select("map_id", F.size(L.rooms_of(F.col("d.data"))).cast("long").alias("rooms"))


@query()
def auto_partition(spark, sf_dir):
    """The automatic partition of every seed map as a labels document."""
    return plans.partition(_maps(spark, sf_dir), Config(min_room_area=0.1))


def _case_files(spark, sf_dir):
    """The seed maps as the files of cases, in a table: every fifth image is broken, every seventh map has no sizes,
    labels are missing or cut short."""
    k = F.col("map_id")
    images = R.per_map(seed.rasters(spark, sf_dir, raw=True), lambda row: iter([{"content": S.encode_png(R.array_of(row))}]), "content binary")
    images = images.select("map_id", F.lit(S.IMAGE).alias("name"), F.when(k % 5 == 0, F.encode(F.lit("no image"), "UTF-8")).otherwise(F.col("content")).alias("content"))
    held = R.met(seed.maps(spark, sf_dir), _documents(spark, sf_dir), "map_id", "left")
    text = lambda c: F.encode(c, "UTF-8")
    meta = F.when(k % 7 > 0, text(F.to_json(F.struct(F.lit(seed.RESOLUTION).alias("resolution"), F.array(k * 0.5, F.lit(-1.0), F.lit(0.0)).alias("origin")))))
    info = F.when(k % 2 == 0, text(F.to_json(F.struct(F.lit("S-K20PRO").alias("robot_model"), F.concat(F.lit("u"), k.cast("string")).alias("uuid")))))
    marker = lambda name, kind, *g: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.array(*[F.lit(v).cast("double") if not hasattr(v, "cast") else v.cast("double") for v in g]).alias("geometry"))
    marks = F.when(k % 3 == 0, text(F.to_json(F.struct(F.array(marker(L.FURNITURE, "polygon", 0, 0, 1, 0, 1, 1), marker("MY_CHARGE_1", "pose", k, 2, 3), marker(L.FURNITURE, "pose", 1, 1)).alias("data")))))
    labels = F.when(k % 4 == 1, text(F.lit("{"))).when(k % 4 == 3, F.unhex(F.lit("7BFF"))).when(k % 4 == 0, text(F.col("doc")))
    sides = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in ((S.META, meta), (S.INFO, info), (S.MARKS, marks), (S.LABELS, labels))])
    return images.unionByName(held.select("map_id", F.explode(sides).alias("f")).select("map_id", "f.*").where("content IS NOT NULL"))


@query(
    f"""WITH {RAW}, {ROOMS}, f AS (SELECT map_id, count(*) FILTER (v = 254) AS free, CAST(sum(v * (y * 64 + x)) AS BIGINT) AS places FROM raw GROUP BY 1), n AS (SELECT map_id, count(*) AS rooms FROM rm GROUP BY 1)
SELECT f.map_id, CASE WHEN f.map_id % 5 > 0 THEN 48 END AS h, CASE WHEN f.map_id % 5 > 0 THEN 64 END AS w, CASE WHEN f.map_id % 5 > 0 THEN free END AS free, CASE WHEN f.map_id % 5 > 0 THEN places END AS places,
CASE WHEN f.map_id % 7 > 0 THEN 0.05::DOUBLE END AS resolution, CASE WHEN f.map_id % 7 > 0 THEN f.map_id * 0.5::DOUBLE END AS ox, CASE WHEN f.map_id % 2 = 0 THEN 'S-K20PRO' ELSE 's10' END AS robot_model, CASE WHEN f.map_id % 2 = 0 THEN 'u' || f.map_id END AS uuid,
CASE WHEN f.map_id % 6 = 0 THEN f.map_id ELSE 0 END::DOUBLE AS charge, CAST(CASE WHEN f.map_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS furniture, CAST(CASE WHEN f.map_id % 4 = 0 THEN n.rooms END AS INTEGER) AS rooms FROM f LEFT JOIN n USING (map_id)"""
)
def case_maps(spark, sf_dir):
    """Cases read from their files: images, sizes, models, markers and labels, with defaults where a file is missing,
    broken or cut short."""
    read = S.maps_of(_case_files(spark, sf_dir))
    seen = R.unpack(read.where("data IS NOT NULL").select("map_id", "h", "w", "data"))
    sums = seen.groupBy("map_id").agg(F.count(F.when(F.col("v") == 254, 1)).alias("free"), F.sum(F.col("v").cast("long") * (F.col("y") * 64 + F.col("x"))).alias("places"))
    rooms = F.when(F.col("labels").isNotNull(), F.size(L.rooms_of(F.col("labels.data"))))
    return R.met(read, sums, "map_id", "left").select("map_id", "h", "w", "free", "places", "resolution", "ox", "robot_model", "uuid", F.col("charge_pose")[0].alias("charge"), F.size("furniture").alias("furniture"), rooms.alias("rooms"))


_REFUSED = """SELECT 'r' || s_suppkey AS request_id, CAST(CASE WHEN s_suppkey % 4 < 3 THEN 171 ELSE 190 END AS INTEGER) AS "statusCode",
CASE s_suppkey % 4 WHEN 0 THEN 'no such operation' WHEN 1 THEN 'need room merge list' WHEN 2 THEN 'need division croods list' ELSE CASE WHEN s_suppkey % 8 = 3 THEN '11' WHEN s_nationkey % 5 = 0 THEN '1' WHEN s_nationkey % 7 = 0 THEN '2' WHEN s_nationkey % 4 > 0 THEN '3' ELSE '7' END END AS body FROM supplier"""


def _bad_requests(spark, sf_dir):
    """A request for every supplier, each with something wrong: an argument missing, no such map, an image that can't be
    read, no sizes, no labels, no such room; and the maps."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    operation = F.element_at(F.array(*map(F.lit, ("dance", "merge", "division", "merge"))), (k % 4 + 1).cast("int"))
    asked = seed.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("request_id"), F.when(k % 8 == 3, F.lit("nowhere")).otherwise(n.cast("string")).alias("map_id"), operation.alias("operation"),
        F.when(k % 4 == 3, F.array(F.lit("ROOM_x"), F.lit("ROOM_y"))).alias("room_merge_list"),
    )
    return asked, S.maps_of(_case_files(spark, sf_dir)).withColumn("map_id", F.col("map_id").cast("string"))


@query(_REFUSED)
def refused_requests(spark, sf_dir):
    """Bad requests as JSON lines, every one twice. All are answered once, with what is wrong."""
    asked, maps = _bad_requests(spark, sf_dir)
    key = F.concat(F.lit("sites/a/"), "map_id", F.when(F.hash("request_id") % 3 == 0, "/").otherwise(""))
    lines = asked.select(F.to_json(F.struct("request_id", "operation", F.lit("b").alias("bucket"), key.alias("key"), F.col("room_merge_list").alias("roomMergeList"))).alias("value"))
    return plans.run(S.requests_of(lines.union(lines)), maps)


@query(_REFUSED)
def streamed_requests(spark, sf_dir):
    """The same as files that a stream finds in its inbox."""
    asked, maps = _bad_requests(spark, sf_dir)
    place = fresh_path(spark, "stream")
    asked.write.json(f"{place}/inbox")
    stream.serve(spark, f"{place}/inbox", maps, f"{place}/outbox", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/outbox").select("request_id", "statusCode", "body")


@query(
    f"""WITH {ROOMS}, q AS (SELECT *, lead(pos) OVER w AS pb, lead(x0) OVER w AS a0, lead(x1) OVER w AS a1, lead(y0) OVER w AS b0, lead(y1) OVER w AS b1 FROM rm WHERE map_id % 2 = 0 WINDOW w AS (PARTITION BY map_id ORDER BY pos)),
g AS (SELECT map_id, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS total FROM rm GROUP BY 1),
d AS (SELECT *, (x1 - x0) * (y1 - y0) AS s, (a1 - a0) * (b1 - b0) AS t, least(x1, a1) - greatest(x0, a0) AS ix, least(y1, b1) - greatest(y0, b0) AS iy FROM q WHERE pb IS NOT NULL)
SELECT pos AS request_id, CAST(CASE WHEN ix < -1 OR iy < -1 THEN 8 END AS INTEGER) AS code, CAST(CASE WHEN ix >= -1 AND iy >= -1 THEN n - 1 END AS INTEGER) AS rooms, CAST(CASE WHEN ix >= -1 AND iy >= -1 THEN n - 1 END AS INTEGER) AS landmarks,
CASE WHEN ix >= -1 AND iy >= -1 THEN round((total - s - t + CASE WHEN ix < 0 OR iy < 0 THEN greatest(s, t) ELSE s + t - ix * iy END) * 0.0025, 4)::DOUBLE END AS total FROM d JOIN g USING (map_id)"""
)
def merge_documents(spark, sf_dir):
    """Every room of the maps with labels merged with the next one: the documents hold one room less, a landmark for each,
    and the area of both together. Rooms that are apart aren't merged (code 8); of two that only their walls' pixels join the larger stays."""
    held = _named_rooms(spark, sf_dir)
    rooms = held.where("map_id % 2 = 0")
    after = F.lead("id").over(Window.partitionBy("map_id").orderBy("pos"))
    requests = rooms.select(F.col("pos").alias("request_id"), "map_id", F.array("id", after).alias("room_merge_list")).where("room_merge_list[1] IS NOT NULL")
    maps = _maps(spark, sf_dir, held).withColumn("resolution", F.lit(seed.RESOLUTION))
    data = F.from_json("body", L.DOCUMENT)["data"]
    done = plans.merge(requests, maps, Config()).select("request_id", "code", L.rooms_of(data).alias("rooms"), L.landmarks_of(data).alias("marks"))
    area = F.aggregate("rooms", F.lit(0.0), lambda a, r: a + G.polygon_area(G.ring(G.points_of(r["geometry"]))))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return done.select("request_id", "code", size("rooms").alias("rooms"), size("marks").alias("landmarks"), F.round(area, 4).alias("total"))


@query(
    """SELECT s_suppkey AS request_id, CAST(CASE WHEN s_suppkey % 3 > 0 THEN 2 ELSE 1 END AS INTEGER) AS rooms, CASE WHEN s_suppkey % 3 > 0 THEN 'ROOM_007 C,ROOM_008 A' ELSE 'ROOM_007 C' END AS named,
CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS landmarks, CAST(CASE WHEN s_suppkey % 3 > 0 THEN (31 + s_suppkey % 5) - 20 + 2 ELSE 0 END AS INTEGER) AS wide FROM supplier"""
)
def extension_documents(spark, sf_dir):
    """A map for every supplier with one stored room, and new space apart from it in two of three: it becomes a room with
    the next id and the first name that is free. Landmarks are placed anew there, if the robot wants any; a map without
    new space keeps its own. wide: from the new contour's first column to its last; it lies a pixel outside the free ones (columns 20
    to 31 and more) on either side."""
    k = F.col("k")
    keys = seed.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    room = lambda y, x: y.between(10, 24) & x.between(10, 24)
    block = lambda y, x: (k % 3 > 0) & y.between(35, 49) & x.between(20, 31 + k % 5)
    data = R.drawn(60, 50, lambda y, x: F.when(room(y, x) | block(y, x), "FE").otherwise("00"))
    rasters = R.spread(keys, "k").select(k.alias("map_id"), F.lit(60).alias("h"), F.lit(50).alias("w"), data.alias("data"))
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 10), (24, 10), (24, 24), (10, 24))])
    shape = G.contour_to_geometry(corners, F.lit(seed.RESOLUTION), F.lit(0.0), F.lit(0.0), F.lit(60))
    item = lambda name, id_, kind, g: F.struct(F.lit(name).alias("name"), F.lit(id_).alias("id"), F.lit(kind).alias("type"), g.alias("geometry"), F.lit(2).alias("colorType"))
    data = F.array(item("C", "ROOM_007", "polygon", shape), item("C", "PLATFORM_LANDMARK_001", "pose", F.array(*[F.lit(0.0)] * 3)))
    labels = F.from_json(F.to_json(F.struct(F.lit("v1").alias("version"), F.lit("u").alias("uuid"), data.alias("data"))), L.DOCUMENT)
    maps = rasters.select(
        "map_id", "h", "w", "data", F.lit(seed.RESOLUTION).alias("resolution"), F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.when(F.col("map_id") % 2 == 0, "S-K20PRO").otherwise("s10").alias("robot_model"),
        F.lit("u").alias("uuid"), F.array(*[F.lit(0.0)] * 3).alias("charge_pose"), F.array().cast("array<array<double>>").alias("furniture"), labels.alias("labels"),
    )
    requests = keys.select(k.alias("request_id"), k.alias("map_id"), F.lit("split").alias("operation"), F.lit(None).cast("array<string>").alias("room_merge_list"), F.lit(None).cast("struct<id:string,A:array<double>,B:array<double>>").alias("division"))
    done = plans.run(requests, maps, Config(min_room_area=0.1)).select("request_id", F.from_json("body", L.DOCUMENT)["data"].alias("d"))
    held = done.select("request_id", L.rooms_of(F.col("d")).alias("rooms"), L.landmarks_of(F.col("d")).alias("marks"))
    new = F.get(F.filter("rooms", lambda r: r["id"] == "ROOM_008"), F.lit(0))
    held = G.settled(held.withColumn("new", new["geometry"]))
    xs = F.transform(G.points_of(F.col("new")), lambda p: p["x"])
    wide = F.coalesce(F.round((F.array_max(xs) - F.array_min(xs)) / seed.RESOLUTION).cast("int"), F.lit(0))
    named = F.array_join(F.array_sort(F.transform("rooms", lambda r: F.concat_ws(" ", r["id"], r["name"]))), ",")
    return held.select("request_id", F.size("rooms").alias("rooms"), named.alias("named"), F.size("marks").alias("landmarks"), wide.alias("wide"))
