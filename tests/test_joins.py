"""Tables that come out of an explode look small to Spark; none of them may be broadcast, whole through the driver."""

import pytest

from gridloom.plans import catalogue as C

PIXELS = [
    "room_adjacency", "degree", "color_valid", "color_repair", "dfs_permutation", "room_colors", "walk_order", "components", "component_sizes", "component_tiles", "area_split", "boundary_edges", "classify_regions",
    "closing_h", "closing_v", "burr_prune_1", "dilate_unknown", "disc_closing", "case_maps", "new_space", "relabel", "merge_by_point", "old_room_mapping", "region_contact", "interior_noise", "unknown_noise", "gauss_wall",
]


@pytest.mark.parametrize("name", PIXELS)
def test_pixels_are_not_broadcast(spark, sf_dir, name):
    plan = C.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_small_files_of_much_work_are_dealt_over_tasks(spark, sf_dir):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert C.merge_gap_union_area(spark, sf_dir).rdd.getNumPartitions() == tasks


def test_repeated_keys_give_rooms_ids_of_their_own(spark, sf_dir, tmp_path):
    """Edits name rooms by id; keys that differ by thousands shared one."""
    from pyspark.sql import functions as F

    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    supplier.union(supplier.withColumn("s_suppkey", F.col("s_suppkey") + 1000)).write.parquet(f"{tmp_path}/supplier.parquet")
    rooms = C._named_rooms(spark, str(tmp_path))
    assert rooms.select("map_id", "id").distinct().count() == rooms.count()
