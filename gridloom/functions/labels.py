"""Column functions on label documents: kinds of items, ids, names, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<name:string,id:string,type:string,geometry:array<double>,colorType:int,graph:array<int>,groundMaterial:string,roomId:string>"
DOCUMENT = f"struct<version:string,uuid:string,data:array<{ITEM}>>"
MARKERS = "struct<data:array<struct<name:string,type:string,geometry:array<double>>>>"
MAP_META = "struct<resolution:double,origin:array<double>>"
MAP_INFO = "struct<robot_model:string,uuid:string>"
REQUEST = "struct<request_id:string,operation:string,bucket:string,key:string,roomMergeList:array<string>,divisionCroodsDict:struct<id:string,A:array<double>,B:array<double>>>"
#: The marker name of furniture (fixed value).
FURNITURE = "家具"


def rooms_of(data: Column) -> Column:
    return F.filter(data, lambda i: i["id"].contains("ROOM"))


def landmarks_of(data: Column) -> Column:
    return F.filter(data, lambda i: i["id"].contains("PLATFORM_LANDMARK"))


def index_of(ids: Column, wanted: Column) -> Column:
    """0-based place of the first match, -1 if there is none."""
    return (F.array_position(ids, wanted) - 1).cast("int")


def next_room_id(ids: Column) -> Column:
    """One more than the largest number at an id's end, three digits at least; null beyond 999."""
    numbers = F.transform(ids, lambda i: F.expr("int(0)") + F.coalesce(F.regexp_extract(i, r"(\d+)$", 1).try_cast("int"), F.lit(0)))
    n = F.coalesce(F.array_max(numbers), F.lit(0)) + 1
    return F.when(n <= 999, F.concat(F.lit("ROOM_"), F.lpad(n.cast("string"), 3, "0")))


def room_name(i: Column) -> Column:
    """A..Z, then A1..Z1, A2.., for 0, 1, 2, ..."""
    turn = F.floor(i / 26).cast("int")
    return F.concat(F.chr((F.lit(65) + i % 26).cast("long")), F.when(turn > 0, turn.cast("string")).otherwise(""))


def next_room_name(names: Column) -> Column:
    """The first name not yet used."""
    candidates = F.transform(F.sequence(F.lit(0), F.size(names)), room_name)
    return F.get(F.filter(candidates, lambda c: ~F.array_contains(F.coalesce(names, F.array().cast("array<string>")), c)), F.lit(0))


def landmark_id(i: Column) -> Column:
    return F.format_string("PLATFORM_LANDMARK_%03d", i)


def charge_pose(markers: Column, model: Column) -> Column:
    """Geometry of the first marker named CHARGE, for one model; [0, 0, 0] without."""
    found = F.get(F.filter(markers, lambda m: m["name"].contains("CHARGE")), F.lit(0))["geometry"]
    return F.when(model == "S-K20PRO", F.coalesce(found, F.array(*[F.lit(0.0)] * 3))).otherwise(F.array(*[F.lit(0.0)] * 3))


def furniture(markers: Column) -> Column:
    return F.transform(F.filter(markers, lambda m: (m["name"] == FURNITURE) & (m["type"] == "polygon")), lambda m: m["geometry"])


def label_color(lid: Column) -> Column:
    """A colour for a label, spread by a multiplicative hash."""
    return F.struct(*[F.when(lid == 0, 0).otherwise(F.pmod(lid * k, F.lit(200)) + 56).cast("int").alias(n) for n, k in (("r", 97), ("g", 57), ("b", 23))])


#: Array types and their wire names (fixed values).
WIRE_NAMES = {"float16": "FP16", "float32": "FP32", "float64": "FP64", "int8": "INT8", "int16": "INT16", "int32": "INT32", "int64": "INT64", "uint8": "UINT8", "uint16": "UINT16", "uint32": "UINT32", "uint64": "UINT64", "bool": "BOOL"}


def wire_name(kind: Column) -> Column:
    """Wire name of an array type; unknown ones are FP32."""
    table = F.create_map(*[F.lit(x) for pair in WIRE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("FP32"))
