"""Map cases: a folder a map with saved_map.png, saved_map.json and, optionally, labels.json, mapinfo.json and
markers.json. Any file system that Spark reads serves; folders are found by their images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions import labels as L
from ..operators.kernels import gray
from ..operators.raster import met

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


#: First column and row, and steps, of the seven passes of an interlaced image (fixed values).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Scan lines (a filter number, then bytes) as bytes; step: bytes of a whole pixel. Where a byte needs its left
    neighbour's value, all bytes of one anti-diagonal are found at once."""
    rule, data = lines[:, 0], lines[:, 1:]
    h, size = data.shape
    if not size or not (rule > 2).any():
        out = np.zeros((h, size), np.uint8)
        above = np.zeros(size, np.uint8)
        for y in range(h):
            if rule[y] == 1:
                out[y] = np.cumsum(data[y].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            else:
                out[y] = data[y] + above if rule[y] == 2 else data[y]
            above = out[y]
        return out
    w = size // step
    tilted = np.zeros((h + w + 1, h + 1, step), np.uint8)  # place (x + y + 2, y + 1)
    for y in range(h):
        tilted[y + 2 : y + 2 + w, y + 1] = data[y].reshape(w, step)
    kind = rule.astype(np.int16)[:, None]
    for d in range(h + w - 1):
        lo, hi = max(0, d - w + 1), min(h, d + 1)
        left, up, corner = (v.astype(np.int16) for v in (tilted[d + 1, lo + 1 : hi + 1], tilted[d + 1, lo:hi], tilted[d, lo:hi]))
        if d < h:  # the row that begins here
            left[-1] = corner[-1] = 0
        k = kind[lo:hi]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        near = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.where(k == 4, near, np.where(k == 3, (left + up) // 2, np.where(k == 2, up, np.where(k == 1, left, 0))))
        tilted[d + 2, lo + 1 : hi + 1] += guess.astype(np.uint8)
    return np.stack([tilted[y + 2 : y + 2 + w, y + 1].reshape(-1) for y in range(h)])


def _samples(raw: np.ndarray, w: int, h: int, depth: int, n: int) -> tuple[np.ndarray, int]:
    """(h, w, n) samples of one pass (of 16 bits the upper byte), and how many bytes it took."""
    size = (w * n * depth + 7) // 8
    used = h * (size + 1)
    rows = _unfiltered(raw[:used].reshape(h, size + 1), max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
    return rows[:, : w * n].reshape(h, w, n), used


def decode_png(raw: bytes) -> np.ndarray:
    """PNG of any depth, colour type and interlacing -> (h, w) grey values; colours by luma weights, alpha is left out."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            break
    n = _CHANNELS[color]
    stream = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    img = np.zeros((h, w, n), np.uint8)
    for x, y, dx, dy in _PASSES if interlace else ((0, 0, 1, 1),):
        part = img[y::dy, x::dx]
        if part.shape[0] and part.shape[1]:
            part[...], used = _samples(stream, part.shape[1], part.shape[0], depth, n)
            stream = stream[used:]
    if color == 3:
        img = palette[img[..., 0]]
    elif depth < 8:
        img = img * np.uint8(255 // ((1 << depth) - 1))
    if img.shape[-1] < 3:
        return img[..., 0].copy()
    return gray(img[..., 2::-1])


def encode_png(img: np.ndarray) -> bytes:
    """(h, w) or (h, w, 3) bytes as PNG."""
    h, w = img.shape[:2]
    color = 0 if img.ndim == 2 else 2
    rows = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in img)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


#: The files of a case.
IMAGE, META, INFO, MARKS, LABELS = NAMES = ("saved_map.png", "saved_map.json", "mapinfo.json", "markers.json", "labels.json")


def case_files(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """map_id (folder name), name, content of the files of all cases under a folder."""
    glob = "{" + ",".join(names) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)$", i)
    return found.select(part(1).alias("map_id"), part(2).alias("name"), "content")


def images_of(files: DataFrame) -> DataFrame:
    """files(map_id, name, content) -> map_id, h, w, data of the images; null but for the id where one can't be read."""
    schema = StructType([StructField("map_id", files.schema["map_id"].dataType), *(StructField(n, t) for n, t in (("h", IntegerType()), ("w", IntegerType()), ("data", BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    img = decode_png(batch.column(1)[i].as_py())
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, UnboundLocalError):
                    img = None
                row = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                if img is not None:
                    row = [pa.array([img.shape[0]], pa.int32()), pa.array([img.shape[1]], pa.int32()), pa.array([img.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *row], names=["map_id", "h", "w", "data"])

    return files.where(F.col("name") == IMAGE).select("map_id", "content").mapInArrow(run, schema)


def maps_of(files: DataFrame, default_model: str = "s10") -> DataFrame:
    """files(map_id, name, content), from folders or any table -> one row a case: raster, resolution, origin,
    robot_model, uuid, charge_pose, furniture, labels (null if missing or unreadable). A case is what has an image; all
    its JSON files meet in one grouping."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    held = files.where(F.col("name").isin(*NAMES) & (F.col("name") != IMAGE)).groupBy("map_id").agg(*[F.max(F.when(F.col("name") == n, text)).alias(c) for n, c in ((META, "meta"), (INFO, "info"), (MARKS, "marks"), (LABELS, "doc"))])
    read = lambda c, schema: F.from_json(c, schema, {"mode": "PERMISSIVE"}).alias(c)
    held = held.select("map_id", read("meta", L.MAP_META), read("info", L.MAP_INFO), read("marks", L.MARKERS), read("doc", L.DOCUMENT))
    out = met(images_of(files), held, "map_id", "left").withColumn("markers", F.col("marks.data"))
    model = F.coalesce("info.robot_model", F.lit(default_model))
    empty = F.array().cast("array<array<double>>")
    return out.select(
        "map_id", "h", "w", "data", "meta.resolution", F.col("meta.origin")[0].alias("ox"), F.col("meta.origin")[1].alias("oy"), model.alias("robot_model"), "info.uuid",
        L.charge_pose(F.coalesce("markers", F.array().cast("array<struct<name:string,type:string,geometry:array<double>>>")), model).alias("charge_pose"),
        F.coalesce(L.furniture(F.col("markers")), empty).alias("furniture"), F.when(F.col("doc.data").isNotNull(), F.col("doc")).alias("labels"),
    )


def read_rasters(spark: SparkSession, root: str) -> DataFrame:
    """The images of all cases under a folder, see `images_of`."""
    return images_of(case_files(spark, root, (IMAGE,)))


def read_maps(spark: SparkSession, root: str, default_model: str = "s10") -> DataFrame:
    """All cases under a folder, see `maps_of`."""
    return maps_of(case_files(spark, root), default_model)


def write_labels(results: DataFrame, path: str) -> None:
    """results(map_id, body) as one JSON line a map, in folders by map."""
    results.select("map_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("map_id").text(path)


def requests_of(lines: DataFrame) -> DataFrame:
    """JSON lines (value) of requests (operation, bucket, key, roomMergeList, divisionCroodsDict and, optionally,
    request_id) as `plans.requests.run` takes them. map_id is the key's last part; a request without an id gets its line's
    digest, and equal ones are one request."""
    read = lines.where(F.trim("value") != "").select("value", F.from_json("value", L.REQUEST).alias("r"))
    return read.select(
        F.coalesce("r.request_id", F.sha2("value", 256)).alias("request_id"), F.regexp_extract("r.key", r"([^/]+)/?$", 1).alias("map_id"), "r.operation",
        F.col("r.roomMergeList").alias("room_merge_list"), F.col("r.divisionCroodsDict").alias("division"),
    ).dropDuplicates(["request_id"])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from text files, see `requests_of`."""
    return requests_of(spark.read.text(path))
