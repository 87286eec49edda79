"""PNG of every kind, tensors for a model, raw candidates through the requests."""

import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Config
from gridloom.operators import detections as D
from gridloom.operators import kernels as K
from gridloom.plans import requests as plans
from gridloom.sources import maps as source

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
KINDS = [(c, d) for c, depths in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))) for d in depths]


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows, step, rules):
    """Scan lines with the given filters, byte by byte."""
    out, above = b"", [0] * len(rows[0]) if rows else []
    for rule, row in zip(rules, rows):
        line = bytearray([rule])
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[rule]) & 255)
        out += bytes(line)
        above = row
    return out


def png(samples, color, depth, interlace=False, palette=None, rng=None):
    """samples: (h, w, channels) whole numbers."""
    h, w, n = samples.shape
    body = b""
    for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlace else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        rows = []
        for line in part.reshape(part.shape[0], -1).tolist():
            bits = "".join(format(v, f"0{depth}b") for v in line)
            bits += "0" * (-len(bits) % 8)
            rows.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
        body += filtered(rows, max(1, n * depth // 8), rng.integers(0, 5, len(rows)).tolist())
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlace)))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def expected(samples, color, depth, palette):
    if color == 3:
        return K.gray(palette[samples[..., 0]].astype(np.uint8)[..., ::-1])
    eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    eight = eight.astype(np.uint8)
    return eight[..., 0] if eight.shape[-1] < 3 else K.gray(eight[..., 2::-1])


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("color, depth", KINDS)
def test_png_of_every_kind(color, depth, interlace):
    rng = np.random.default_rng(color * 100 + depth)
    for h, w in ((1, 1), (5, 3), (13, 17), (8, 9), (2, 40)):
        palette = rng.integers(0, 256, (1 << depth, 3)) if color == 3 else None
        samples = rng.integers(0, 1 << depth, (h, w, CHANNELS[color]))
        raw = png(samples, color, depth, interlace, palette, rng)
        assert np.array_equal(source.decode_png(raw), expected(samples, color, depth, palette))


def test_png_as_spark_reads_it(spark, tmp_path):
    """The image source's own decoder, for the kinds that it gives as bytes."""
    rng = np.random.default_rng(9)
    want = {}
    for color, depth, interlace in ((0, 8, False), (0, 8, True), (2, 8, False), (2, 8, True), (6, 8, False)):
        samples = rng.integers(0, 256, (11, 14, CHANNELS[color]))
        name = f"{color}-{depth}-{interlace}.png"
        (tmp_path / name).write_bytes(png(samples, color, depth, interlace, None, rng))
        want[name] = source.decode_png((tmp_path / name).read_bytes())
    rows = spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect()
    assert len(rows) == len(want)
    for r in rows:
        img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        got = img[..., 0] if r.nChannels == 1 else K.gray(img[..., :3])
        assert np.array_equal(got, want[r.origin.rsplit("/", 1)[1]])


def test_large_png_in_time():
    """4000 x 4000 pixels, every line by the filter that needs three neighbours."""
    rng = np.random.default_rng(3)
    n = 4000
    body = np.concatenate([np.full((n, 1), 4, np.uint8), rng.integers(0, 3, (n, n)).astype(np.uint8)], axis=1)
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + chunk(b"IEND", b"")
    began = time.process_time()
    assert source.decode_png(raw).shape == (n, n) and time.process_time() - began < 5


@pytest.mark.parametrize("shape, least", [((30, 50), 40), ((90, 33), 40), ((20, 20), 416), ((300, 500), 416)])
@pytest.mark.parametrize("normal", [False, True])
def test_letterbox_tensor(spark, shape, least, normal):
    rng = np.random.default_rng(1)
    img = rng.choice([0, 127, 255], shape).astype(np.uint8)
    c = Config()
    row = D.letterbox_tensor(spark.createDataFrame([(1, *shape, img.tobytes())], "map_id int, h int, w int, data binary"), (128, 96), least, *((c.mean, c.std) if normal else ())).first()
    got = np.frombuffer(row.tensor, "<f4").reshape(row["shape"])
    wide = img
    if shape[0] < least and shape[1] < least:
        wide = np.full((least, least), 127, np.uint8)
        y, x = (least - shape[0]) // 2, (least - shape[1]) // 2
        wide[y : y + shape[0], x : x + shape[1]] = img
        assert (row.pre_y, row.pre_x) == (y, x)
    h, w = wide.shape
    scale = min(128 / w, 96 / h)
    nh, nw = round(h * scale), round(w * scale)
    assert row["shape"] == [1, 3, 96, 128] and row.scale == scale
    want = np.full((96, 128), 127.0)
    for i in range(nh):
        for j in range(nw):
            want[(96 - nh) // 2 + i, (128 - nw) // 2 + j] = wide[min(int(i * h / nh), h - 1), min(int(j * w / nw), w - 1)]
    for k in range(3):
        plain = want / 255
        assert np.allclose(got[0, k], (plain - c.mean[k]) / c.std[k] if normal else plain, atol=1e-5)


def test_raw_candidates_by_config(spark):
    """Format, least confidence and overlap come from the configuration."""
    rows = [(1, 0, [10.0, 10.0, 8.0, 4.0, 0.9, 0.0]), (1, 1, [10.5, 10.0, 8.0, 4.0, 0.8, 0.0]), (1, 2, [40.0, 10.0, 8.0, 4.0, 0.3, 0.0])]
    raw = spark.createDataFrame(rows, "map_id int, cell long, channels array<double>")
    kept = lambda c: sorted(r.det_id for r in plans.doors_of(raw, c).collect())
    assert kept(Config()) == [0, 2]
    assert kept(Config(conf_threshold=0.5)) == [0]
    assert kept(Config(nms_threshold=0.95)) == [0, 1, 2]
    turned = raw.select("map_id", "cell", F.array(*[F.col("channels")[i] for i in (0, 1, 2, 3, 5, 4)], F.lit(0.0)).alias("channels"))
    boxes = {r.det_id: r.conf for r in plans.doors_of(turned, Config(output_format="xywha")).collect()}
    assert sorted(boxes) == [0, 2] and boxes[0] == 0.9
    with pytest.raises(ValueError):
        plans.run(raw, raw, Config(), raw, raw)
