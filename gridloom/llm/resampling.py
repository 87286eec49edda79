"""Importance resampling towards a target distribution of hashed word n-grams.

A byte automaton over Arrow's UTF-8 buffer finds the words: a table classifies and lower-cases bytes, differences of the
classes are the words' starts and ends, a break of its own parts the texts. The words then stand one space apart in a
stream, and table-driven CRCs advance a byte at a time from all starts at once: where a state meets a space it is a
feature of one, two or three words. A task adds its features up by bucket, so a count of the whole corpus is at most
BUCKETS rows a task, and what reaches the driver BUCKETS rows for each side.

The draw is Gumbel top-k: weight plus a seeded noise, the highest of the documents with enough words. All documents are
sorted once by ranges of their place; prefix sums over one row a range make the ranks.

Edge cases: a null or empty text has no words, no features, weight 0 and no rank; ties fall to smaller ids, null ids
stand last (their noise is that of an empty id); repeated rows are documents of their own; an empty corpus gives an
empty result and an empty target makes every gain negative or 0; other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, in_arrow, join_checked, stored, text_slices

#: Buckets, words of the longest feature, least words of a drawn document, percent drawn, seed of the noise.
BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: At so few open starts what is left of them goes through the library's CRC.
FEW = 8

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_in_word = np.zeros(256, bool)
_in_word[0x30:0x3A] = _in_word[0x41:0x5B] = _in_word[0x61:0x7B] = _in_word[0x80:] = True


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte, by its reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_crc = _crc_table()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end."""
    inside = _in_word[data]
    before = np.concatenate([[False], inside[:-1]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    return start, end


def features(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: words of each text; the text and the CRC of every feature, in no order."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(texts, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    start, end = words_of(data, offsets)
    n, size = len(start), end - start
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(text, minlength=texts)
    if not n:
        return count, np.zeros(0, np.int64), np.zeros(0, np.uint32)
    stream = np.full(int(size.sum()) + n, 0x20, np.uint8)
    word = np.repeat(np.arange(n), size)
    stream[np.arange(len(word)) + word] = _lower[data[_in_word[data]]]
    first = np.cumsum(size + 1) - size - 1
    stop = first + size  # the space behind each word
    last = np.minimum(np.arange(n) + order - 1, np.cumsum(count)[text] - 1)
    steps = stop[last] - first + 1
    turn = np.argsort(-steps, kind="stable")
    at, left = first[turn], steps[turn]
    open_ = np.searchsorted(-left, -np.arange(1, int(left[0]) + 2), side="right")  # starts with more than t bytes to go
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    owner, crcs = [], []
    for t in range(int(left[0])):
        m = int(open_[t])
        if m <= FEW and left[0] - t > 4 * FEW:
            for j in range(m):
                i, value, here = int(turn[j]), int(state[j]) ^ 0xFFFFFFFF, int(at[j]) + t
                for k in range(i, int(last[i]) + 1):
                    if stop[k] >= here:
                        value = zlib.crc32(stream[here : stop[k]], value)
                        here = int(stop[k])
                        owner.append([i])
                        crcs.append([value])
            break
        byte = stream[at[:m] + t]
        met = np.flatnonzero(byte == 0x20)
        if len(met):
            owner.append(turn[met])
            crcs.append(state[met] ^ np.uint32(0xFFFFFFFF))
        now = state[:m]
        state[:m] = _crc[(now ^ byte) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    return count, text[np.concatenate(owner)], np.concatenate(crcs).astype(np.uint32)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                total += np.bincount(features(data, offsets, order)[2] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = df.select(F.col(text_col).alias("text")).transform(in_arrow, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets`
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of how much likelier the target is, rounded down."""
    n = len(raw)
    return np.floor(1000 * np.log((target + 1.0) * (raw.sum() + float(n)) / ((raw + 1.0) * (target.sum() + float(n))))).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                words, text, crc = features(data, offsets, order)
                size = np.bincount(text, minlength=hi - lo)
                weight = np.rint(np.bincount(text, gain[crc % np.uint32(len(gain))], minlength=hi - lo))  # whole numbers, exact
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in (words, size, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(in_arrow, run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel number, rounded down, from the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place 1, 2, 3 ... in the order: sorted by ranges and written, then prefix sums of the ranges'
    rows (Spark numbers a partition's rows from its number times 2**33)."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = join_checked(rows, stored(base, "bases"), "_part", "left")
    return rows.withColumn(name, F.col("_base") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_base")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (null where it isn't drawn)."""
    gain = gains(bucket_counts(df, text_col, buckets, order), bucket_counts(target, target_col, buckets, order))
    rows = stored(weights(df, gain, id_col, text_col, order), "weights")
    rows = rows.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")).withColumn("_fit", F.col("n_words") >= least_words)
    drawn = rows.where("_fit").count() * percent // 100
    placed = with_places(rows, [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id")], "_place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_fit") & (F.col("_place") <= drawn), F.col("_place")).alias("rank"))
