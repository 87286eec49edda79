"""Helpers shared by the corpus operators: table access, scratch space, Arrow text buffers, salting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType, _parse_datatype_string

#: The white space of every contract here: [\x20\x09-\x0D].
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step holds at a time, unless a single text is longer.
SLICE_BYTES = 1 << 18

_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a temporary one serves a single JVM;
    on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def kept_as(table: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a stored table that can be released in its stead."""
    view.stored_at = table.stored_at
    return view


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_at)


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A schema with further columns."""
    return StructType([*schema.fields, *(StructField(k, _parse_datatype_string(t)) for k, t in kinds.items())])


def located(df: DataFrame) -> DataFrame:
    """The rows with file and row of their content; rows that come from no file are written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return df.select(*df.columns, *place)
    except AnalysisException:
        return stored(df, "content").select(*df.columns, *place)


#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")), F.lit(0)) + 16 * F.greatest(F.size(column), F.lit(1))
        return 16 + 8 * F.greatest(F.size(column), F.lit(0))
    if isinstance(kind, StructType):
        return sum((_width(column.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes all rows take."""
    width = sum((_width(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def join_checked(big: DataFrame, small: DataFrame, on, how: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a stored side: broadcast it only if its measured bytes stay under max_bytes, else leave the choice to
    the planner (sort-merge, which AQE splits where a key is hot)."""
    return big.join(F.broadcast(small) if measured_bytes(small) <= max_bytes else small, on, how)


#: Bytes of rows that go to a Python worker, or come back, at a time.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def _size_of(spark: SparkSession, text: str) -> int:
    """Bytes of a size as Spark's settings write it: 4194304, 4194304b, 4m, 4MB."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text.strip())


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in small batches: by the number of rows alone, long texts would make batches of any size. The setting
    holds for the session from here on, for the batches are cut when the result is computed."""
    conf = df.sparkSession.conf
    if _size_of(df.sparkSession, conf.get(_ARROW)) > ARROW_BYTES:
        conf.set(_ARROW, ARROW_BYTES)
    return df.mapInArrow(function, schema)


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, null as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_pow: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        step = np.full(size, base, _U)
        step[0] = 1
        have = np.cumprod(step, dtype=_U)
        if size <= 4 * SLICE_BYTES:  # what one very long text needed isn't kept
            _pow[base] = have
    return have[:n]


#: An odd 64-bit base and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (value + 1) * BASE**i modulo 2**64, with a leading 0."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data), BASE), dtype=_U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal contents wherever they lie."""
    inverse = powers(len(prefix), INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U) * _U(_MULT))


_is_ws = np.zeros(256, bool)
_is_ws[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+; no word crosses a text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_is_ws[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end = end & np.concatenate([~inside[1:] | edge[1:-1], [True]])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
