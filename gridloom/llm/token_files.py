"""Token ids as flat binary files: unsigned integers end to end, 64-bit document offsets beside them.

Documents are dealt by ranges of their ids and sorted, so each task holds consecutive documents and writes one part:

    NAME.ids   the ids, little endian, of `width` bytes each (2 where the vocabulary allows it, else 4)
    NAME.off   documents + 1 offsets into NAME.ids, unsigned 64-bit little endian, counted in ids
    NAME.doc   the documents' ids, signed 64-bit little endian (of the first `nulls` documents they are null)

The table `parts` of the folder lists part, name, docs, ids, nulls, width and base, the number of ids in all parts
before it: prefix sums over one row a part. Only parts of finished tasks are listed, so a lost executor leaves at most
a file that nobody reads. Reading maps the files into memory and cuts parts into runs of documents for the tasks.

The library encodes each different unit of text once in a while and a task remembers its ids. Units are a white space
with the run of other characters behind it, or a run of white space less what belongs to the next unit; no pre-token of
a byte-level vocabulary reaches over their ends. Strings of special tokens are cut out first, as the library does.

Edge cases: a null or empty text is the end id alone; null ids come first; rows that share an id stand in the order of
their texts' hashes, whatever files they come from; repeated rows are written each for itself; an empty table gives a
folder without parts; other columns are left out, whatever their names. Texts are written whole; long ones are encoded
in steps that end between units.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import in_arrow, scratch_path, stored
from .token_counts import tokenizer_path

DEFAULT_FILE = "byte_bpe_50k.json"
END_ID = 2
#: Characters that a task remembers ids for, and characters of one step through a long text.
MEMO_CHARS, STEP_CHARS = 16 << 20, 1 << 18
#: Documents of a run that one reading step takes, and ids it holds at a time (or one document's).
RUN_DOCS, READ_IDS = 1 << 12, 1 << 20

#: The Unicode property White_Space (fixed value).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")
#: Where a long text may be cut: before a single white space between others.
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}](?=[^{_SPACE}])")

_PARTS = "part long, name string, docs long, ids long, nulls long, width int"


class Encoder:
    """Ids of texts by the tokenizers library, as bytes of `width` each; built once in each Python worker."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.kind = np.dtype(f"<u{width}")
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _units(self, units: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, units))
        except KeyError:
            new = [u for u in set(units) if u not in memo]
            self.held += sum(map(len, new))
            if self.held > MEMO_CHARS:
                memo.clear()
                new = list(set(units))
                self.held = sum(map(len, new))
            for u, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
                memo[u] = np.array(e.ids, self.kind).tobytes()
        return b"".join(map(memo.__getitem__, units))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, in steps."""
        for piece in self.special.split(text) if self.special else (text,):
            at = 0
            while at < len(piece):
                cut = _CUT.search(piece, at + STEP_CHARS) if len(piece) - at > STEP_CHARS else None
                end = cut.start() if cut else len(piece)
                yield self._units(_UNIT.findall(piece, at, end) if at or cut else _UNIT.findall(piece))
                at = end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def _ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text, dealt by ranges and sorted; the row's number parts what shares id and text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("id"), F.col("h"), F.col("n")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")


def write_tokens(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID, width: int | None = None) -> str:
    """Write the ids of all texts in ascending order of the documents' ids; returns the folder (by default a new one
    in the shared folder, deleted when the session ends). end_id follows each document; None leaves it out."""
    spark = df.sparkSession
    folder = folder.rstrip("/") if folder else scratch_path(spark, "tokens")
    path = path or tokenizer_path(DEFAULT_FILE)
    if width is None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id or 0])
        width = 2 if most < 1 << 16 else 4
    end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():08d}-{uuid.uuid4().hex[:12]}"
        docs = ids = nulls = 0
        opened = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if opened is None:
                files.create_dir(root, recursive=True)
                encode = encoder(path, width).encode
                opened = [files.open_output_stream(f"{root}/{name}.{k}") for k in ("ids", "off", "doc")]
                opened[1].write(np.zeros(1, "<u8").tobytes())
            ends = []
            for text in batch.column(1):
                for step in encode(text.as_py() or ""):
                    ids += len(step) // width
                    opened[0].write(step)
                opened[0].write(end)
                ids += len(end) // width
                ends.append(ids)
            opened[1].write(np.array(ends, "<u8").tobytes())
            opened[2].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
            docs += batch.num_rows
            nulls += batch.column(0).null_count
        if opened is not None:
            for f in opened:
                f.close()
            row = (task.partitionId(), name, docs, ids, nulls, width)
            yield pa.RecordBatch.from_arrays([pa.array([v]) if isinstance(v, str) else pa.array([v], pa.int32() if k == 5 else pa.int64()) for k, v in enumerate(row)], names=["part", "name", "docs", "ids", "nulls", "width"])

    parts = stored(_ordered(df, id_col, text_col).transform(in_arrow, run, _PARTS), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/parts")
    return folder


def _mapped(files: pafs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(path)


def _values(file: pa.NativeFile, kind: str, lo: int, hi: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(file.read_at((hi - lo) * size, lo * size), kind)


def read_tokens(spark: SparkSession, folder: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, as asked for, ids (array<long>) or ids_crc32 (of
    the ids as unsigned 32-bit integers, little endian)."""
    folder = folder.rstrip("/")
    extra = {"ids": "array<long>", "ids_crc32": "long"}
    parts = spark.read.parquet(f"{folder}/parts")
    runs = parts.where("docs > 0").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("docs") - 1, F.lit(RUN_DOCS))))
    runs = runs.withColumn("hi", F.least(F.col("lo") + RUN_DOCS, "docs")).select("part", "name", "nulls", "width", "base", "lo", "hi")
    runs = runs.repartition("part", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids, off, doc = (_mapped(files, f"{root}/{r['name']}.{k}") for k in ("ids", "off", "doc"))
                with ids, off, doc:
                    at = _values(off, "<u8", r["lo"], r["hi"] + 1).astype(np.int64)
                    names = _values(doc, "<i8", r["lo"], r["hi"])
                    absent = np.arange(r["lo"], r["hi"]) < r["nulls"]
                    lo = 0
                    while lo < len(names):
                        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + READ_IDS, side="right")) - 1)
                        hi = min(hi, len(names))
                        found = _values(ids, f"<u{r['width']}", int(at[lo]), int(at[hi]))
                        cuts = at[lo : hi + 1] - at[lo]
                        cols = [pa.array(names[lo:hi], pa.int64(), mask=absent[lo:hi]), pa.array(at[lo:hi] + r["base"], pa.int64()), pa.array(np.diff(cuts), pa.int64())]
                        for k in outputs:
                            if k == "ids":
                                cols.append(pa.LargeListArray.from_arrays(cuts, found.astype(np.int64)).cast(pa.list_(pa.int64())))
                            else:
                                wide = found.astype("<u4")
                                cols.append(pa.array([zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64()))
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", *outputs])
                        lo = hi

    return runs.transform(in_arrow, run, ", ".join(["doc_id long, start long, n_tokens long", *(f"{k} {extra[k]}" for k in outputs)]))
