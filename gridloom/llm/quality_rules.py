"""Repetition-coverage quality rules: rolling hashes of several n-gram lengths, in numpy, per text.

Every text is hashed once (prefix sums of a polynomial modulo 2**64); words, lines and word n-grams get their
64-bit hashes from differences of those sums. A n-gram's later occurrences cover characters; the share of a text's
word characters that they cover, and that of duplicated lines, decide the verdict.

Edge cases: a null or empty text, or one of white space, has no words, zero counts, base_failed true and kept false.
Repeated rows are judged each for itself; no row is dropped; any other column, whatever its name, is kept as it is
(a column that bears the result's own name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import BASE, in_arrow, mix, per_text, prefix_hash, span_hash, text_slices, with_fields, word_spans

_U = np.uint64

#: Word n-gram length: highest share of word characters that later occurrences may cover (Rae et al. 2021, table A1).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of word characters inside lines that repeat an earlier one.
LINE_CHAR_LIMIT = 0.20
MIN_WORDS = 50
#: Highest share of symbols among the word characters (one for twenty).
SYMBOL_LIMIT = 0.05

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, max_ngram_excess double, reason string"

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the keys that occur twice or more, and of those that occur earlier."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        later[order[1:][same]] = True
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
    return again, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Flags of the items in the n-item windows that start at starts."""
    edge = np.zeros(size + n + 1, np.int32)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:size]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of a slice of texts (bytes and offsets)."""
    n = len(offsets) - 1
    sums = prefix_hash(data)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    start, end = word_spans(data, offsets)
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    salt = mix(np.arange(1, n + 1, dtype=_U))
    chars = points[end] - points[start]
    words = span_hash(sums, start, end)
    out = {"n_words": np.diff(bounds), "word_chars": per_text(chars, bounds), "n_symbols": per_text(_symbol[data], offsets)}

    # lines: a text's pieces between \n
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_doc + 1])
    closing = (line_end > line_start) & (data[line_end - 1] == 10)
    line_end = line_end - closing
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = last > first
    line_start, line_end, line_doc, first, last = (x[full] for x in (line_start, line_end, line_doc, first, last))
    _, later = _repeats(mix(span_hash(sums, line_start, line_end) ^ salt[line_doc]))
    line_bounds = np.searchsorted(line_doc, np.arange(n + 1))
    out["n_dup_lines"] = per_text(later, line_bounds)
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    out["dup_line_chars"] = per_text(np.where(later, total[last] - total[first], 0), line_bounds)

    # word n-grams of each length within one text
    excess = np.zeros(n)
    hashes, reach = words.copy(), 1
    allowed = np.maximum(out["word_chars"], 1)
    for size in sorted({3, *NGRAM_LIMITS}):
        while reach < size:  # extended by one word at a time
            hashes = hashes[:-1] * _U(BASE) + words[reach:] if len(hashes) else hashes
            reach += 1
        inside = doc[: len(hashes)] == doc[reach - 1 : reach - 1 + len(hashes)]
        at = np.flatnonzero(inside)
        again, later = _repeats(mix(hashes[at] ^ salt[doc[at]]))
        if size == 3:
            out["n_repeat_words"] = per_text(_covered(at[again], 3, len(words)), bounds)
        if size in NGRAM_LIMITS:
            share = per_text(np.where(_covered(at[later], size, len(words)), chars, 0), bounds) / allowed
            excess = np.maximum(excess, share / NGRAM_LIMITS[size])
    out["max_ngram_excess"] = excess
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    reasons = [
        ("base", out["base_failed"]),
        ("ngrams", excess > 1),
        ("line_chars", out["dup_line_chars"] > LINE_CHAR_LIMIT * allowed),
        ("symbols", out["n_symbols"] > SYMBOL_LIMIT * allowed),
    ]
    out["reason"] = np.select([x for _, x in reasons], [k for k, _ in reasons], default="")
    out["kept"] = out["reason"] == ""
    return out


def drop_rejected(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows that the rules keep, all columns as they are; what goes never leaves the worker."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(measure(data, offsets)["kept"]))

    return df.transform(in_arrow, run, df.schema)


def quality_rules(df: DataFrame, text_col: str = "text", result: str = "quality_rules") -> DataFrame:
    """The input with a struct column `result`: counts, base_failed, kept, and the first rule that failed as reason."""
    df = df.drop(result)
    fields = [x.split(" ") for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                got = measure(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(got[k]).cast(kinds[t]) for k, t in fields], names=[k for k, _ in fields])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, result])

    inner = ",".join(f"{k}:{'bigint' if t == 'long' else t}" for k, t in fields)
    return df.transform(in_arrow, run, with_fields(df.schema, **{result: f"struct<{inner}>"}))
