"""Removal of byte strings that start more than once anywhere in a corpus, by suffix arrays over shards.

A window is LENGTH bytes of one document. Its owner is the gram of GRAM bytes inside it with the smallest hash, so equal
windows have equal owners, wherever they stand. One pass lists each document's runs of at most CUT windows whose
owners' hash is one; a window can only repeat if its owner's hash occurs in a second run or at a second place of its
run. For those runs, the bytes of all their windows (a context) are cut out and dealt to shards by owner. Contexts
overlap by a window at most, so those of a periodic text are about as long as the text:

* equal contexts are collapsed first (pre-aggregated); one that occurs twice repeats as a whole;
* owners with several different contexts, or with one that holds them twice, go to suffix arrays: contexts are concatenated, suffixes sorted to
  their context's end by Larsson-Sadakane refinement (only unsorted groups are refined, the sorted depth doubles), and Kasai's common
  prefixes, in lockstep over all contexts, tell which windows agree with a neighbour in LENGTH bytes;
* an owner with more than HOT different contexts is split over several shards; each writes its sorted window keys by
  range, and for each range every shard's keys are found in the others' by binary search.

Windows become spans of bytes; spans that overlap or touch are removed as one.

Edge cases: null and empty texts have 0 bytes and the digest of nothing; texts under LENGTH bytes lose nothing; texts
may be of any length (long ones are read in overlapping pieces); repeated rows are documents of their own, so both lose
what they share; matches never cross documents; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, join_checked, located, prefix_hash, release, span_hash, stored, text_slices

_U = np.uint64

LENGTH = 400
GRAM = 64
#: Different contexts of one owner that one shard takes; more are split.
HOT = 256
#: Bytes of contexts in one suffix array, and the windows of a run at most.
SHARD_BYTES = 1 << 20
CUT = 2048
#: Runs of a text that are cut out at a time.
CHUNK = 1024
#: Bits of a suffix's number where rank, next rank and number share one sort key.
_BITS = 21
#: A text's windows are listed so many at a time.
PIECE = 1 << 22
_PLACE = _U((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from running minima of blocks to both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, _U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, cut: int = CUT) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner's hash: text, first and last window start within it, the hash, and whether the
    owner stands at several places of the run."""
    found = []
    pieces = [(0, len(data), offsets)]
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        pieces = [(a, min(len(data), a + PIECE + length - 1), None) for a in range(0, len(data) - length + 1, PIECE)]
    for at, stop, bounds in pieces:
        part = data[at:stop]
        bounds = np.array([0, stop - at]) if bounds is None else bounds
        if len(part) < length:
            continue
        starts = np.arange(len(part) - gram + 1)
        hashes = span_hash(prefix_hash(part), starts, starts + gram)
        least = sliding_min((hashes & ~_PLACE) | (_PLACE - starts.astype(_U)), length - gram + 1)
        edge = np.zeros(len(part) + 1, np.int32)
        fits = np.flatnonzero(np.diff(bounds) >= length)
        np.add.at(edge, bounds[fits], 1)
        np.add.at(edge, bounds[fits + 1] - length + 1, -1)
        window = np.flatnonzero(np.cumsum(edge)[: len(least)])
        if not len(window):
            continue
        owner = (_PLACE - (least[window] & _PLACE)).astype(np.int64)
        fresh = np.ones(len(window), bool)
        key = hashes[owner]
        fresh[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(fresh)
        fresh |= (np.arange(len(window)) - first[np.cumsum(fresh) - 1]) % cut == 0
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(window)) - 1
        text = np.searchsorted(bounds, window[first], side="right") - 1
        found.append((text, window[first] - bounds[text] + at, window[last] - bounds[text] + at, key[first].view(np.int64), owner[first] != owner[last]))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` symbols at least (1..256, 0 as separator), and their ranks.

    What follows a separator is not compared: suffixes equal up to it share a rank and stand in order of index, so the
    order holds when both are cut by a symbol, as Kasai's pass requires."""
    n = len(symbols)
    ends = np.append(np.flatnonzero(symbols == 0), n)
    left = (np.repeat(ends, np.diff(ends, prepend=-1))[:n] - np.arange(n)).astype(np.int32)
    first = 4  # symbols of the first key
    padded = np.concatenate([symbols, np.zeros(first, symbols.dtype)])
    key = np.zeros(n, _U)
    for k in range(first):
        key <<= _U(9)
        key |= padded[k : k + n].astype(_U)
    near = np.flatnonzero(left < first)
    key[near] &= ~((_U(1) << (9 * (first - left[near])).astype(_U)) - _U(1))
    small = n < 1 << _BITS  # a key and the suffix's number share one word, which sorts much faster than an order does
    low = _U((1 << _BITS) - 1)
    if small:
        key = np.sort((key << _U(_BITS)) | np.arange(n, dtype=_U))
        order = (key & low).astype(np.int64)
        key >>= _U(_BITS)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key, padded
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.flatnonzero(fresh)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    sorted_to = first
    # places in the order whose group has several suffixes
    size = np.diff(np.append(heads, n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    open_ = open_[left[order[open_]] >= sorted_to]
    while sorted_to < depth and len(open_):
        suffix = order[open_]
        group, then = rank[suffix], rank[np.minimum(suffix + sorted_to, n)]
        if small:
            word = np.sort((group.astype(_U) << _U(2 * _BITS)) | ((then + 1).astype(_U) << _U(_BITS)) | suffix.astype(_U))
            suffix = (word & low).astype(np.int64)
            word >>= _U(_BITS)
            group = (word >> _U(_BITS)).astype(np.int64)
        else:
            by = np.lexsort((then, group))
            suffix, group, word = suffix[by], group[by], then[by]
        order[open_] = suffix
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(open_)))
        rank[suffix] = np.repeat(open_[heads], size)
        open_ = open_[np.repeat(size > 1, size)]
        sorted_to *= 2
        open_ = open_[left[order[open_]] >= sorted_to]
    return order, rank[:n]


def windows_and_ranks(contexts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context: which of its windows another window here equals, and which are first of their kind."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.zeros(int((sizes + 1).sum()), np.int16)
    raw = np.frombuffer(b"\0".join(contexts), np.uint8)
    symbols[: len(raw)] = raw.astype(np.int16) + 1
    symbols[begin + sizes] = 0
    # to the end of the longest context: an order cut before it would not bear out 'previous common prefix - 1'
    order = suffix_order(symbols, int(sizes.max()) + 1)[0]
    n = len(symbols)
    left = (np.repeat(begin + sizes, sizes + 1) - np.arange(n)).astype(np.int32)  # bytes up to the context's end
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    repeated, again = np.zeros(n, bool), np.zeros(n, bool)
    several = 5  # symbols compared at a time: 45 bits, which a double holds exactly
    words = np.zeros(n + several, np.int64)
    for k in range(several):
        words[:n] = (words[:n] << 9) | np.append(symbols[k:], np.zeros(k, symbols.dtype))
    # Kasai, in lockstep: the t-th suffix of every context together
    common = np.zeros(len(sizes), np.int64)
    for t in range(int(sizes.max()) - length + 1):
        live = np.flatnonzero(sizes - t >= length)
        i = begin[live] + t
        at = place[i]
        j = order[np.maximum(at - 1, 0)]
        shared = np.where(at > 0, np.maximum(common[live] - 1, 0), 0)
        limit = np.where(at > 0, np.minimum(np.minimum(left[i], left[j]), length), 0)
        shared = np.minimum(shared, limit)
        going = np.flatnonzero(shared < limit)
        while len(going):
            depth = shared[going]
            differ = words[i[going] + depth] ^ words[j[going] + depth]
            same = several - (np.frexp(differ.astype(np.float64))[1] + 8) // 9
            shared[going] = depth + same
            going = going[(same == several) & (depth + same < limit[going])]
        shared = np.minimum(shared, limit)
        common[live] = shared
        full = shared >= length
        repeated[i[full]] = True
        repeated[j[full]] = True
        again[i[full]] = True  # an equal one precedes it in the order
    out = []
    for b, s in zip(begin, sizes):
        w = max(0, s - length + 1)
        out.append((repeated[b : b + w], ~again[b : b + w]))
    return out


def _spans(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the bytes covered by flagged windows, one span for each run of windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return [], []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return first.tolist(), (last + length).tolist()


_SHARD = "h long, c long, starts array<int>, ends array<int>, part int, k binary, kc binary, kt binary"


def _list_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                text, first, last, h, inner = window_runs(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(files[lo:hi][text]), pa.array(rows[lo:hi][text]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h), pa.array(inner)], names=["file", "row", "lo", "hi", "h", "inner"])

    return docs.select("file", "row", "text").transform(in_arrow, run, "file long, row long, lo int, hi int, h long, inner boolean")


def _cut_contexts(held: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = (batch.column(2)[k].as_py() or "").encode("utf-8")
                file, row, runs = (batch.column(c)[k].as_py() for c in (0, 1, 3))
                for at in range(0, len(runs), CHUNK):
                    some = runs[at : at + CHUNK]
                    n = len(some)
                    pieces = [text[r["lo"] : r["hi"] + length] for r in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array([r["lo"] for r in some], pa.int32()), pa.array([r["h"] for r in some], pa.int64()), pa.array([r["inner"] for r in some], pa.bool_()), pa.array(pieces, pa.binary())],
                        names=["file", "row", "lo", "h", "inner", "context"],
                    )

    return held.select("file", "row", "text", "runs").transform(in_arrow, run, "file long, row long, lo int, h long, inner boolean, context binary")


def _shards(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts (h, c, part, parts, context), an owner's part by part, in order -> spans, and keys of split owners."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("h", "c", "starts", "ends", "part", "k", "kc", "kt")}
        keys: dict[int, list] = {}
        for (h, c, _, parts, context), (flags, first) in zip(rows, windows_and_ranks([r[4] for r in rows], length)):
            starts, ends = _spans(flags, length)
            if starts:
                for k, v in zip(out, (h, c, starts, ends, None, None, None, None)):
                    out[k].append(v)
            if parts > 1:
                t = np.flatnonzero(first)
                data = np.frombuffer(context, np.uint8)
                keys.setdefault((h, parts), []).append((span_hash(prefix_hash(data), t, t + length), np.full(len(t), c), t))
        for (h, parts), found in keys.items():
            key, c, t = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(key, kind="stable")
            key, c, t = key[by], c[by], t[by]
            bounds = np.searchsorted(key >> _U(32), (np.arange(parts + 1, dtype=_U) << _U(32)) // _U(parts))
            for p in np.flatnonzero(np.diff(bounds)).tolist():  # never more rows than keys, however many ranges there are
                s = slice(bounds[p], bounds[p + 1])
                for k, v in zip(out, (h, None, None, None, p, key[s].tobytes(), c[s].astype(np.int64).tobytes(), t[s].astype(np.int32).tobytes())):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0], row[2]) != now and size >= SHARD_BYTES:
                    yield solve(held)
                    held, size = [], 0
                now = (row[0], row[2])
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return contexts.select("h", "c", "part", "parts", "context").repartition("h", "part").sortWithinPartitions("h", "part").transform(in_arrow, run, _SHARD)


def _across(keys: DataFrame, length: int) -> DataFrame:
    """Windows of split owners that several shards hold: each shard's sorted keys searched in the others'."""

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, _U) for k in table.column("k").to_pylist()]
        every = np.sort(np.concatenate(lists))
        owners, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for key, kc, kt in zip(lists, table.column("kc").to_pylist(), table.column("kt").to_pylist()):
            # a shard's keys are distinct, so more than its own one means another shard's
            met = np.searchsorted(every, key, side="right") - np.searchsorted(every, key, side="left") > 1
            owners.append(np.frombuffer(kc, np.int64)[met])
            at.append(np.frombuffer(kt, np.int32)[met])
        c, t = np.concatenate(owners), np.concatenate(at)
        one = pa.array(np.arange(len(t) + 1, dtype=np.int32))  # a list of one for each window
        h = np.full(len(t), table.column("h")[0].as_py(), np.int64)
        return pa.table({"h": h, "c": c, "starts": pa.ListArray.from_arrays(one, pa.array(t)), "ends": pa.ListArray.from_arrays(one, pa.array((t + length).astype(np.int32)))})

    return keys.groupBy("h", "part").applyInArrow(merge, "h long, c long, starts array<int>, ends array<int>")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    return starts[head], reach[np.append(head[1:], len(starts)) - 1]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (byte spans removed), kept_text
    (the remaining bytes; where a span cuts a character in two, its rest reads as U+FFFD)."""
    docs = located(df.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("doc")))
    docs = docs.select("doc.id", "doc.text", F.xxhash64("file").alias("file"), "row")
    runs = stored(_list_runs(docs, length, gram), "runs")
    owners = stored(runs.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("inner").alias("inner")).where("m > 1 or inner").select("h"), "owners")
    chosen = join_checked(runs, owners, "h", "left_semi").groupBy("file", "row").agg(F.collect_list(F.struct("lo", "hi", "h", "inner")).alias("runs"))  # of one document
    held = stored(docs.select("id", "file", "row", "text").join(chosen, ["file", "row"]), "held")
    release(runs, owners)

    places = _cut_contexts(held, length).withColumn("c", F.xxhash64("context"))
    contexts = stored(places.groupBy("h", "c", "context").agg(F.count(F.lit(1)).alias("m"), F.max("inner").alias("inner")), "contexts")
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("inner")).where("kinds > 1 or inner")
    several = stored(several.select("h", F.ceil(F.col("kinds") / hot).cast("int").alias("parts")), "several")
    split = join_checked(contexts.select("h", "c", "context"), several, "h", "inner").withColumn("part", F.pmod("c", "parts").cast("int"))
    shards = stored(_shards(split, length), "shards")
    spans = shards.where("part is null").select("h", "c", "starts", "ends")
    spans = spans.union(_across(shards.where("part is not null"), length))
    whole = contexts.where("m > 1").select("h", "c", F.array(F.lit(0)).alias("starts"), F.array(F.length("context").cast("int")).alias("ends"))
    spans = stored(spans.union(whole).groupBy("h", "c").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "spans")  # of one context
    release(contexts, several, shards)

    again = places.select("file", "row", "lo", "h", "c")
    found = join_checked(again, spans, ["h", "c"], "inner")
    shift = lambda a: F.transform(a, lambda x: x + F.col("lo"))
    found = found.groupBy("file", "row").agg(F.flatten(F.collect_list(shift("starts"))).alias("starts"), F.flatten(F.collect_list(shift("ends"))).alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            out = []
            for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                a, b = _merged(np.array(starts), np.array(ends))
                raw = (text or "").encode("utf-8")
                cuts = [0, *(x for pair in zip(a.tolist(), b.tolist()) for x in pair), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), a.tolist(), b.tolist(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds))], names=names)

    names = ["id", "file", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept_text"]
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, file long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>, kept_text string"
    lost = stored(held.join(found, ["file", "row"]).select("id", "file", "row", "text", "starts", "ends").transform(in_arrow, cut, schema), "lost")
    release(held, spans)
    raw, none = F.coalesce("text", F.lit("")), F.array().cast("array<int>")
    whole = join_checked(docs, stored(lost.select("file", "row"), "touched"), ["file", "row"], "left_anti")
    nothing = F.lit(0).cast("long")
    whole = whole.select("id", F.octet_length(raw).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"), raw.alias("kept_text"))
    return whole.unionByName(lost.drop("file", "row"))
