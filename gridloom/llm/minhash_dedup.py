"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts makes each document's distinct word shingles (64-bit hashes), 128 minima, 32 band keys of
   4 minima each, and the signature: the low 4 bits of every minimum, packed in bit planes (8 longs).
2. Documents with equal sets fall into one class; only its smallest id goes on.
3. Band buckets pair each member with one leader. Pairs whose collision-corrected similarity, from bit counts over the
   planes, lies more than DEVIATIONS standard deviations below the threshold go; the rest are confirmed on full sets.
4. Links join into components. In buckets whose members still lie in several components, members outside the largest
   one first meet its hub (the node of most links). What then remains apart is paired by an exact prefix
   filter: with a set's shingles in order of frequency, two linked sets must share one among their rarest few, and
   how few follows from both sizes. Only there do members of different components meet, and the same estimate and the
   full sets judge the pair. Pairs inside one component can't change the result and are never made.

A pair at similarity s shares no band with probability (1 - s**4)**32, 5e-8 at 0.8.

A document is named by its id, file and row, so rows that share an id (or have none) are documents of their own.

Edge cases: a text without words (null, empty, white space) has an empty set, is linked with nothing and is kept; with
fewer words than a shingle takes the whole sequence is one shingle; of repeated rows the first in order of file and row
stays; a null id sorts first; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BASE, in_arrow, join_checked, kept_as, located, mix, prefix_hash, release, span_hash, stored, text_slices, word_spans

_U = np.uint64

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
#: Standard deviations below the threshold at which an estimate still goes on to full sets.
DEVIATIONS = 4.5
#: Rounds in which what lies outside a bucket's largest component meets that component's hub, the node of most links.
HUB_ROUNDS = 1

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 1 << 64, MINIMA, dtype=_U) | _U(1)
_ADD = _rng.integers(0, 1 << 64, MINIMA, dtype=_U)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the bounds of the texts' parts."""
    data = _lower[data]
    start, end = word_spans(data, offsets)
    bounds = np.searchsorted(start, offsets)
    words = np.diff(bounds)
    n = len(words)
    hashes = span_hash(prefix_hash(data), start, end)
    doc = np.repeat(np.arange(n), words)
    place = np.arange(len(start)) - bounds[doc] if len(start) else np.zeros(0, np.int64)
    first = np.flatnonzero((place + size <= words[doc]) | (place == 0))  # a short text has one shingle, from its first word
    length = np.minimum(words[doc[first]], size)
    acc = np.zeros(len(first), _U)
    for k in range(size):
        at = np.minimum(first + k, len(hashes) - 1)
        acc = np.where(k < length, acc * _U(BASE) + hashes[at], acc)
    acc = mix(acc + length.astype(_U))
    owner = doc[first]
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    acc, owner = acc[fresh], owner[fresh]
    return acc, np.searchsorted(owner, np.arange(n + 1))


def _minima(sets: np.ndarray, starts: np.ndarray, functions: range) -> np.ndarray:
    """Minima of each text's set under the hash functions of these numbers, mixed so that their low bits are free."""
    out = np.empty((len(starts), len(functions)), _U)
    for at, k in enumerate(functions):
        out[:, at] = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], starts) if len(starts) else 0
    return mix(out)


def _planes(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of all minima, plane by plane, 64 to a long."""
    packed = [np.packbits(((minima >> _U(b)) & _U(1)).astype(np.uint8), axis=1).view(np.int64) for b in range(bits)]
    return np.concatenate(packed, axis=1) if len(minima) else np.zeros((0, bits * minima.shape[1] // 64), np.int64)


def _set_keys(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two words that name a set."""
    return np.stack([np.add.reduceat(mix(sets + _U(s)), starts) if len(starts) else np.zeros(0, _U) for s in (1, 2)], axis=1).view(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty text: two-word set key, band keys, bit planes."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    n = len(starts)
    minima = _minima(sets, starts, range(MINIMA))
    bands = np.zeros((n, BANDS), _U)
    for r in range(ROWS):
        bands = mix(bands * _U(BASE) + minima[:, r::ROWS])
    bands = mix(bands + np.arange(BANDS, dtype=_U) * _U(BASE))
    return _set_keys(sets, starts), bands.view(np.int64), _planes(minima, BITS)


def _digests(df: DataFrame, size: int) -> DataFrame:
    """id, n, k1, k2, bands, planes of each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, size)
                count = np.diff(bounds)
                key, bands, planes = signatures(sets, bounds)
                full = count > 0
                at = np.cumsum(full) - 1
                spread = lambda x: pa.array(np.where(full, x[np.maximum(at, 0)], 0) if len(x) else np.zeros(len(full), np.int64))
                lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * w)]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), spread(key[:, 0]), spread(key[:, 1]), lists(bands, BANDS), lists(planes, 2 * BITS)],
                    names=["id", "n", "k1", "k2", "bands", "planes"],
                )

    kind = df.schema[0].dataType.simpleString()
    return df.transform(in_arrow, run, f"id {kind}, n long, k1 long, k2 long, bands array<long>, planes array<long>")


def _sets(df: DataFrame, size: int) -> DataFrame:
    """id, n and full shingle set of each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), lists], names=["id", "n", "set"])

    return df.transform(in_arrow, run, f"id {df.schema[0].dataType.simpleString()}, n long, set array<long>")


def least_common(a: Column, b: Column, percent: int) -> Column:
    """Shingles that sets of a and b shingles must share for a link: 100 * i >= percent * (a + b - i)."""
    return F.ceil(percent * (a + b) / (100 + percent)).cast("long")


def size_class(n: Column) -> Column:
    """The least size of the class of n: its six leading binary digits."""
    cut = F.greatest(F.length(F.bin(n)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, cut), cut)


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members (node, n, comp, set) -> pairs (a, b) of different components that can be links: every link is among them.

    With all shingles in one order, rarest first, a smaller set x and a larger set y that share at least s shingles have
    a common one among the first |x| - s + 1 of x and the first |y| - s + 1 of y. For x the bound of its own size holds
    for every partner; y looks up each size class with that class's bound, so what is too far apart never meets. The
    position of the first common shingle bounds what can follow it."""
    held = members.select("node", "n", "comp", F.explode("set").alias("x"))
    often = stored(held.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    known = join_checked(held, often, "x", "inner").groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("known"))  # of one set
    low = F.ceil(percent * F.col("n") / 100).cast("long")
    known = known.withColumn("alone", F.col("n") - F.size("known"))  # shingles of no other set come first
    widest = (F.col("n") - least_common(low, F.col("n"), percent) + 1 - F.col("alone")).cast("int")
    known = stored(known.where(widest > 0).withColumn("known", F.slice("known", 1, F.greatest(widest, F.lit(1)))), "known")
    release(often)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(low)) - 6, F.lit(0)))
    classes = F.array_distinct(F.transform(F.sequence(size_class(low), F.col("n"), step), size_class))

    def listed(rows: DataFrame, s: Column, names: tuple[str, ...]) -> DataFrame:
        """The shingles within the prefix that a link of at least s common ones allows, with their positions."""
        reach = (F.col("n") - s + 1 - F.col("alone")).cast("int")
        return rows.select(*names, F.posexplode(F.when(reach > 0, F.slice("known", 1, F.greatest(reach, F.lit(1)))))).select(*names, F.col("col.x").alias("x"), (F.col("alone") + F.col("pos")).alias("at"))

    names = ("node", "n", "comp", "class", "alone")
    index = listed(known.withColumn("class", size_class(F.col("n"))), least_common(F.col("n"), F.col("n"), percent), names)
    probe = listed(known.withColumn("class", F.explode(classes)), least_common(F.greatest("class", low), F.col("n"), percent), names)
    key = ["x", "class"]
    index = stored(index.drop("alone"), "index")
    keys = stored(index.select(*key).distinct(), "keys")
    probe = stored(join_checked(probe.drop("alone"), keys, key, "left_semi"), "probe")
    release(known, keys)
    kinds = index.select(*key, "comp").union(probe.select(*key, "comp")).groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("c"))
    tops = stored(kinds.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "comp")).alias("top")).where("kinds > 1").select(*key, F.col("top.comp").alias("top")), "tops")
    a = stored(join_checked(index, tops, key, "inner").select(*key, "top", *(F.col(k).alias(f"{k}a") for k in ("node", "n", "comp", "at"))), "index")
    b = stored(join_checked(probe, tops, key, "inner").select(*key, *(F.col(k).alias(f"{k}b") for k in ("node", "n", "comp", "at")), "top"), "probe")
    release(index, probe, tops)
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    fits = (F.struct("na", "nodea") < F.struct("nb", "nodeb")) & (F.col("compa") != F.col("compb")) & (100 * F.col("na") >= percent * F.col("nb")) & (left >= least_common(F.col("na"), F.col("nb"), percent))
    # of what most members of a key belong to, none meets another
    far = a.where("compa != top").drop("top").join(b.drop("top"), key).where(fits)
    near = a.where("compa = top").drop("top").join(b.where("compb != top").drop("top"), key).where(fits)
    pairs = stored(far.union(near).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), "pairs")
    release(a, b)
    return pairs


def estimate(a: str, b: str, minima: int = MINIMA, bits: int = BITS) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    longs = minima // 64
    unequal = [" | ".join(f"({a}[{longs * i + h}] ^ {b}[{longs * i + h}])" for i in range(bits)) for h in range(longs)]
    same = F.lit(minima) - F.expr(" + ".join(f"bit_count({x})" for x in unequal))
    agree = 1 / (1 << bits)  # chance that unequal minima agree in their low bits
    return (same / minima - agree) / (1 - agree)


def least_estimate(percent: int, minima: int = MINIMA, bits: int = BITS) -> float:
    """The threshold less DEVIATIONS standard deviations of the estimate."""
    s, agree = percent / 100, 1 / (1 << bits)
    p = agree + (1 - agree) * s
    return s - DEVIATIONS * (p * (1 - p) / minima) ** 0.5 / (1 - agree)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> id, comp: the smallest id reachable. Smallest labels spread and pointers are doubled; every
    round is written to the shared folder."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = join_checked(both, label.select(F.col("id").alias("b"), "comp"), "b", "inner").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = join_checked(near, label, "id", "inner").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = join_checked(step, label.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp", "left")
        after = stored(jump.select("id", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        release(label)
        if after.where("comp < old").isEmpty():
            release(both)
            return kept_as(after, after.select("id", "comp"))
        label = kept_as(after, after.select("id", "comp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80, place: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id is component_id), first (the row that stays: its
    component's first in order of id, file and row), file, row (the locator; place names the columns that hold it, if
    the input has them already)."""
    if place is None:
        df = located(df.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("doc")))
        docs = df.select(F.struct("doc.id", F.xxhash64("file").alias("file"), "row").alias("id"), "doc.text")
    else:
        docs = df.select(F.struct(F.col(id_col).alias("id"), F.col(place[0]).alias("file"), F.col(place[1]).alias("row")).alias("id"), F.col(text_col).alias("text"))
    digests = stored(_digests(docs, shingle), "digests")
    filled = digests.where("n > 0")
    classes = stored(filled.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.min_by(F.struct("bands", "planes"), F.col("id")).alias("s")).select("node", "k1", "k2", "n", "s.bands", "s.planes"), "classes")
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader")).where("m > 1").drop("m"), "shared")
    buckets = stored(join_checked(bands, shared, "band", "inner").select("band", "node", "leader"), "buckets")
    release(shared)
    # only what shares a bucket is compared
    met = stored(buckets.select("node").distinct(), "met")
    planes = stored(join_checked(classes.select("node", "n", "planes"), met, "node", "left_semi"), "planes")
    release(met)

    def side(s: str) -> DataFrame:
        return planes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("planes").alias(f"p{s}"))

    likely_pair = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("pa", "pb") >= least_estimate(percent))

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes whose signatures allow a link."""
        both = join_checked(join_checked(pairs.distinct(), side("a"), "a", "inner"), side("b"), "b", "inner")
        return both.where(likely_pair).select("a", "b", "na", "nb")

    def confirmed(likely: DataFrame) -> DataFrame:
        """Of likely pairs those that are links on full sets, as a stored table."""
        likely = stored(likely, "likely")
        wanted = stored(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "wanted")
        sets = stored(_sets(join_checked(docs, wanted, "id", "left_semi").select("id", "text"), shingle).drop("n"), "sets")
        held = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"s{s}"))
        both = F.size(F.array_intersect("sa", "sb"))
        pairs = likely.join(held("b"), "b").join(held("a"), "a")
        out = stored(pairs.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "links")
        release(likely, wanted, sets)
        return out

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after further links, which are carried over to the components they join."""
        named = comp.withColumnRenamed("id", "a").withColumnRenamed("comp", "ca")
        over = join_checked(links, named, "a", "left").select(F.coalesce("ca", "a").alias("a"), "b")
        over = join_checked(over, named.toDF("b", "cb"), "b", "left").select("a", F.coalesce("cb", "b").alias("b")).where("a != b")
        new = components(over).toDF("comp", "new")
        moved = join_checked(comp, new, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
        fresh = join_checked(new, comp.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("new").alias("comp"))
        out = stored(moved.unionByName(fresh), "components")
        release(comp)
        return out

    links = confirmed(estimated(buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))))
    comp = components(links)
    for turn in range(HUB_ROUNDS + 1):
        member = join_checked(buckets.select("band", "node"), comp.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        parts = member.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
        mixed = stored(parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "comp")).alias("top")).where("parts > 1").select("band", F.col("top.comp").alias("top")), "mixed")
        inside = stored(join_checked(member, mixed, "band", "inner"), "inside")
        done = [mixed, inside]
        if inside.isEmpty():
            release(*done)
            break
        outer = inside.where("comp != top")
        if turn < HUB_ROUNDS:
            ends = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
            hubs = stored(join_checked(ends, comp, "id", "inner").groupBy(F.col("comp").alias("top")).agg(F.max_by("id", F.struct("d", "id")).alias("hub")), "hubs")
            pairs = estimated(join_checked(outer.select("top", "node").distinct(), hubs, "top", "inner").select(F.col("hub").alias("a"), F.col("node").alias("b")))
            done.append(hubs)
        else:
            rest = stored(inside.select(F.col("node").alias("id"), "comp").distinct(), "rest")
            sets = _sets(join_checked(docs, rest.select("id"), "id", "left_semi").select("id", "text"), shingle)
            members = stored(join_checked(sets, rest, "id", "inner").withColumnRenamed("id", "node"), "members")
            close = prefix_pairs(members, percent)
            release(members, rest)
            pairs = estimated(close)
            done.append(close)
        fresh = confirmed(pairs)
        release(*done)
        comp = joined(comp, fresh)
        links = links.unionByName(fresh)
    release(buckets, planes)
    named = join_checked(classes.select("k1", "k2", "n", "node"), comp.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "n", F.coalesce("comp", "node").alias("comp"))
    named = stored(named, "named")
    release(classes, comp)
    top = F.coalesce("comp", "id")
    return join_checked(digests.select("id", "k1", "k2", "n"), named, ["k1", "k2", "n"], "left").select(
        "id.id", F.col("n").alias("n_shingles"), top.getField("id").alias("component_id"), F.col("id.id").eqNullSafe(top.getField("id")).alias("kept"), (F.col("id") == top).alias("first"), "id.file", "id.row"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows that stay, all columns as they are: one of each group, the first by id."""
    names = [F.col(f"`{c}`") for c in df.columns]
    docs = located(df.select(F.struct(*names).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("file", F.xxhash64("file"))
    gone = stored(near_duplicates(docs, "id", "text", shingle, percent, place=("file", "row")).where("not first").select("file", "row"), "gone")
    return join_checked(docs, gone, ["file", "row"], "left_anti").select("doc.*")
