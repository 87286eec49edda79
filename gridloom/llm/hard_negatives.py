"""Hard negatives by inner product over one-dimensional distance keys.

With one more coordinate, sqrt(M * M - |x|**2) for rows and 0 for anchors (M the longest row), the largest inner product
is the least distance: |q - x|**2 = M * M + |q|**2 - 2 q x, a whole number for whole components. Each row belongs to its
nearest pivot, and its key is (pivot, distance to it). Rows stand sorted by key, packed into blocks of one pivot with
their least and largest distance. A query scans annuli: by the triangle inequality a row within `reach` of it has a
key within `reach` of the query's own distance to that pivot, so the intervals round those distances are scanned and
widened until the reach is no less than the k-th best distance, which certifies the k best. Queries go in batches
of neighbours; a batch widens as far as its widest query needs.

Pivots (Lloyd's rounds) and the first reach come from a sample of at most SAMPLE rows of smallest hash; they decide how
much is scanned, not what is found. Of rows with equal label and vector only as many smallest ids as a query returns
(and one, for the anchor itself) can be returned, so the rest leaves before the index: a vector that a third of all
rows share costs no more than others.

Edge cases: rows with a null id, label, vector or component or a component that isn't finite take no part, empty
vectors neither; shorter vectors count as padded with zeros; rows that repeat id, label and vector count once, an anchor
never meets rows of its own id; ties fall to smaller ids; no rows or one label give an empty result; other columns are
left out, whatever their names. Vectors whose squared length is 2**53 or more are refused, as products wouldn't be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_arrow, release, stored

#: Factor of a component before it is rounded down; positives of an anchor and negatives of a pair.
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these percents of the positive's.
LOW, HIGH = 30, 90
#: Sample, pivots and rounds of their fit; rows of a block, queries of a batch, batches that one copy of a block serves.
SAMPLE, PIVOTS, LLOYD, BLOCK, BATCH, SHARE = 4096, 32, 8, 2048, 128, 64
#: Widenings before everything left is scanned.
WIDENINGS = 6

_FAR = 1 << 62
_ITEM = "id long, label long, vec binary, norm long"
_KEYED = "pivot int, dist double, id long, label long, vec binary"


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label, vec (32-bit integers, packed, as long as the longest vector) and its squared length; rows that take no part are gone."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)).where(whole)
    longest = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(lists), longest))
            x[np.arange(longest) < sizes[:, None]] = np.floor(scale * lists.flatten().to_numpy())
            norm = (x * x).sum(axis=1)
            if len(norm) and norm.max() >= 1 << 53:
                raise ValueError("a vector is too long for exact products")
            packed = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(norm.astype(np.int64))], names=["id", "label", "vec", "norm"])

    return rows.transform(in_arrow, run, _ITEM)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(n, -1).astype(np.float64)


class Pivots:
    """Pivots in augmented space, what it takes to get there, and the sample's reach."""

    def __init__(self, sample: list, longest: int, pivots: int, k: int):
        """sample: rows (vec, label); longest: the largest squared length of all rows."""
        self.longest = float(longest)
        x = self.augmented(np.array([np.frombuffer(r.vec, "<i4") for r in sample], float))
        rng = np.random.default_rng(5)
        at = x[rng.permutation(len(x))[:pivots]]
        for _ in range(LLOYD):
            near = self._squares(x, at).argmin(axis=1)
            at = np.array([x[near == c].mean(axis=0) if (near == c).any() else at[c] for c in range(len(at))])
        self.at = at
        label = np.array([r.label for r in sample])
        reach = []
        for i in range(0, len(x), max(1, len(x) // 256)):
            d = np.sort(np.sqrt(np.maximum(0, ((x[label == label[i], :-1] - x[i, :-1]) ** 2).sum(axis=1) + x[label == label[i], -1] ** 2)))
            reach.append(d[min(k, len(d) - 1)])
        self.reach = float(np.median(reach))

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))[:, None]], axis=1)

    @staticmethod
    def _squares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ at.T + (at * at).sum(axis=1))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To every pivot, of queries (their last coordinate is 0) or of rows."""
        return np.sqrt(self._squares(np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.augmented(x), self.at))


def keyed(items: DataFrame, pivots: Pivots, columns: str, query: bool) -> DataFrame:
    """Rows with their nearest pivot and the distance to it in front."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column(names.index("vec"))), query)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *batch.columns], names=["pivot", "dist", *names])

    return items.transform(in_arrow, run, f"pivot int, dist double, {columns}")


def packed(rows: DataFrame, most: int, whole_pivots: bool) -> DataFrame:
    """Rows sorted by key as packs of consecutive ones: pack (its first row's place), pivot, lo and hi of the keys, every column
    end to end. whole_pivots: a pack may hold several pivots' rows (queries)."""
    rows = stored(rows, "keyed")
    order = ["pivot", "dist", *(c for c in ("id", "qid") if c in rows.columns)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    data = [c for c in rows.columns if c not in ("pivot", "dist")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def out() -> pa.RecordBatch:
            nonlocal held, count
            t = pa.Table.from_batches(held).combine_chunks()
            dist = t.column("dist").to_numpy()
            held, count = [], 0
            cols = [pa.array([t.column("at")[0].as_py()]), pa.array([t.column("pivot")[0].as_py()], pa.int32()), pa.array([dist.min()]), pa.array([dist.max()])]
            for c in data:
                column = t.column(c).combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                cols.append(pa.array([b"".join(column.to_pylist()) if kinds[c] == "binary" else column.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=["pack", "pivot", "lo", "hi", *data])

        for batch in batches:
            pivot = batch.column(0).to_numpy()
            edges = [] if whole_pivots else (np.flatnonzero(np.diff(pivot)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if held and not whole_pivots and held[-1].column(0)[0].as_py() != pivot[a]:
                    yield out()
                while a < b:
                    n = min(b - a, most - count)
                    held.append(batch.slice(a, n))
                    count += n
                    a += n
                    if count == most:
                        yield out()
        if held:
            yield out()

    return stored(ranged.transform(in_arrow, run, ", ".join(["pack long, pivot int, lo double, hi double", *(f"{c} binary" for c in data)])), "packs")


class Index:
    """Blocks of rows by key."""

    def __init__(self, items: DataFrame, keep: int, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, k: int = POSITIVES):
        """items: whole_vectors' rows; keep: how many of equal rows a query can need."""
        self.spark = items.sparkSession
        once = items.groupBy("label", "vec", "id").agg(F.first("norm").alias("norm"))
        once = once.withColumn("copy", F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))).where(F.col("copy") <= keep).drop("copy")
        once = stored(once, "once")
        drawn = once.select("vec", "label", "id").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(sample).collect()
        self.pivots = Pivots(drawn, once.agg(F.max("norm")).first()[0], pivots, k) if drawn else None
        self.blocks = packed(keyed(once.select("id", "label", "vec"), self.pivots, "id long, label long, vec binary", False), block, False) if drawn else None
        release(once)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "hit")
    return hits.select("qid", "score", "hit").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, batch: int = BATCH, share: int = SHARE) -> DataFrame:
    """queries: qid, id, label, vec, norm, same (1 for rows of the label, 0 for others), low and high (bounds of the
    score) -> qid, score, hit, rank: each query's k best rows, all if fewer, in order of score, then id."""
    p = index.pivots
    batches = packed(keyed(queries.select("qid", "id", "label", "vec", "norm", "same", "low", "high"), p, "qid long, id long, label long, vec binary, norm long, same long, low long, high long", True), batch, True)
    spans = ", ".join(["pack long, qids array<long>, nears array<double>, fars array<double>", "lo array<double>, hi array<double>"])

    def reach_of(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            rows: list[list] = [[] for _ in range(6)]
            for r in b.to_pylist():
                qid, norm, low, high = (np.frombuffer(r[c], "<i8") for c in ("qid", "norm", "low", "high"))
                square = p.longest + norm
                near = np.sqrt(np.maximum(0, square - 2.0 * high))
                far = np.sqrt(np.maximum(0, square - 2.0 * low))
                d = p.distances(np.frombuffer(r["vec"], "<i4").reshape(len(qid), -1).astype(float), True)
                for to, v in zip(rows, (r["pack"], qid, near, far, d.min(axis=0), d.max(axis=0))):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), *(pa.array(c, pa.list_(pa.float64())) for c in rows[2:])], names=["pack", "qids", "nears", "fars", "lo", "hi"])

    known = stored(batches.transform(in_arrow, reach_of, spans), "spans")
    # one row a batch; what it needs of the blocks are ranges of keys, pivot by pivot
    state = known.select("pack", F.array_min("nears").alias("near"), F.array_max("fars").alias("far"), F.lit(-1.0).alias("done"), (F.array_min("nears") + F.lit(p.reach)).alias("reach"))
    state = stored(state.withColumn("bundle", F.expr(f"pack div {batch * share}")), "state")
    sides = known.select("pack", F.posexplode(F.arrays_zip("lo", "hi")).alias("pivot", "span")).select("pack", "pivot", F.col("span.lo").alias("qlo"), F.col("span.hi").alias("qhi"))
    ends = known.select("pack", F.explode(F.arrays_zip("qids", "nears", "fars")).alias("q")).select("pack", F.col("q.qids").alias("qid"), F.col("q.nears").alias("near"), F.col("q.fars").alias("far"))
    norms = queries.select("qid", "norm")
    found = None
    slack = 1e-6 * np.sqrt(p.longest + 1)
    for turn in range(WIDENINGS + 1):
        least = F.greatest(F.lit(0.0), F.col("qlo") - F.col("hi"), F.col("lo") - F.col("qhi"))
        pairs = state.join(sides, "pack").join(index.blocks.select(F.col("pack").alias("block"), "pivot", "lo", "hi"), "pivot")
        pairs = pairs.where((least <= F.col("reach") + slack) & (least > F.col("done") + slack) & (F.col("qhi") + F.col("hi") >= F.col("near") - slack)).select("pack", "bundle", "block")
        pairs = stored(pairs, "pairs")
        bars = None if found is None else found.where(F.col("rank") == k).select("qid", F.col("score").alias("bar"))
        new = _scanned(index, batches, pairs, bars, known, k)
        hits = stored(_best(new if found is None else found.select("qid", "score", "hit").unionByName(new), k), "hits")
        last = hits.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        # a query is settled where its k-th best, or all that its bounds allow, lies within the reach
        marks = ends.join(state.select("pack", "reach", F.col("near").alias("from")), "pack").join(last, "qid", "left").join(norms, "qid")
        kth = F.sqrt(F.greatest(F.lit(0.0), F.lit(p.longest) + F.col("norm") - 2 * F.col("kth")))
        wider = F.lit(float("inf")) if turn == WIDENINGS - 1 else 2 * F.col("reach") - F.col("from") + p.reach / 2
        wide = marks.select("pack", "reach", F.least("far", F.coalesce(kth, F.lit(float("inf")))).alias("end"), F.least("far", F.coalesce(kth, wider)).alias("next"))
        wide = wide.where(F.col("end") > F.col("reach")).groupBy("pack").agg(F.max("next").alias("next"))
        state_next = state.join(wide, "pack").select("pack", "near", "far", F.col("reach").alias("done"), F.col("next").alias("reach"), "bundle")
        state_next = stored(state_next, "state")
        release(pairs, state, *([found] if found is not None else []))
        found, state = hits, state_next
        if state.isEmpty():
            break
    release(batches, known, state)
    return found


def _scanned(index: Index, batches: DataFrame, pairs: DataFrame, bars: DataFrame | None, known: DataFrame, k: int) -> DataFrame:
    """Of every (batch, block) pair each query's k best rows, if better than what it has. A copy of a block meets the
    batches of one bundle, one after the other."""
    block = pairs.select("bundle", "block").distinct().join(index.blocks.select(F.col("pack").alias("block"), "id", "label", "vec"), "block")
    none = F.lit(None).cast("binary")
    block = block.select("block", "bundle", F.lit(0).alias("kind"), none.alias("qid"), "id", "label", "vec", none.alias("same"), none.alias("low"), none.alias("high"), F.lit(None).cast("map<long,long>").alias("bars"))
    asked = batches.select("pack", "qid", "id", "label", "vec", "same", "low", "high")
    if bars is not None:
        ends = known.select("pack", F.explode("qids").alias("qid")).join(bars, "qid").groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("qid", "bar"))).alias("bars"))  # of one batch
        asked = asked.join(ends, "pack", "left")
    else:
        asked = asked.withColumn("bars", F.lit(None).cast("map<long,long>"))
    asked = pairs.join(asked, "pack").select("block", "bundle", F.lit(1).alias("kind"), "qid", "id", "label", "vec", "same", "low", "high", "bars")
    both = block.unionByName(asked).repartition("block", "bundle").sortWithinPartitions("block", "bundle", "kind")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for r in b.to_pylist():
                ids, labels = np.frombuffer(r["id"], "<i8"), np.frombuffer(r["label"], "<i8")
                x = np.frombuffer(r["vec"], "<i4").reshape(len(ids), -1).astype(np.float64)
                if r["kind"] == 0:
                    order = np.argsort(ids, kind="stable")
                    held = ids[order], labels[order], x[order].T.copy()
                    continue
                qid, same, low, high = (np.frombuffer(r[c], "<i8") for c in ("qid", "same", "low", "high"))
                bar = dict(r["bars"] or ())
                low = np.maximum(low, [bar.get(q, -_FAR) for q in qid.tolist()])
                score = (x @ held[2]).astype(np.int64)
                fits = (score >= low[:, None]) & (score <= high[:, None]) & ((labels[:, None] == held[1]) == (same[:, None] == 1)) & (ids[:, None] != held[0])
                rows, cols = np.nonzero(fits)
                if not len(rows):
                    continue
                points = score[rows, cols]
                turn = np.lexsort((cols, -points, rows))  # columns stand by id
                rows, cols, points = rows[turn], cols[turn], points[turn]
                first = np.searchsorted(rows, rows)
                keep = np.arange(len(rows)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows[keep]]), pa.array(points[keep]), pa.array(held[0][cols[keep]])], names=["qid", "score", "hit"])

    return both.transform(in_arrow, run, "qid long, score long, hit long")


def hard_negatives(df: DataFrame, anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, **index_args) -> DataFrame:
    """anchor: a condition on `id`. For each anchor and each of its first `positives` other rows of its label, the first
    `negatives` rows of other labels whose score lies between `low` and `high` percent of the positive's."""
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    items = stored(whole_vectors(df, id_col, vec_col, label_col, scale), "vectors")
    index = Index(items, max(positives + 1, negatives), k=positives, **index_args)
    if index.pivots is None:
        return spark.createDataFrame([], schema)
    anchors = stored(items.where(anchor).distinct().withColumn("qid", F.monotonically_increasing_id()), "anchors")
    if anchors.isEmpty():
        return spark.createDataFrame([], schema)
    first = search(index, anchors.select("*", F.lit(1).cast("long").alias("same"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high")), positives)
    # 100 * negative lies between low and high times positive
    lower, upper = F.ceil(F.col("score") * low / F.lit(100.0)), F.floor(F.col("score") * high / F.lit(100.0))
    asked = first.select(F.col("qid").alias("anchor"), "score", "hit", lower.cast("long").alias("low"), upper.cast("long").alias("high")).where("low <= high")
    asked = stored(asked.withColumn("qid", F.monotonically_increasing_id()), "pairs")
    if asked.isEmpty():
        return spark.createDataFrame([], schema)
    known = anchors.select(F.col("qid").alias("anchor"), "id", "label", "vec", "norm")
    queries = stored(asked.join(known, "anchor").select("qid", "id", "label", "vec", "norm", F.lit(0).cast("long").alias("same"), "low", "high"), "queries")
    second = search(index, queries, negatives)
    out = second.select("qid", F.col("score").alias("negative_score"), F.col("hit").alias("negative_id"), "rank")
    out = out.join(asked.select("qid", "anchor", F.col("score").alias("positive_score"), F.col("hit").alias("positive_id")), "qid").join(known.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
