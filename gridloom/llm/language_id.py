"""Language identification by a byte convolutional network, trained in numpy.

Filters of widths 2, 3 and 4 slide over fixed-length windows of UTF-8 bytes; each filter's maximum over a window feeds
a softmax layer. A filter is a sum of table rows, one per byte it sees, so the network is trained as 256-row tables and
applied as tables over byte pairs: a few gathers per byte. A text's windows, all WINDOW bytes long, cover all its bytes
(the last ends with the text; a short text is padded with spaces); their log-probabilities, weighted by the bytes that
each adds, are averaged into the text's own distribution.

Every label value is learned. Training takes labelled rows only: of each language's different rows (id and text) the
`sample` of smallest hash, or so many that all languages together stay under `rows`, and of each `pieces` windows spread
evenly over the whole text (a text with fewer gives all it has). What reaches the driver is thus bounded by
(rows + LEAST * languages) * pieces * WINDOW bytes. sample, rows and pieces are arguments of `fit`.

Edge cases: a text that is null or has no letter is `und` with score 0; with one learned language (or none) that one
(or `und`) is predicted; labels whose texts have no letter aren't learned; rows that share an id, or have none, are told
apart by their texts; predictions depend on the text alone; repeated rows get equal predictions; an empty table gives an
empty result; other columns are kept (those that bear a result's name are replaced).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_arrow, join_checked, stored, text_slices, with_fields

WINDOW = 256
FILTERS = 8
WIDTHS = (2, 3, 4)
#: Labelled rows of a language and of all together, the rows that each language has at least, and windows of a row.
SAMPLE, ROWS, LEAST, PIECES = 400, 100_000, 10, 6
STEPS, BATCH, RATE = 700, 128, 0.01
#: A text's windows are predicted so many at a time.
CHUNK = 1 << 9


class ByteNet:
    """tables[w][k]: what the k-th byte under a filter of width w adds, for each byte value and filter."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Max-pooled filters of windows (rows of bytes) and where the maxima lie."""
        pooled, where = [], {}
        for w in WIDTHS:
            t = self.tables[w]
            steps = x.shape[1] - w + 1
            v = t[0][x[:, :steps]]
            for k in range(1, w):
                v = v + t[k][x[:, k : k + steps]]
            where[w] = v.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(v, where[w][:, None, :], 1)[:, 0] + self.bias[w], 0))
        return np.concatenate(pooled, axis=1), where

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        """Adam on the cross-entropy of balanced batches."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            at = np.array([rng.choice(by[k]) for k in rng.integers(0, len(by), BATCH)])
            xb, yb = x[at], y[at]
            hidden, where = self._features(xb)
            logits = hidden @ self.out + self.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(BATCH), yb] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (hidden > 0)
            tables, biases = [], []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                t = np.zeros_like(self.tables[w])
                for k in range(w):
                    np.add.at(t[k], (np.take_along_axis(xb, where[w] + k, 1), np.arange(FILTERS)[None, :].repeat(BATCH, 0)), g)
                tables.append(t)
                biases.append(g.sum(axis=0))
            rate = RATE * (1 - 0.9 * step / STEPS)
            for j, g in enumerate([*tables, *biases, hidden.T @ p, p.sum(axis=0)]):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def ready(self) -> ByteNet:
        """Tables over byte pairs, for prediction."""
        t = self.tables
        both = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, -1)
        # one row of a pair holds what all three widths take from it as their first two bytes
        self.head = np.concatenate([both(t[w][0], t[w][1]) for w in WIDTHS], axis=1)
        self.third = t[3][2]
        self.tail = both(t[4][2], t[4][3])
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """What _features gives for windows (rows of bytes), by tables over byte pairs."""
        x = x.astype(np.int32)
        pair = x[:, :-1] * 256 + x[:, 1:]
        v = self.head[pair]
        v[:, :-1, FILTERS : 2 * FILTERS] += self.third[x[:, 2:]]
        v[:, :-2, 2 * FILTERS :] += self.tail[pair[:, 2:]]
        best = [v[:, : x.shape[1] - w + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) + self.bias[w] for i, w in enumerate(WIDTHS)]
        return np.maximum(np.concatenate(best, axis=1), 0)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its probability, for each text of a slice; every byte lies in a window."""
        size = np.diff(offsets)
        n = len(size)
        count = np.maximum(1, -(-size // WINDOW))
        text = np.repeat(np.arange(n), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(0, np.minimum(k * WINDOW, size[text] - WINDOW))
        new = np.maximum(1, np.minimum(size[text] - k * WINDOW, WINDOW))  # bytes that no earlier window has
        total = np.zeros((n, len(self.languages)))
        step = np.arange(WINDOW)
        for lo in range(0, len(text), CHUNK):
            t, s = text[lo : lo + CHUNK], start[lo : lo + CHUNK]
            at = s[:, None] + step
            x = np.where(at < size[t][:, None], data[np.minimum(offsets[t][:, None] + at, len(data) - 1)] if len(data) else 32, 32)
            logits = self.pooled(x) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
            np.add.at(total, t, logs * new[lo : lo + CHUNK, None])
        mean = total / np.maximum(size, 1)[:, None]
        mean = np.exp(mean - mean.max(axis=1, keepdims=True))
        mean /= mean.sum(axis=1, keepdims=True)
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(n), best], 0, 1)

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, languages=np.array(self.languages), out=self.out, out_bias=self.out_bias, **{f"t{w}": self.tables[w] for w in WIDTHS}, **{f"b{w}": self.bias[w] for w in WIDTHS})
        return to.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> ByteNet:
        got = np.load(io.BytesIO(raw))
        net = cls([str(x) for x in got["languages"]])
        net.tables, net.bias = {w: got[f"t{w}"] for w in WIDTHS}, {w: got[f"b{w}"] for w in WIDTHS}
        net.out, net.out_bias = got["out"], got["out_bias"]
        return net.ready()


def pieces_of(raw: bytes, most: int = PIECES) -> list[bytes]:
    """Windows spread evenly over a whole text, at most so many, short ones padded with spaces."""
    n = max(1, min(most, len(raw) // WINDOW))
    starts = [(len(raw) - WINDOW) * k // max(1, n - 1) if n > 1 else 0 for k in range(n)]
    return [raw[s : s + WINDOW].ljust(WINDOW) for s in starts]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rows: int = ROWS, pieces: int = PIECES) -> ByteNet:
    """Train on labelled rows; the rows taken depend on ids, labels and texts alone, not on partitions."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = stored(labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "labels")
    languages = sorted(r.lang for r in counts.select("lang").collect())  # the network has an output for each label value
    net = ByteNet(languages)
    if len(languages) < 2:
        return net.ready()
    most = max(LEAST, min(sample, rows // len(languages)))
    # different rows below a hash threshold: about twice as many as wanted (all of a rare language), of which the smallest hashes stay
    rate = F.when(F.col("n") > 4 * most, F.least(F.lit(1.0), 2.0 * most / F.col("n"))).otherwise(1.0)
    near = F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    different = join_checked(labelled, counts, "lang", "inner").where(near).groupBy("lang", "h").agg(F.min("text").alias("text"))
    taken = different.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, h, j, p) for lang, h, t in zip(*(c.to_pylist() for c in batch.columns)) for j, p in enumerate(pieces_of(t.encode("utf-8"), pieces))]
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["lang", "h", "j", "piece"])

    drawn = taken.select("lang", "h", "text").transform(in_arrow, cut, "lang string, h long, j int, piece binary").collect()
    chosen: dict[str, list] = {k: [] for k in languages}
    for r in sorted(drawn, key=lambda r: (r.lang, r.h, r.j)):
        chosen[r.lang].append(bytes(r.piece))
    x = np.array([np.frombuffer(p, np.uint8) for k in languages for p in chosen[k]]).reshape(-1, WINDOW)
    y = np.array([i for i, k in enumerate(languages) for _ in chosen[k]])
    if missing := [k for k, v in chosen.items() if not v]:
        raise RuntimeError(f"no labelled row was drawn for {missing}")
    net.train(x, y)
    return net.ready()


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, net: ByteNet, text_col: str = "text") -> DataFrame:
    """The input with lang_pred and score."""
    names = ["lang_pred", "score"]
    df = df.drop(*names)
    raw = net.dump()  # some hundred kB, whatever the input
    spoken = df.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))  # by place: names may clash
    spoken = spoken.toDF(*(f"c{k}" for k in range(len(spoken.columns))))
    at, kept = df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNet.load(raw)
        labels = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in text_slices(batch.column(at), 1 << 20):
                part = batch.slice(lo, hi - lo)
                if model.languages:
                    best, score = model.predict(data, offsets)
                else:
                    best, score = np.zeros(hi - lo, int), np.zeros(hi - lo)
                best = np.where(letters[lo:hi], best, len(model.languages))
                score = np.where(letters[lo:hi], score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(labels[best], pa.string()), pa.array(score, pa.float64())], names=[*kept, *names])

    return spoken.transform(in_arrow, run, with_fields(df.schema, lang_pred="string", score="double"))
