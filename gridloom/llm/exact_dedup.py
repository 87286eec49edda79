"""Exact deduplication as a stateful stream.

Documents arrive as a feed of (id, digest, code points, content locator). A streaming aggregation keeps one state row
per digest in RocksDB, without watermark or expiry: the group's size and its best row (most code points, then
smallest id) with that row's locator, the file and row that hold its content. Partial aggregation precedes the
shuffle, so a hot group sends one row per task. A later feed into the same state folder meets the state of earlier
ones. Digests met more than once are hits: their documents' full normalised bytes are then compared, by grouping on
them; what an earlier feed holds is fetched by its locator. Should two texts ever share a digest, each text forms a
group of its own (such digests are remembered, and all their rows fetched again by later feeds).

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Edge cases: null and empty texts
are equal to each other; of rows that agree in everything exactly one is kept; a null id sorts first; an empty table
gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS_CLASS, join_checked, located, scratch_path, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming.stateStore"
#: RocksDB keeps the state: without preallocation, which would take some MB of disk for each partition, and with one
#: bound on the memory of all partitions of an executor.
_SETTINGS = {f"{_STATE}.providerClass": ROCKSDB, f"{_STATE}.rocksdb.allowFAllocate": "false", f"{_STATE}.rocksdb.boundedMemoryUsage": "true", f"{_STATE}.rocksdb.maxMemoryUsageMB": "128"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS_CLASS}+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DedupState:
    """Keyed state in a folder that all executors share; every feed continues it."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_path(spark, "dedup")

    def has(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def feed(self, rows: DataFrame) -> None:
        """Append rows (id, digest, points, file, row and where the file has the text) to the feed and run the stream
        over what is new."""
        rows.write.mode("append").parquet(f"{self.folder}/feed")
        before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            state = (
                self.spark.readStream.schema(rows.schema)
                .parquet(f"{self.folder}/feed")
                .groupBy("digest")
                .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("points")).alias("points"), "id", "file", "row")).alias("best"))
            )
            folder = self.folder

            def write(changed: DataFrame, batch: int) -> None:
                changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

            query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def rows(self) -> DataFrame:
        """All rows fed so far."""
        return self.spark.read.parquet(f"{self.folder}/feed")

    def content(self, places: DataFrame) -> DataFrame:
        """places (file, row, column, sha, ...) with the normalised texts that stand there. The text of a feed must be
        a column of its files (or of what was kept beside the state): anything else fails here by its sha."""
        wanted = stored(places, "places")
        out = None
        for (column,) in wanted.select("column").distinct().collect():  # a few: one for each way a feed was written
            some = wanted.where(F.col("column") == column)
            files = [r[0] for r in some.select("file").distinct().collect()]  # as many as a scan lists
            texts = self.spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.expr(column)).alias("norm"))
            found = some.join(texts, ["file", "row"])
            found = found.withColumn("norm", F.when(sha256(F.col("norm")) == F.col("sha"), F.col("norm")).otherwise(F.raise_error(F.lit("a locator leads to another text than was fed"))))
            out = found if out is None else out.unionByName(found)
        return wanted.withColumn("norm", F.lit("")) if out is None else out

    def clashing(self) -> DataFrame:
        """Digests that several texts were found to share."""
        return self.spark.read.parquet(f"{self.folder}/clashes") if self.has("clashes") else self.spark.createDataFrame([], "digest string")

    def hits(self) -> DataFrame:
        """Digests met more than once: digest, n, best."""
        last = F.max_by(F.struct("n", "best"), F.col("batch")).alias("s")
        return self.spark.read.parquet(f"{self.folder}/changes").groupBy("digest").agg(last).select("digest", "s.*").where("n > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: DedupState | None = None, digest: Callable[[Column], Column] = sha256, place: tuple[str, str] | None = None, content: str | None = None) -> DataFrame:
    """One row per row fed so far: id, keep_id, group_size, kept, text_sha256, file, row (the locator; place names the
    columns that hold it, if the input has them already, and content says where its files have the text)."""
    state = state or DedupState(df.sparkSession)
    earlier = state.has("feed")
    feed_name = uuid.uuid4().hex
    column = f"`{text_col}`"
    if place is None:
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        try:
            docs = rows.select("id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:  # rows that come from no file are kept beside the state
            rows.write.parquet(f"{state.folder}/content/{feed_name}")
            docs = df.sparkSession.read.schema(rows.schema).parquet(f"{state.folder}/content/{feed_name}").select("id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            column = "text"
    else:
        docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(place[0]).alias("file"), F.col(place[1]).alias("row"))
    docs = docs.select("id", "file", "row", F.col("text"), normalised(F.col("text")).alias("norm"))
    feed = docs.select(
        "id", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("sha"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), "file", "row", F.lit(content or column).alias("column"), F.lit(feed_name).alias("feed")
    )
    state.feed(feed)
    hits = stored(state.hits(), "hits")

    # full bytes on hits: this feed's, and of each digest the earlier row that stands for all before
    texts = join_checked(docs.select(digest(F.col("norm")).alias("digest"), "norm"), hits.select("digest"), "digest", "left_semi")
    if earlier:
        new = stored(feed.select("digest").distinct(), "new")
        before = state.rows().where(F.col("feed") != feed_name).groupBy("digest").agg(F.min(F.struct("file", "row", "column", "sha")).alias("p"))
        texts = texts.union(state.content(before.join(new, "digest", "left_semi").select("digest", "p.*")).select("digest", "norm"))
    clashes = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    clashes = stored(clashes.union(state.clashing()).distinct(), "clashes")
    rows = state.rows()
    best = hits
    if not clashes.isEmpty():
        clashes.write.mode("append").parquet(f"{state.folder}/clashes")
        rows, best = _by_text(state, hits, clashes)
    out = join_checked(rows, best, "digest", "left")
    first = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return out.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(first, F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "file",
        "row",
    )


def _by_text(state: DedupState, hits: DataFrame, clashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feed and the hits, with the digests that several texts share told apart by the texts themselves."""
    shared = state.content(join_checked(state.rows(), clashes, "digest", "left_semi"))
    groups = stored(shared.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("points")).alias("points"), "id", "file", "row")).alias("best")), "texts")
    # a group's name: its best row's place
    name = F.concat_ws("|", F.lit("text"), F.col("best.file"), F.col("best.row").cast("string"))
    named = stored(shared.join(groups.select("digest", "norm", name.alias("name")), ["digest", "norm"]).select("file", "row", "name"), "named")
    rows = state.rows().join(named, ["file", "row"], "left").withColumn("digest", F.coalesce("name", "digest")).drop("name")
    best = hits.join(clashes, "digest", "left_anti").unionByName(groups.select(name.alias("digest"), "n", "best"))
    return stored(rows, "rows"), stored(best, "best")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, all columns as they are."""
    names = [F.col(f"`{c}`") for c in df.columns]
    docs = located(df.select(F.struct(*names).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    gone = stored(exact_dedup(docs, "id", "text", place=("file", "row"), content=f"`{text_col}`").where("not kept").select("file", "row"), "gone")
    return join_checked(docs, gone, ["file", "row"], "left_anti").select("doc.*")
