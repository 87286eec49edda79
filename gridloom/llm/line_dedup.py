"""Removal of repeated multi-line chunks, in DataFrame operations alone.

A text's lines are hashed; a rolling polynomial over the last WINDOW line hashes ends a chunk wherever it is 0 modulo
DIVISOR, so boundaries depend on nearby lines only and come back after an insertion. Chunks of two lines or more that
hold a word and whose hash occurs twice are candidates. Candidates are grouped by hash and bytes (pre-aggregated, so a
chunk that a third of all documents hold sends one row per task); of equal chunks the first by id, place of the
row and position stays and the others go. Lines are joined by \\n again.

Edge cases: a null text stays null, an empty one has one empty line; chunks of blank lines stay; a document may become
empty but no row goes; of repeated rows the first keeps its chunks; other columns are kept (one that bears the result's
own name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_checked, located, stored

WINDOW, DIVISOR = 2, 4
_BASE, _PRIME = 1_000_003, 2_147_483_647


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _ends(hashes: Column, window: int, divisor: int) -> Column:
    """1-based numbers of the lines that end a chunk."""

    def ends(i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            line = F.coalesce(F.get(hashes, i - 1 - back), F.lit(0)) if back else F.get(hashes, i - 1)
            rolled = (rolled * _BASE + line) % _PRIME
        return (i == F.size(hashes)) | (rolled % divisor == 0)

    return F.filter(F.sequence(F.lit(1), F.size(hashes)), ends)


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of (k, n, chunk): number, lines and text of each chunk."""
    line_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")

    def cut(lines: Column) -> Column:
        before = lambda ends, k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        piece = lambda ends: F.transform(
            ends, lambda e, k: F.struct(k.alias("k"), (e - before(ends, k)).alias("n"), F.array_join(F.slice(lines, before(ends, k) + 1, e - before(ends, k)), "\n").alias("chunk"))
        )
        return _bind(_bind(F.transform(lines, line_hash), lambda h: _ends(h, window, divisor)), piece)

    return _bind(F.split(text, "\n", -1), cut)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = "line_dedup", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """The input with its text less the repeated chunks, and a struct `result`: n_lines, n_chunks, n_removed_chunks,
    n_removed_lines."""
    df = df.drop(result)
    names = [F.col(f"`{c}`") for c in df.columns]
    docs = located(df.select(F.struct(*names).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    cut = chunks(F.col("text"), window, divisor)
    repeatable = F.filter(cut, lambda c: (c["n"] > 1) & c["chunk"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("id", "file", "row", F.explode(repeatable).alias("c")).select("id", "file", "row", "c.k", "c.chunk", F.xxhash64("c.chunk").alias("h"))
    twice = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "twice")
    candidates = stored(join_checked(rows, twice, "h", "left_semi"), "candidates")
    first = candidates.groupBy("h", "chunk").agg(F.min(F.struct("id", "file", "row", "k")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = stored(first.select("h", "chunk", "first"), "first")
    later = join_checked(candidates, first, ["h", "chunk"], "inner").where(F.struct("id", "file", "row", "k") != F.col("first"))
    gone = stored(later.groupBy("file", "row").agg(F.collect_list("k").alias("gone")), "gone")

    out = join_checked(docs.select("doc", "file", "row"), gone, ["file", "row"], "left").select("doc", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    text = F.col("doc").getField(text_col)

    def outcome(c: Column) -> Column:
        # one difference of the numbers, not a search for each chunk
        numbers = F.array_except(F.transform(c, lambda x: x["k"]), F.col("gone"))
        stays = F.when(F.size("gone") == 0, c).otherwise(F.transform(numbers, lambda k: F.get(c, k)))
        lines = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x["n"]), F.lit(0))
        return F.struct(
            F.when(text.isNotNull(), F.array_join(F.transform(stays, lambda x: x["chunk"]), "\n")).alias("text"),
            F.struct(
                lines(c).alias("n_lines"),
                F.coalesce(F.size(c), F.lit(0)).cast("long").alias("n_chunks"),
                F.size("gone").cast("long").alias("n_removed_chunks"),
                (lines(c) - lines(stays)).alias("n_removed_lines"),
            ).alias("figures"),
        )

    none = F.array().cast("array<struct<k:int,n:int,chunk:string>>")
    done = out.select("doc", _bind(F.coalesce(chunks(text, window, divisor), none), outcome).alias("o"))
    columns = [F.col("o.text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in df.columns]
    return done.select(*columns, F.col("o.figures").alias(result))
