"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations alone.

Sources share the size of all documents by weight; a target stops at `cap` times its source's size and the excess is
shared anew by weight (solved in one step: in the order of cap * size / weight the capped sources come first). The words
of the mix go to sources by the highest quotients target / (2k + 1) (a capped source has its words already), and each
source's words to its shards (documents dealt by a seeded hash; their number follows one rule of the source's words at
every size) by size / (2k + 1): integer quotas. A shard's documents stand in a seeded order on a line of words that is
cut into blocks of equally many words, at least one word each. A quota of q over a shard of w words takes the whole shard
q div w times and the nearest number of blocks to q mod w once more, spread evenly from a seeded phase, so a document's
share is a closed formula.

Edge cases: a null or empty text has size 0 and nothing is taken; a source without words has target 0; null is a source of its own, last in order; ties in
the order fall to smaller ids; repeated rows lie side by side and are interchangeable; an empty table gives an empty
result. Other columns are kept (one that bears the result's own name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_CLASS, join_checked, stored

WEIGHTS = (5, 2, 1)
CAP = 3
#: A source of n words has sqrt(n) / SHARD_ROOT shards (one at least), so both their number and their size grow with the
#: root of its words, and a shard has about BLOCKS blocks.
SHARD_ROOT, BLOCKS = 4, 1 << 10
SEED = 20240607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size), one row per source -> with position, weight and target."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, [float(w) for w in weights]))
    ranked = sizes.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", F.element_at(cycle, F.col("position") % len(weights) + 1))
    room = cap * F.col("source_size")
    by_room = Window.orderBy(room / F.col("weight"), "position")
    below = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(room).over(below), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", room * F.col("open") <= F.col("left") * F.col("weight"))
    )
    every = Window.partitionBy()
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), room)).over(every), F.lit(0.0))
    shared = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return ranked.withColumn("target", F.when(F.col("full"), room.cast("double")).otherwise(rest * F.col("weight") / shared)).drop("left", "open", "full", "total")


def apportion(items: DataFrame, groups: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: each group's `seats` among its items by the highest quotients votes / (2k + 1); adds quota.

    Only contested seats are listed. With n items a final divisor lies within n / 2 seats of the group's own, so an
    item's seats lie within 1 + n / 2 * its share of its exact part: about four quotients per item in all."""
    whole = Window.partitionBy(*groups)
    shown = (
        items.withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_share", F.coalesce(F.try_divide(F.col(votes).cast("double"), F.sum(votes).over(whole)), F.lit(0.0)))
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("_share") - F.col("_n") / 2 * F.col("_share") - 1)).cast("long"))
        .withColumn("_high", F.ceil(F.col(seats) * F.col("_share") + F.col("_n") / 2 * F.col("_share") + 1).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    contested = shown.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    best = Window.partitionBy(*groups).orderBy(F.desc("_q"), *key, "_k")
    won = contested.withColumn("_rank", F.row_number().over(best)).where("_rank <= _open").groupBy(*groups, *key).agg(F.count(F.lit(1)).alias("_won"))
    return shown.join(won, [*groups, *key], "left").withColumn("quota", (F.when(F.col(votes) > 0, F.col("_low")).otherwise(0) + F.coalesce("_won", F.lit(0))).cast("long")).drop("_n", "_share", "_low", "_high", "_open", "_won")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    result: str = "mix",
    weights: tuple[float, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    block_words: int | None = None,
    shards: int | None = None,
) -> DataFrame:
    """The input with a struct `result` (block_words, if given, bounds a block from above, and shards sets their number for every source): size, source_size, target, taken, copies (times the whole document is taken)
    and start, block, extra, blocks, phase (which further words are: see taken_again)."""
    df = df.drop(result)
    size = F.col(size_col) if size_col else word_count(F.col(text_col))
    sums = stored(df.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size")), "sources")
    total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    parts = F.greatest(F.lit(1), F.lit(shards) if shards else F.ceil(F.sqrt("source_size") / SHARD_ROOT)).cast("long")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / (F.col("_shards") * BLOCKS)))).cast("long")
    room = F.col("source_size") * cap
    full = F.col("target") >= room
    sources = targets(sums, weights, cap).withColumn("_shards", parts).withColumn("_block", block).withColumn("_votes", F.when(full, 0.0).otherwise(F.col("target"))).withColumn("_all", F.lit(0))
    sources = sources.withColumn("_seats", (F.lit(total) - F.coalesce(F.sum(F.when(full, room)).over(Window.partitionBy("_all")), F.lit(0))).cast("long"))
    sources = apportion(sources, ["_all"], ["position"], "_votes", "_seats").withColumn("quota", F.when(full, room).otherwise(F.col("quota")).cast("long"))
    sources = stored(sources.drop("_all", "_seats", "_votes"), "targets")

    doc = df.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"))
    known = sources.select("source", "position", "source_size", "target", "_shards")
    doc = join_checked(doc, known, F.col("_source").eqNullSafe(F.col("source")), "left")
    doc = doc.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"))).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.col("_shards")))

    lines = doc.groupBy("position", "_shard").agg(F.sum("_size").alias("_words"))
    quotas = sources.select("position", "_block", F.col("quota").alias("_seats"))
    # a source's seats are at most cap times its words, and so then are a shard's
    lines = apportion(join_checked(lines, quotas, "position", "inner"), ["position"], ["_shard"], "_words", "_seats")
    lines = (
        lines.withColumn("_blocks", F.ceil(F.col("_words") / F.col("_block")).cast("long"))
        .withColumn("_copies", F.when(F.col("_words") > 0, F.expr("quota div _words")).otherwise(0))
        .withColumn("_extra", F.least("_blocks", F.round((F.col("quota") - F.col("_copies") * F.col("_words")) / F.col("_block")).cast("long")))
        .withColumn("_phase", F.when(F.col("_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "position", "_shard"), F.greatest("_blocks", F.lit(1)))).otherwise(0))
        .select("position", "_shard", "_block", "_blocks", "_copies", "_extra", "_phase")
    )
    lines = stored(lines, "quotas")
    doc = join_checked(doc, lines, ["position", "_shard"], "left")
    line = Window.partitionBy("position", "_shard").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    doc = doc.withColumn("_end", F.sum("_size").over(line)).withColumn("_start", F.col("_end") - F.col("_size"))

    def taken_before(x: Column) -> Column:
        block = F.col("_block")
        full = F.floor(x / block).cast("long")
        seats = lambda k: F.when(F.col("_blocks") > 0, F.floor((k + F.col("_phase")) * F.col("_extra") / F.col("_blocks"))).otherwise(0).cast("long")
        return (seats(full) - seats(F.lit(0))) * block + (seats(full + 1) - seats(full)) * (x - full * block)

    again = taken_before(F.col("_end")) - taken_before(F.col("_start"))
    mix = F.struct(
        F.col("_size").alias("size"),
        F.col("source_size"),
        F.col("target"),
        (F.col("_copies") * F.col("_size") + again).cast("long").alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_start").alias("start"),
        F.col("_block").alias("block"),
        F.col("_extra").alias("extra"),
        F.col("_blocks").alias("blocks"),
        F.col("_phase").alias("phase"),
    )
    return doc.select("_doc.*", mix.alias(result))


def mixed_texts(df: DataFrame, text_col: str = "text", result: str = "mix") -> DataFrame:
    """The mix itself: each row `copies` times whole and, where blocks cut it, once more with just their words (each
    with the white space that follows it). Columns as before the mixing."""
    columns = [c for c in df.columns if c != result]
    words = F.expr(f"regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)")
    seat = lambda k: F.floor((k + F.col(f"{result}.phase")) * F.col(f"{result}.extra") / F.col(f"{result}.blocks"))
    block_of = lambda i: F.floor((F.col(f"{result}.start") + i) / F.col(f"{result}.block"))
    part = F.array_join(F.filter(words, lambda _, i: seat(block_of(i) + 1) > seat(block_of(i))), "")
    part = F.when(F.col(f"{result}.taken") > F.col(f"{result}.copies") * F.col(f"{result}.size"), part)
    whole = F.array_repeat(F.col(text_col), F.col(f"{result}.copies").cast("int"))
    texts = F.when(F.col(f"{result}.size") > 0, F.concat(whole, F.array_compact(F.array(part)))).otherwise(F.array().cast("array<string>"))
    out = df.select(F.struct(*columns).alias("row"), F.explode(texts).alias("text"))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns))
