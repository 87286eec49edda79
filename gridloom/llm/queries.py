"""The numbered corpus queries, each a thin digest over its operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as quality
from . import exact_dedup, hard_negatives, html_extract, language_id, line_dedup, minhash_dedup, mixing, resampling, sentencepiece_codec, suffix_dedup, token_counts, token_files
from ._common import read_table, stored


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", F.col("text").alias("kept_text"), "line_dedup.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.main_text(pages).select("page_id", "url", "text", "n_chars")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return sentencepiece_codec.piece_codec(docs, outputs=wanted).select("doc_id", *wanted)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(stored(docs, "sizes"), size_col="words")
    return mixed.select("doc_id", *(F.col(f"mix.{k}") for k in ("size", "source_size", "target", "taken")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, shingle=4, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    net = language_id.fit(docs.where(~apart).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", apart.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", "quality_rules.*")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return suffix_dedup.repeated_spans(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_tokens(spark, token_files.write_tokens(docs), outputs=("ids_crc32",))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, read_table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_mixing takes its blocks by, for SQL: sizes and targets."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9_quality_rules, for SQL."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_html_extract, op4_exact_dedup, op5_sentencepiece, op6_mixing, op7_minhash_dedup, op8_language_id, op9_quality_rules, op10_suffix_dedup, op11_token_files, op12_resampling, op13_hard_negatives, mixing_targets, quality_base)}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT *, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS hs FROM l),
e AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR ((CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) * 1000003 + hs[i]) % 2147483647 % 4 = 0) AS ends FROM h),
c AS (SELECT doc_id, ls, unnest(list_transform(range(1, len(ends) + 1), lambda k: {'k': k, 'lo': CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END, 'hi': ends[k]})) AS c FROM e),
t AS (SELECT doc_id, c.k AS k, c.hi - c.lo AS n, array_to_string(ls[c.lo + 1:c.hi], chr(10)) AS txt FROM c),
m AS (SELECT *, n > 1 AND regexp_matches(txt, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY txt ORDER BY doc_id, k) > 1 AS gone FROM t),
g AS (SELECT doc_id, string_agg(txt, chr(10) ORDER BY k) FILTER (NOT gone) AS kept_text, sum(n) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(n) FILTER (gone), 0) AS n_removed_lines FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept_text, '') END AS kept_text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(n_removed_chunks, 0) AS BIGINT) AS n_removed_chunks, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
""",
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(txt) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
r AS (SELECT min(doc_id) AS rep, sh, any_value(n) AS n FROM c WHERE n > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM r),
k AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN k USING (x)),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM f a JOIN f b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT rep AS a, rep AS b FROM r UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
m AS (SELECT a, min(b) AS comp FROM t GROUP BY a)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, coalesce(m.comp, c.doc_id) AS component_id, coalesce(m.comp, c.doc_id) = c.doc_id AS kept
FROM c LEFT JOIN r ON c.n > 0 AND c.sh = r.sh LEFT JOIN m ON m.a = r.rep
""",
    "mixing_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, 3 * ss AS room, sum(ss) OVER () AS total FROM s),
w AS (SELECT *, CAST([5, 2, 1][k % 3 + 1] AS DOUBLE) AS weight FROM p),
o AS (SELECT *, total - coalesce(sum(room) OVER (ORDER BY room / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY room / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
f AS (SELECT *, room * open <= rest * weight AS full_ FROM o),
t AS (SELECT source, ss, CASE WHEN full_ THEN room ELSE (total - coalesce(sum(room) FILTER (full_) OVER (), 0)) * weight / sum(weight) FILTER (NOT full_) OVER () END AS target FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS twice FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM g WHERE twice) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id)
""",
    "op13_hard_negatives": r"""
WITH e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
""",
    "op12_resampling": r"""
WITH b AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
df AS MATERIALIZED (SELECT r, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS f FROM d),
qf AS MATERIALIZED (SELECT unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS f FROM q),
u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM qf)),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))), lambda s, x: xor(b.t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) % 10000 AS k FROM u, b),
s AS (SELECT k, count(*) AS s FROM df JOIN c USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM qf JOIN c USING (f) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM qf) AS t_all),
g AS (SELECT r.range AS k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM range(10000) r CROSS JOIN n LEFT JOIN s ON s.k = r.range LEFT JOIN t ON t.k = r.range),
w AS (SELECT r, count(*) AS n_features, sum(gain) AS weight FROM df JOIN c USING (f) JOIN g USING (k) GROUP BY r),
z AS (SELECT d.r, doc_id, len(d.w) >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
x AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (fit) OVER () * 5 // 100 AS most FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= most THEN place END AS rank FROM x
""",
}
