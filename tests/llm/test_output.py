"""Token files, resampling and hard negatives, against libraries and plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import hard_negatives, resampling, token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_files.DEFAULT_FILE))


def odd_texts(n=1500, seed=7):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\ufeff", "\u200b", "don't", "'s", "x", "Ünïcode", "日本語", "🙂", "12345", "...", "<|endoftext|>", "a b", "é", "word", "_", "#"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_units_give_the_librarys_ids(library, monkeypatch):
    texts = odd_texts()
    texts += ["word " * 5000 + "  end", "\n \n" * 4000, "x" * 3000 + " y" * 3000, "a  <|endoftext|>  b" * 300]
    monkeypatch.setattr(token_files, "MEMO_CHARS", 4000)
    monkeypatch.setattr(token_files, "STEP_CHARS", 700)
    encode = token_files.Encoder(public_tokenizers.path(token_files.DEFAULT_FILE), 2).encode
    for t in texts:
        assert np.frombuffer(b"".join(encode(t)), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def plain_tokens(rows, library):
    """In the order of ids, null first; rows that share an id may stand in any order."""
    return {i: [library.encode(t or "", add_special_tokens=False).ids + [2] for j, t in rows if j == i] for i, _ in rows}


@pytest.mark.parametrize("width", [2, 4])
def test_token_files(odd, some, spark, library, width):
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id"), (-5, "below")], "doc_id long, text string"))
    for source, parts in ((table, 1), (table.repartition(5), 5), (some.select("doc_id", "text"), 3)):
        rows = [(r.doc_id, r.text) for r in source.collect()]
        folder = token_files.write_tokens(source.repartition(parts), width=width)
        got = sorted(token_files.read_tokens(spark, folder, ("ids", "ids_crc32")).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        want = plain_tokens(rows, library)
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            want[r.doc_id].remove(r.ids)
            at += r.n_tokens
        assert not any(want.values())


def test_token_files_same_from_any_partitions(odd, spark):
    """Rows that share an id stand in the order of their texts' hashes."""
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(5, "other text"), (5, "third text")], "doc_id long, text string"))
    read = lambda t: Counter(map(tuple, token_files.read_tokens(spark, token_files.write_tokens(t), ("ids_crc32",)).collect()))
    assert read(table.repartition(1)) == read(table.repartition(6))


def test_token_files_empty_table(empty, spark):
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0


def test_long_runs_of_documents(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "READ_IDS", 10)
    monkeypatch.setattr(token_files, "RUN_DOCS", 7)
    table = spark.createDataFrame([(i, "a b c d " * (i % 5)) for i in range(40)], "doc_id long, text string")
    got = token_files.read_tokens(spark, token_files.write_tokens(table, end_id=None)).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode("a b c d " * (i % 5), add_special_tokens=False).ids for i in range(40)}


GRAM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = GRAM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain_resample(rows, target, percent=5, least=20):
    counts = [Counter(), Counter()]
    for side, texts in zip(counts, ([t for _, t in rows], target)):
        for t in texts:
            for c, n in plain_features(t)[1].items():
                side[c % 10000] += n
    s_all, t_all = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][k] + 1.0) * (s_all + 10000.0) / ((counts[0][k] + 1.0) * (t_all + 10000.0)))) for k in range(10000)]
    out = []
    for i, t in rows:
        words, grams = plain_features(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % 10000] * n for c, n in grams.items())
        out.append((i, words, sum(grams.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, [r[0] for r in fit[: len(fit) * percent // 100]]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample(odd, some, spark, percent):
    target = spark.createDataFrame([("alpha beta gamma delta",), (None,), ("word word",), ("",)], "text string")
    for table in (odd.unionByName(spark.createDataFrame([(None, "a b " * 30, "en", "a", "f", 1)], odd.schema)), some):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        want, drawn = plain_resample(rows, [r.text for r in target.collect()], percent)
        got = resampling.resample(table.repartition(3), target, percent=percent).collect()
        assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
        assert [r.doc_id for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
        assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))


def test_resample_empty(odd, empty, spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(odd, target).count() == odd.count()


def test_features_of_long_words():
    """A long word beside short ones; starts that outlive the others; texts that meet without a space."""
    rng = random.Random(3)
    texts = ["a" * 50_000 + " b c", "x", "", "y", "é" * 700, "Z z " * 400, " ".join("w" * rng.randrange(1, 900) for _ in range(60)), "tail" * 3000]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    words, text, crc = resampling.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        n, grams = plain_features(t)
        assert words[k] == n and Counter(crc[text == k].tolist()) == grams


def plain_negatives(rows, positives=5, negatives=10, every=100):
    seen = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            seen[i, label, tuple(math.floor(256 * x) for x in v)] = True
    size = max((len(v) for *_, v in seen), default=0)
    seen = [(i, c, v + (0,) * (size - len(v))) for i, c, v in seen]
    out = Counter()
    for i, c, v in sorted(set(seen)):
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in set(seen) if j != i]
            for s, p, _ in sorted(x for x in scored if x[2] == c)[:positives]:
                fits = sorted(x for x in scored if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s)
                for rank, (t, j, _) in enumerate(fits[:negatives], 1):
                    out[i, p, rank, j, -s, -t] += 1
    return out


def vectors(n, size, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(6, size))
    return [(int(i), int(rng.integers(0, 4)), [float(x) for x in (at[rng.integers(0, 6)] + rng.normal(size=size) * spread)]) for i in range(n)]


def odd_vectors():
    rows = vectors(300, 5, 1)
    rows += [(400 + i, i % 3, [0.5, 0.25, 0.0, -0.5, 1.0]) for i in range(150)]  # copies under several labels
    rows += rows[:20] + [(100, 2, rows[7][2]), (None, 1, rows[0][2]), (701, None, rows[0][2]), (702, 1, None), (703, 1, []), (704, 1, [1.0, None]), (705, 1, [float("nan")] * 5), (706, 1, [float("inf")] * 5), (800, 1, [0.3, -0.2])]
    rows += [(900, 7, [0.1, 0.2, 0.1, 0.0, 0.0]), (1000, 1, [0.0] * 5)]
    return rows


@pytest.mark.parametrize("args", [{}, {"block": 16, "pivots": 5}, {"sample": 3, "pivots": 2, "block": 40}])
def test_hard_negatives(spark, args):
    rows = odd_vectors()
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit("x")).withColumn("dist", F.lit(1))
    got = hard_negatives.hard_negatives(table.repartition(4), F.col("id") % 100 == 0, **args)
    want = plain_negatives([(r.vec_id, r.label, r.embedding) for r in table.collect()])
    assert Counter(map(tuple, got.collect())) == want and want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_small_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(100, 1, [1.0, 2.0])], [(100, 1, [1.0]), (101, 1, [1.0])], [(100, 1, [1.0]), (7, 2, [0.5])], [(3, 1, [1.0]), (4, 2, [1.0])]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, kind), F.col("id") % 100 == 0).count() == 0
