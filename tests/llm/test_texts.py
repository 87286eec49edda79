"""Operators that read each text by itself, against libraries and plain versions."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import html_extract, language_id, mixing, quality_rules, sentencepiece_codec, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_counts(odd, some, empty):
    for table in (odd, some):
        for r in quality_rules.quality_rules(table).collect():
            q = r.quality_rules
            want = plain_quality(r.text)
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
            assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (q.base_failed and q.kept)
    assert quality_rules.quality_rules(odd).count() == odd.count() and quality_rules.quality_rules(empty).count() == 0


def test_quality_verdict_by_brute_force():
    """Coverage by later occurrences of n-grams, recounted with dictionaries."""
    import pyarrow as pa

    from gridloom.llm._common import text_slices

    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base), " ".join(base + base[:8]), " ".join(base + base[:30]), " ".join(base) + "\n" + " ".join(base[:40]) + "\n" + " ".join(base[:40])]
    for lo, hi, data, offsets in text_slices(pa.array(texts)):
        got = quality_rules.measure(data, offsets)
    for k, text in enumerate(texts):
        words = text.split()
        chars = sum(map(len, words))
        worst = 0.0
        for n, limit in quality_rules.NGRAM_LIMITS.items():
            seen, cover = set(), set()
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                if g in seen:
                    cover.update(range(i, i + n))
                seen.add(g)
            worst = max(worst, sum(len(words[i]) for i in cover) / chars / limit)
        assert abs(got["max_ngram_excess"][k] - worst) < 1e-9
    assert got["kept"].tolist() == [True, True, False, False]


def test_token_counts(odd, some, empty):
    lib = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.DEFAULT_FILE))
    for table in (odd, some):
        for r in token_counts.token_counts(table).collect():
            want = len(lib.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 1024)
    assert token_counts.token_counts(empty).count() == 0


def test_sentencepiece(odd, some, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(sentencepiece_codec.DEFAULT_FILE))
    wanted = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    for table in (odd, some):
        for r in sentencepiece_codec.piece_codec(table, outputs=wanted).collect():
            ids = lib.encode(r.text or "")
            text = lib.decode(ids)
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    tool = sentencepiece_codec.codec(token_counts.tokenizer_path(sentencepiece_codec.DEFAULT_FILE))
    assert tool.decode(tool.encode("a b  c")) == "a b  c"
    assert sentencepiece_codec.piece_codec(empty).count() == 0


def test_html(spark):
    page = lambda main, rest="": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div class='post-content'>{main}</div>{rest}<footer>f</footer></body></html>"
    long = "<div id='comments'><p>" + "a long comment by a reader, longer than the article itself. " * 9 + "</p></div>"
    rows = [
        (0, "http://a.example/1", page("<h1>Head &amp; more</h1><p>One   two<br>three<p>Four <b>five</b><script>x</script>")),
        (1, "http://www.a.example/2", page("<p>Short text here.</p>", long)),
        (2, "http://a.example/3", page("<p>Other text that is here.</p><ul><li>x<li>y</ul><div class='ad-box'>buy</div>")),
        (3, None, None),
        (4, "odd", ""),
        (5, "http://b.example/", "<p>no body &lt;tag&gt; <table><tr><td>c1<td>c2</table>"),
        (5, "http://b.example/", "<!-- only a comment"),
    ]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = ["Head & more\nOne two three\nFour five", "Short text here.", "Other text that is here.\nx\ny", "", "", "no body <tag>\nc1\nc2", ""]
    assert sorted(got) == sorted((r[0], t, len(t)) for r, t in zip(rows, want))
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string, n_chars int")).count() == 0


def test_html_whole_articles(spark):
    """Short parts of an article stay beside long ones, with and without the host's vote."""
    t = lambda word, n: " ".join([word] * n)
    pages = [
        (f"<body><nav>n</nav><article><section><p>{t('long', 200)}</p></section><section><p>{t('short', 20)}</p></section></article></body>", [t("long", 200), t("short", 20)]),
        (f"<body><article><h1>Title</h1><p>Lead.</p><div class='post-content'><p>{t('body', 200)}</p></div></article></body>", ["Title", "Lead.", t("body", 200)]),
        (f"<body><div><article><p>{t('one', 100)}</p></article><article><p>{t('two', 10)}</p></article></div></body>", [t("one", 100), t("two", 10)]),
    ]
    rows = [(k, f"http://{k if apart else 'h'}.example/{k}", page) for apart in (True, False) for k, (page, _) in enumerate(pages)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r.text == "\n".join(pages[r.page_id][1]) for r in got)


def test_html_articles(spark, sf_dir):
    """On the small table the article's own blocks come out."""
    import html as h

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_extract.main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_language(odd, empty, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = language_id.held_out(F.col("doc_id"))
    net = language_id.fit(docs.where(~apart), sample=100)
    out = language_id.predict(docs.where(apart), net).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    got = {(r.doc_id, r.text): r for r in language_id.predict(odd, net).collect()}
    assert {k[0] for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert language_id.predict(empty, net).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weight[s] / open_ for s in order}
        more = {s for s in order if s not in full and out[s] > cap * sizes[s]}
        if not more:
            return out
        full |= more


def test_mixing(odd, some, empty):
    for table in (odd, some):
        rows = mixing.mix_sources(table).collect()
        assert len(rows) == table.count()
        sizes, taken = Counter(), Counter()
        for r in rows:
            n = len(WORD.findall(r.text or ""))
            assert r.mix.size == n and 0 <= r.mix.taken <= 3 * n
            sizes[r.source] += n
            taken[r.source] += r.mix.taken
        want = plain_targets(sizes)
        for r in rows:
            assert abs(r.mix.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.mix.source_size == sizes[r.source]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
        again = mixing.mix_sources(table.repartition(7)).collect()
        assert Counter((r.doc_id, r.mix.taken) for r in again) == Counter((r.doc_id, r.mix.taken) for r in rows)
        texts = mixing.mixed_texts(mixing.mix_sources(table))
        assert texts.columns == table.columns
        assert {s: n for s, n in Counter({s: sum(len(WORD.findall(r.text)) for r in texts.where(F.col("source").eqNullSafe(s)).collect()) for s in sizes}).items()} == dict(taken)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_small_sources_by_large_blocks(spark):
    """Sources far under a block of words meet their targets too, at the cap and below it."""
    sizes = {"a": 40, "b": 42, "c": 100, "d": 200, "e": 600, "f": 800, "g": 1000, "h": 30_000, "i": 9000}
    rows = [(100 * k + d, s, n // 4 if d < 3 else n - 3 * (n // 4)) for k, (s, n) in enumerate(sizes.items()) for d in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, source string, words long").withColumn("text", F.expr("repeat('w ', int(words))"))
    mixed = mixing.mix_sources(table, block_words=256)
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("mix.taken").alias("n")).collect()}
    want = plain_targets(sizes)
    assert sum(want[s] == 3 * sizes[s] for s in sizes) >= 7
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    words = {r.source: r.n for r in mixing.mixed_texts(mixed).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == taken


def test_apportionment(spark):
    import itertools

    votes = [5300, 2400, 1200, 600, 500, 1, 0]
    for seats in (0, 1, 7, 100, 1001):
        items = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g int, i int, votes double, seats long")
        got = {r.i: r.quota for r in mixing.apportion(items, ["g"], ["i"], "votes", "seats").collect()}
        best = sorted(((-v / (2 * k + 1), i, k) for (i, v), k in itertools.product(enumerate(votes), range(seats)) if v), key=lambda x: x)[:seats]
        want = Counter(i for _, i, _ in best)
        assert got == {i: want[i] for i in range(len(votes))}


def test_language_tables_equal_convolution():
    """The tables over byte pairs give what the plain convolution gives."""
    import numpy as np

    net = language_id.ByteNet(["a", "b", "c"]).ready()
    x = np.random.default_rng(1).integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(net.pooled(x), net._features(x)[0], atol=1e-5)


def test_language_repeated_and_missing_ids(spark):
    """Ids that many rows share, or none has, change neither what is learned nor how well."""
    from itertools import product

    rows = [(0 if shared else None, f"the {a} and the {b} were here {k}", "en") for k, (a, b) in enumerate(product("house tree river cat dog".split(), repeat=2)) for shared in (True, False)]
    rows += [(k, f"der {a} und die {b} waren da {k}", "de") for k, (a, b) in enumerate(product("Haus Baum Fluss Katze Hund".split(), repeat=2))]
    rows += [(99, "12345", "xx"), (100, None, "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(table, sample=20)
    assert net.languages == ["de", "en"]
    got = language_id.predict(table, net).collect()
    assert all(r.lang_pred == r.lang for r in got if r.lang in ("en", "de") and r.text)
    assert {r.lang_pred for r in got if r.doc_id in (99, 100)} == {"und"}


def test_html_broken_tags(spark):
    """Quotes and tags that never end, long values, deep nesting: right and in time in proportion to the page."""
    import time

    start = time.time()
    assert html_extract.extract("<p>one</p>" + '<a "' * 200_000, None).startswith("one")
    assert html_extract.extract("<p>one</p>" + '<a "' * 100_000 + "></a><p>two", None).endswith("two")
    assert html_extract.extract("<div>" * 20_000 + "deep", None) == "deep"
    assert time.time() - start < 30
    value = "x > y " * 500
    assert html_extract.extract(f"<div title=\"{value}\" class='post'>text</div>", None) == "text"
    assert html_extract.extract("<p>a < b and <b>c</b> <3", None) == "a < b and c <3"


def test_html_votes_without_a_common_path(spark):
    """A host whose paths all stay under the share has no winner: each page keeps its own."""
    rows = [(k, "http://h.example/", f"<body><div class='{chr(97 + k) * 3}'><p>text of page {k} here</p></div></body>") for k in range(26)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"text of page {r.page_id} here" for r in got) and len(got) == 26


def test_sources_without_words(spark):
    rows = [(1, "w1 w2 w3 w4 w5", "a"), (2, "x y z", "b"), (3, "", "z"), (4, None, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.mix for r in mixing.mix_sources(table).collect()}
    assert [got[i].target for i in (3, 4)] == [0.0, 0.0] and [got[i].taken for i in (3, 4)] == [0, 0]
    assert sum(got[i].taken for i in (1, 2)) == 8
    assert sum(r.mix.taken for r in mixing.mix_sources(table.where("source = 'z'")).collect()) == 0
    assert mixing.mixed_texts(mixing.mix_sources(table.where("source = 'z'"))).count() == 0


def test_clashing_names(odd):
    """Columns under the names that operators use within themselves are kept."""
    extra = ["_letter", "_paths", "_host", "_text_mixed", "id", "row", "paths", "host", "_source", "h"]
    table = odd.select("doc_id", "text", "lang", "source", *(F.lit(k).alias(k) for k in extra))
    net = language_id.fit(table.select("doc_id", "text", "lang"))
    for out in (
        language_id.predict(table, net),
        html_extract.main_text(table.withColumnsRenamed({"text": "html", "source": "url"})),
        mixing.mixed_texts(mixing.mix_sources(table)),
    ):
        rows = out.collect()
        assert rows and all(r[k] == k for r in rows for k in extra)


@pytest.mark.parametrize("limit", ["64m", "4MB", "2097152", "100kb"])
def test_arrow_limit_as_text(spark, odd, limit):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, limit)
        assert quality_rules.quality_rules(odd).count() == odd.count()
    finally:
        spark.conf.set(key, before)


def test_held_out_without_id(spark):
    table = spark.createDataFrame([(None,), (3,)], "doc_id long")
    assert all(r.h is not None for r in table.select(language_id.held_out(F.col("doc_id")).alias("h")).collect())


@pytest.mark.parametrize(
    "html, want",
    [
        ('<body><form id="aspnetForm"><div class="content"><p>Text of the page.</p></div></form></body>', "Text of the page."),
        ('<div class="layout-sidebar"><article><p>The article here.</p></article></div>', "The article here."),
        ('<article><div class="post-header"><h1>Title</h1><span>by me</span></div><p>Body of the post.</p></article>', "Title\nBody of the post."),
        ('<article><h2 class="section-header">Head</h2><p>Body of the post.</p></article>', "Head\nBody of the post."),
        ('<article><p>Long enough to be most of the page.</p></article><div class="sidebar"><p>aside</p></div><form><p>search</p></form>', "Long enough to be most of the page."),
        ('<article><p>Short body.</p></article><section class="comments"><p>A comment of a reader that is longer than all of the article by itself.</p></section>', "Short body."),
        ('<article><p>Short body.</p></article><div class="cookie-notice"><p>A notice that is longer than all of the article by itself, as they are.</p></div>', "Short body."),
    ],
)
def test_html_wrappers(html, want):
    """Words of layouts don't take what holds most of the text; comments and notices go whatever their length."""
    assert html_extract.extract(html, None) == want


def test_html_wrapped_pages(spark):
    """The main text of every small page is the same in a page-wide form or under a layout's class."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html and "<body" in r.html]
    for html in pages:
        plain = html_extract.extract(html, None)
        for start, end in (('<form id="f">', "</form>"), ('<div class="layout-sidebar">', "</div>")):
            wrapped = re.sub(r"(<body[^>]*>)(.*)(</body>)", lambda m: m[1] + start + m[2] + end + m[3], html, flags=re.S)
            assert html_extract.extract(wrapped, None) == plain


@pytest.mark.parametrize(
    "html",
    ["<b>" * 200_000 + "</i>" * 200_000, "<div><p>t</p></div><nav><b>" * 20_000, "<b>" * 100_000 + "</p>" * 100_000, "<script>" + "</script " * 100_000, "<p>x" * 100_000, "<table><tr><td>" * 20_000 + "</b>" * 50_000, "<form>" * 50_000 + "x"],
)
def test_html_in_time(html):
    import time

    began = time.process_time()
    html_extract.extract(html, None)
    assert time.process_time() - began < 5
