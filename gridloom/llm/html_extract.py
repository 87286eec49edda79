"""Main-text extraction by consensus paths of a host.

Pass 1 takes each page's containers that hold nearly all of its text outside links and boilerplate: of these the
outermost article, or else the innermost one. It is named by its generalised path: tags with their class words, digits and long hashes left out. In Spark the pages of a host
vote on paths (counts are pre-aggregated by host and path, so a hot host sends few rows). Pass 2 extracts every page
again from the container on its host's winning paths; a page without such a container uses its own best one.

Edge cases: null, empty and text-less html give an empty text; a null or odd url counts as the host ''; unclosed and
misnested tags are repaired as browsers do for paragraphs, list items and cells; repeated rows are extracted each for
itself; other columns are kept (those that bear a result's name are replaced). Pages are read to their end. What a
class, an id or a role names as boilerplate goes only after all text is weighed: words that layouts give to wrappers
(a page-wide form, a "layout-sidebar") don't take what holds most of the page's text.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, join_checked, stored, text_slices, with_fields

#: Share of a host's votes with which a path wins; a host may have no such path, then each page keeps its own.
SHARE = 0.1
#: Share of a page's text that its container must hold.
NEARLY = 0.9

#: A tag whose quoted values are short; longer and broken ones are looked at by _Tokens.
_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]++|"[^"]{0,200}+"|'[^']{0,200}+'){0,40}+)>|<[!?/]|<[a-zA-Z]""", re.S)
_SPECIAL = re.compile("[\"'>]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")

# Element classes of HTML.
_RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body div main section td blockquote center form fieldset aside table ul ol dl".split())
_DROP_TAG = frozenset("head title nav aside footer button select option input label dialog menu map applet".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags that reach out of a table's cell.
_PAST_CELLS = frozenset("table tr tbody thead tfoot body html article main section div".split())
#: A start tag closes these open elements, up to one of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Names of what surrounds an article, as words of a class or id.
_AROUND = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs header masthead topbar footer foot colophon sidebar sidebars side aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner notice notices alert cookie cookies consent gdpr disclaimer popup modal overlay "
    "newsletter subscribe subscription signup login signin register form search share sharing social related recommended recommendations teaser teasers "
    "comment comments commentlist discussion disqus respond reply replies reviews pagination pager toolbar tags hidden skip print paywall".split()
)
#: Of these the ones that layouts also give to what holds the article; forms may hold a whole page.
_LAYOUT = frozenset("sidebar sidebars side rail header widget widgets form print paywall overlay topbar toolbar".split())
_ARTICLE = frozenset("article content main post entry story body text page hentry".split())
_AROUND_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_QUALIFIER = frozenset("with has no without is".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _around(tag: str, attrs: dict[str, str]) -> str:
    """The word by which an element's attributes name it as boilerplate, or nothing."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return "hidden"
    if (role := attrs.get("role", "").lower()) in _AROUND_ROLE:
        return role
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if not words or words[0] in _QUALIFIER:
            continue
        last = words[-1].rstrip("0123456789")
        if last == "header" and (tag in _HEADING or _ARTICLE & set(words)):
            continue  # a heading, or an article's own head
        if last in _AROUND:
            return last
        if words[0] in _AROUND and not _ARTICLE & set(words):
            return words[0]
    return ""


def _own_head(attrs: dict[str, str]) -> bool:
    """Whether a class calls an element the head of an article."""
    for name in attrs.get("class", "").split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if words and words[-1] == "header" and _ARTICLE & set(words):
            return True
    return False


def _generalised(tag: str, attrs: dict[str, str]) -> str:
    words = set()
    for name in attrs.get("class", "").split():
        plain = re.sub(r"\d+", "", name.lower()).strip("-_")
        if plain and not re.fullmatch(r"[a-z]*", plain[:1]) is None and len(plain) < 30:
            words.add(plain)
    return ".".join([tag, *sorted(words)])


def _extended(key: int, step: str) -> int:
    """A path's key from its parent's: paths themselves would take a page's depth squared."""
    return hash((key, step))


class _Tokens:
    """Comments, tags and declarations of a page, in time in proportion to its length whatever it holds."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.last = html.rfind(">")
        self.last_cdata = html.rfind("]]>")
        self.dead: set[int] = set()  # places after a value from where no tag ends

    def _end_of_tag(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`: the first > outside quoted values; -1 without any."""
        seen = []
        while at not in self.dead:
            seen.append(at)
            m = _SPECIAL.search(self.html, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str | None, str, str, str] | None:
        """Start, end, slash and name of a tag (None where it is none), its attributes, and the text of CDATA."""
        html = self.html
        while m := _TOKEN.search(html, at):
            start, found = m.start(), m[0]
            if m[2] is not None:
                return start, m.end(), m[1], m[2], m[3], ""
            if found == "<!--":
                end = html.find("-->", m.end())
                return start, end + 3 if end >= 0 else self.size, None, "", "", ""
            if start > max(self.last, self.last_cdata):
                return None
            if found == "<![CDATA[" and start < self.last_cdata:
                end = html.find("]]>", m.end())
                return start, end + 3, None, "", "", html[m.end() : end]
            name = _NAME.match(html, start)
            end = self._end_of_tag(name.end()) if name else -1
            if end >= 0:
                return start, end + 1, name[1], name[2], html[name.end() : end], ""
            end = html.find(">", m.end()) if start < self.last else -1  # a broken tag ends at the next >
            if end >= 0:
                return start, end + 1, None, "", "", ""
            at = m.end()
        return None


class Page:
    """A page's blocks of text, each with its container, and its containers with their paths."""

    def __init__(self, html: str):
        self.parent, self.step, self.key, self.within, self.score = [-1], [""], [_extended(0, "")], [False], [0.0]
        self.around: dict[int, str] = {}  # containers that a word names as boilerplate
        self.blocks: list[tuple[int, str]] = []
        self._read(html)
        self._settle()

    def _sums(self, score: list[float]) -> list[float]:
        total = list(score)
        for n in range(len(total) - 1, 0, -1):  # containers follow their parents
            total[self.parent[n]] += total[n]
        return total

    def _settle(self) -> None:
        """Drop what is named as boilerplate, unless a layout's word names what holds most of the text outside the rest."""
        if not self.around:
            return
        size, gone = len(self.parent), [False] * len(self.parent)
        for n in range(1, size):
            gone[n] = gone[self.parent[n]] or n in self.around and self.around[n] not in _LAYOUT
        total = self._sums([0.0 if g else s for g, s in zip(gone, self.score)])
        for n in range(1, size):
            gone[n] = gone[n] or gone[self.parent[n]] or n in self.around and 2 * total[n] <= total[0]
        self.blocks = [(n, text) for n, text in self.blocks if not gone[n]]
        self.score = [0.0 if g else s for g, s in zip(gone, self.score)]

    def _read(self, html: str) -> None:
        # open elements: tag, container node, dropped?, link?, an article's own head?
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        places: dict[str, list[int]] = {}  # where each tag is open
        blocks: list[int] = []  # where blocks are open
        pieces: list[str] = []
        linked = 0
        at, size = 0, len(html)
        _, node, drop, link, _ = stack[-1]
        last = lambda *tags: max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close_block() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((node, text))
                    self.score[node] += max(0.0, len(text) - 2.0 * linked)
                pieces.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            nonlocal node, drop, link
            for tag, *_ in stack[depth:]:
                if tag in _BLOCK:
                    close_block()
                    break
            for tag, *_ in stack[depth:]:
                places[tag].pop()
            while blocks and blocks[-1] >= depth:
                blocks.pop()
            del stack[depth:]
            _, node, drop, link, _ = stack[-1]

        tokens = _Tokens(html)
        while at < size:
            m = tokens.next(at)
            end = m[0] if m else size
            if end > at and not drop:
                text = html[at:end]
                text = htmllib.unescape(text) if "&" in text else text
                pieces.append(text)
                if link:
                    linked += len(text)
            if not m:
                break
            _, at, slash, tag, rest, cdata = m
            if slash is None:
                if cdata and not drop:
                    pieces.append(cdata)
                continue
            tag = tag.lower()
            if slash:
                if tag == "br" or tag == "p" and not places.get("p"):
                    if tag == "p":
                        close_block()
                    continue
                depth = last(tag)
                cell = 0 if tag in _PAST_CELLS else last("td", "th", "table")  # other end tags don't reach out of a cell
                if depth and depth >= cell:
                    pop_to(depth)
                continue
            if tag in _RAW:
                if not rest.endswith("/"):
                    stop = re.compile(f"</{re.escape(tag)}\\b", re.I).search(html, at)
                    at = html.find(">", stop.end()) + 1 if stop else 0
                    at = at or size
                continue
            if tag == "br":
                if not drop:
                    pieces.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    close_block()
                continue
            if tag in _BLOCK:
                if tag in _CLOSES:
                    gone, bounds = _CLOSES[tag]
                    depth = last(*gone)
                    if depth > last(*bounds):
                        pop_to(depth)
                if blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
                    pop_to(blocks[-1])
                close_block()
            if rest.endswith("/") and tag not in _BLOCK:
                continue
            attrs = _attributes(rest) if rest else {}
            word = _around(tag, attrs) if attrs and tag not in ("html", "body") and not drop else ""
            word = word or ("form" if tag == "form" else "")
            soft = bool(word) and tag in _BLOCK and not drop
            inside = node
            if tag in _CONTAINER or soft:
                inside = len(self.parent)
                self.parent.append(node)
                step = _generalised(tag, attrs)
                self.step.append(step)
                self.key.append(_extended(self.key[node], step))
                first, *classes = step.split(".")
                self.within.append(self.within[node] or first in ("article", "main") or any(_ARTICLE & set(_CAMEL.split(c)) for c in classes))
                self.score.append(0.0)
                if soft:
                    self.around[inside] = word
            dropped = drop or tag in _DROP_TAG or bool(word) and not soft
            head = not dropped and (tag == "header" or tag in _BLOCK and tag not in _HEADING and _own_head(attrs))
            if head and tag == "header" and not self.within[node]:
                head, dropped = False, True
            if not drop and stack[-1][4] and tag not in _HEADING and tag not in ("div", "hgroup"):
                dropped = True
            places.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append((tag, inside, dropped, link or tag == "a", head))
            _, node, drop, link, _ = stack[-1]
        close_block()

    def path(self, n: int) -> str:
        """A container's path from the page's root."""
        steps = []
        while n > 0:
            steps.append(self.step[n])
            n = self.parent[n]
        return "".join(f">{x}" for x in reversed(steps))

    def named(self, n: int) -> bool:
        """Whether a container's tag or class calls it an article."""
        tag = self.step[n].split(".")
        return tag[0] in ("article", "main") or bool(_ARTICLE & set(tag[1:]))

    def best(self) -> int:
        """Of the containers with nearly all text the outermost that is named an article, or else the innermost; -1
        without any text. What an article holds beside its longest part thus stays."""
        if not self.blocks:
            return -1
        total = self._sums(self.score)
        if not total[0]:
            return 0
        chain = [n for n in range(len(total)) if total[n] >= NEARLY * total[0]]
        return next((n for n in chain if self.named(n)), chain[-1])

    def on_path(self, path: str) -> list[int]:
        """The containers on a path, if any of them has text."""
        wanted = _extended(0, "")
        for step in path.split(">")[1:]:
            wanted = _extended(wanted, step)
        found = {n for n, k in enumerate(self.key) if k == wanted}
        for node, _ in self.blocks:
            while node >= 0:
                if node in found:
                    return sorted(found)
                node = self.parent[node]
        return []

    def text(self, nodes: list[int]) -> str:
        wanted, out, known = set(nodes), [], {}
        for node, text in self.blocks:
            if node not in known:
                up = node
                while up >= 0 and up not in wanted:
                    up = self.parent[up]
                known[node] = up >= 0
            if known[node]:
                out.append(text)
        return "\n".join(out)


def extract(html: str | None, paths: list[str] | None) -> str:
    """The main text: from the first of the paths that the page has, or else its own best container."""
    if not html:
        return ""
    page = Page(html)
    for path in paths or ():
        if nodes := page.on_path(path):
            return page.text(nodes)
    best = page.best()
    return page.text([best]) if best >= 0 else ""


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#:\s]+)", 1)), r"^www\.", "")


def _best_paths(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi, _, _ in text_slices(column):
                paths = []
                for text in column.slice(lo, hi - lo).to_pylist():
                    page = Page(text) if text else None
                    best = page.best() if page else -1
                    paths.append(page.path(best) if best >= 0 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(paths, pa.string())], names=["host", "path"])

    return pages.transform(in_arrow, run, "host string, path string")


def main_text(df: DataFrame, html_col: str = "html", url_col: str = "url", share: float = SHARE) -> DataFrame:
    """The input with text (string) and n_chars (long)."""
    names = ["text", "n_chars"]
    df = df.drop(*[n for n in names if n not in (html_col, url_col)])
    votes = _best_paths(df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col))).where("path is not null")
    votes = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    votes = stored(votes, "votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    won = votes.join(totals, "host").where(F.col("votes") >= share * F.col("all"))
    won = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("least"), "path"))).alias("w"))  # of at most 1 / share
    won = stored(won.select("host", F.col("w.path").alias("paths")), "paths")
    rows = df.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host"))
    joined = join_checked(rows, won, "host", "left").select("row.*", "paths")
    joined = joined.toDF(*(f"c{k}" for k in range(len(joined.columns))))  # by place: names may clash
    at, kept = df.columns.index(html_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = [extract(h, p) for h, p in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*kept, *names])

    return joined.transform(in_arrow, run, with_fields(df.schema, text="string", n_chars="long"))
