"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are emitted.

A pre-token's bytes are its first symbols. All adjacent pairs that may merge lie on a heap by (rank, position); the
lowest is popped, stale entries are skipped, the pair merges in the linked list and its new neighbours are pushed.
The count is the number of first symbols less the number of merges. Pre-tokens recur, so each task remembers counts,
up to twice MEMO_SIZE of them (the older half goes when the newer is full).

Edge cases: a null or empty text has 0 bytes and 0 tokens; texts are never cut; repeated rows count each for
itself; other columns are kept whatever their name (one that bears the result's own name is replaced).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import in_arrow, text_slices, with_fields

DEFAULT_FILE = "byte_bpe_50k.json"
MEMO_SIZE = 400_000
OVER = 1024

#: The pre-tokenizer's published pattern (fixed value).
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The byte alphabet of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class MergeCounter:
    """Counts of one vocabulary; built once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = _byte_symbols()
        self.first = [ids[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """How many merges these symbols undergo."""
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has merged otherwise
            done += 1
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get(whole << 32 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], whole, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << 32 | whole)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbols[h], whole))
        return done

    def word(self, pre_token: str) -> int:
        raw = pre_token.encode("utf-8")
        count = self.older.get(pre_token) or len(raw) - self.merged([self.first[b] for b in raw])
        if len(self.memo) >= MEMO_SIZE:
            self.older = dict(self.memo)
            self.memo.clear()
        if len(raw) <= 64:
            self.memo[pre_token] = count
        return count

    def _plain(self, text: str) -> int:
        total, known = 0, self.memo.get
        for w in _PATTERN.findall(text):
            total += known(w) or self.word(w)
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's own string counts as one."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, text_col: str = "text", path: str | None = None, limit: int = OVER) -> DataFrame:
    """The input with n_bytes, n_tokens (long) and over_limit (boolean); input columns so named are replaced."""
    names = ["n_bytes", "n_tokens", "over_limit"]
    df = df.drop(*names)
    path = path or tokenizer_path(DEFAULT_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, _, offsets in text_slices(column):
                part = batch.slice(lo, hi - lo)
                counts = [count(t) if t else 0 for t in column.slice(lo, hi - lo).to_pylist()]
                sizes = offsets[1:] - offsets[:-1]
                new = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return df.transform(in_arrow, run, with_fields(df.schema, n_bytes="long", n_tokens="long", over_limit="boolean"))
