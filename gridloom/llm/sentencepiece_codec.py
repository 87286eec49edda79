"""SentencePiece merge-type encoding and decoding through a table of each prefix's last token.

A merge-type encoding has one last token for every prefix of the text. For each end position the tokens that end
there come from an Aho-Corasick automaton, longest first; a token is the last one exactly if it and the last token of the prefix before it stay
apart when both are encoded together. Ids are then read off the table backwards. Pieces carry the space mark only in
front, so no merge crosses a change from another character to the mark, nor two characters that stand side by side in
no piece: the text is cut there, and each cut piece's result is remembered, up to twice MEMO_SIZE of them (the older half goes when the newer is full).

Edge cases: a null or empty text has no ids and decodes to the empty text; characters outside the vocabulary become
byte pieces; repeated rows are encoded each for itself; other columns are kept whatever their name (those that bear
a result's own name are replaced). Texts are never cut short.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import in_arrow, text_slices, with_fields
from .token_counts import tokenizer_path

DEFAULT_FILE = "piece_bpe_32k.model"
MEMO_SIZE = 200_000
MARK = "▁"
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """One model's pieces; built once in each Python worker. The library only reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces with an inner space mark can't be cut at spaces")
        reachable = [p for p in self.id if len(p) == 1 or self._merge(p) == [p]]  # no merge ever makes the others
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        #: Character pairs inside pieces; between any other two characters nothing ever merges.
        self.inner = {p[i : i + 2] for p in reachable for i in range(len(p) - 1)}
        self.apart: dict[str, dict[str, bool]] = {}
        self.apart_size = 0
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging of a short string: highest score, then leftmost, first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are what their joined text is encoded as."""
        if self.apart_size > 2 * MEMO_SIZE:
            self.apart.clear()
            self.apart_size = 0
        self.apart_size += 1
        known = self.apart.setdefault(left, {})[right] = self._merge(left + right) == [left, right]
        return known

    def tokens(self, text: str) -> list[str]:
        """The encoding of a text in which spaces are marks already."""
        last = list(text)  # last[i]: last token of text[:i + 1]; a character without a piece merges with nothing
        done, apart = -1, self.apart
        for end, (token, size) in self.automaton.iter(text):  # by end position, longest first
            if end != done:
                before = end - size
                if before < 0:
                    last[end], done = token, end
                else:
                    left = last[before]
                    known = apart[left].get(token) if left in apart else None
                    if known is None:
                        known = self.stay_apart(left, token)
                    if known:
                        last[end], done = token, end
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        out = []
        for t in self.tokens(text):
            known = self.id.get(t)
            out.extend([known] if known is not None else [self.byte[b] for b in t.encode("utf-8")])
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        """The bytes that these ids stand for, marks as spaces."""
        return b"".join(bytes([self.value[i]]) if i in self.value else self.pieces[i].replace(MARK, " ").encode("utf-8") for i in ids)

    def _remember(self, piece: str, out: tuple[str, int, bytes]) -> tuple[str, int, bytes]:
        if len(self.memo) >= MEMO_SIZE:
            self.older = dict(self.memo)
            self.memo.clear()
        if len(piece) <= 48:
            self.memo[piece] = out
        return out

    def _cut_piece(self, piece: str) -> tuple[str, int, bytes]:
        if out := self.older.get(piece):
            return self._remember(piece, out)
        inner = self.inner
        cuts = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inner]
        if not cuts:
            return self._remember(piece, self._encoded(piece))
        ids, n, raw = [], 0, []
        for lo, hi in zip([0, *cuts], [*cuts, len(piece)]):
            x = piece[lo:hi]
            out = self.memo.get(x) or self._remember(x, self.older.get(x) or self._encoded(x))
            ids.append(out[0])
            n += out[1]
            raw.append(out[2])
        return self._remember(piece, (",".join(ids), n, b"".join(raw)))

    def _encoded(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.ids(piece)
        return ",".join(map(str, ids)), len(ids), self.bytes_of(ids)

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        """(ids as text, their number, their bytes) of each piece between cuts."""
        if not text:
            return []
        known, make = self.memo.get, self._cut_piece
        return [known(p) or make(p) for p in _CUT.findall(f"{MARK}{text.replace(' ', MARK)}")]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space that encoding puts in front goes."""
        raw = self.bytes_of(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_codec(df: DataFrame, text_col: str = "text", path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The input with the columns asked for: n_tokens (long), ids (array of int), ids_sha256, decoded, decoded_sha256
    (string; the digests are of the ids joined by commas and of the decoded text). Input columns so named are replaced."""
    df = df.drop(*outputs)
    path = path or tokenizer_path(DEFAULT_FILE)
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def row(tool: PieceCodec, text: str) -> dict:
        parts = tool.parts(text)
        out: dict = {}
        joined = ",".join([p[0] for p in parts])
        if "n_tokens" in outputs:
            out["n_tokens"] = sum([p[1] for p in parts])
        if "ids" in outputs:
            out["ids"] = [int(i) for i in joined.split(",")] if parts else []
        if "ids_sha256" in outputs:
            out["ids_sha256"] = hashlib.sha256(joined.encode()).hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            raw = b"".join([p[2] for p in parts])
            raw = raw[1:] if raw[:1] == b" " else raw
            if "decoded" in outputs:
                out["decoded"] = raw.decode("utf-8", errors="replace")
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = hashlib.sha256(raw).hexdigest()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, _, _ in text_slices(column):
                part = batch.slice(lo, hi - lo)
                rows = [row(tool, t or "") for t in column.slice(lo, hi - lo).to_pylist()]
                new = [pa.array([r[k] for r in rows], kinds[k][1]) for k in outputs]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *outputs])

    return df.transform(in_arrow, run, with_fields(df.schema, **{k: kinds[k][0] for k in outputs}))
