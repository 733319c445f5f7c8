"""Corpus encoding by a bounded-lookahead streaming transducer for byte-level BPE.

The transducer reads bytes left to right and keeps, for each end position still open, the last token of the encoding of the text up
to there. That token is unique: it is the vocabulary item whose junction with its predecessor survives re-encoding. A later token
can start only inside the last `lookahead` bytes (the longest item that the merge list can build), so once all those open positions
lead back to one position, everything before it is final, is emitted and forgotten: memory stays constant in the length of the text.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps of each memo; a full memo is emptied, which changes speed only.
MEMO = 200_000


def tokenizer_path(path: str | None = None) -> str:
    return path or os.path.join(DEFAULT_FOLDER, DEFAULT_FILE)


class ByteTransducer:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.items = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.lookahead = max(map(len, ranks))
        self._pieces: dict[str, list[int]] = {}
        self._junctions: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> ByteTransducer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """The merge list applied to a short span: the lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def joins(self, left: int | None, right: int) -> bool:
        """Whether `right` may follow `left`: their bytes re-encode to just these two. left None: at the start."""
        key = (-1 if left is None else left, right)
        known = self._junctions.get(key)
        if known is None:
            if len(self._junctions) >= MEMO:
                self._junctions.clear()
            head = b"" if left is None else self.items[left]
            known = self._junctions[key] = self.merge(head + self.items[right]) == ([right] if left is None else [left, right])
        return known

    def transduce(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one span of bytes of any length, each as soon as it is final."""
        ranks, far = self.ranks, self.lookahead
        text = bytearray()  # bytes from the position `base` on
        last: list[int | None] = [None]  # last token of each prefix from `base` on
        due = 2 * far
        for byte in data:
            text.append(byte)
            end = len(text)
            for start in range(max(0, end - far), end):
                token = ranks.get(bytes(text[start:end]))
                if token is not None and self.joins(last[start], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            if end >= due:
                settled = self._settled(last)
                if settled:
                    yield from self._path(last, settled)
                    del text[:settled], last[:settled]
                due = len(text) + far
        yield from self._path(last, len(text))

    def _settled(self, last: list) -> int:
        """The position that every open one leads back to."""
        open_ = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(open_) > 1:
            top = max(open_)
            open_.discard(top)
            open_.add(top - len(self.items[last[top]]) if top else 0)
        return open_.pop()

    def _path(self, last: list, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.items[last[end]])
        return out[::-1]

    def piece(self, text: str) -> list[int]:
        known = self._pieces.get(text)
        if known is None:
            known = list(self.transduce(text.encode("utf-8", "replace")))
            if len(text) <= 64:
                if len(self._pieces) >= MEMO:
                    self._pieces.clear()
                self._pieces[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self._pieces, out.extend
        for p in self.pattern.findall(text):
            ids = known.get(p)
            extend(self.piece(p) if ids is None else ids)
        return out

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a text that arrives in chunks. The last two pieces wait for more text, as the next character may still change them."""
        held = ""
        for chunk in chunks:
            held += chunk
            spans = [m.span() for m in self.pattern.finditer(held)]
            for a, b in spans[:-2]:
                yield from self.piece(held[a:b])
            if len(spans) > 2:
                held = held[spans[-2][0] :]
        yield from self.encode(held)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, character by character as its bytes complete; ill-formed bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := state.decode(self.items.get(i, b"")):
                yield piece
        if piece := state.decode(b"", True):
            yield piece

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(2)
def transducer(path: str) -> ByteTransducer:
    """One transducer a worker process."""
    return ByteTransducer.from_file(path)


def encode_column(text: Column | str, path: str | None = None) -> Column:
    """array<int> of token ids without special tokens; [] for empty text, null for null. The vocabulary file is read by each worker
    from `path`, which must exist on every machine."""
    where = tokenizer_path(path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(where)
        for s in batches:
            yield pd.Series([None if x is None else t.encode(x) for x in s], index=s.index, dtype=object)

    return run(text)


def size_column(text: Column | str, path: str | None = None) -> Column:
    """Number of tokens; 0 for empty text, null for null. Sends back one int a row, not the ids. Marked as not deterministic, though
    it is, so that a filter on it does not encode every text a second time."""
    where = tokenizer_path(path)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(where)
        for s in batches:
            yield pd.Series([None if x is None else len(t.encode(x)) for x in s], index=s.index, dtype="Int32")

    return run.asNondeterministic()(text)


def decode_column(ids: Column | str, path: str | None = None) -> Column:
    where = tokenizer_path(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(where)
        for s in batches:
            yield pd.Series([None if x is None else t.decode(x) for x in s], index=s.index, dtype=object)

    return run(ids)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, repeated rows included; a narrow map without shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), encode_column(F.col(text), path).alias("ids"))
