"""Token counts of byte-level BPE by merging alone: a heap of adjacent pairs over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Pretokens whose counts a worker keeps, of at most KEPT_LENGTH characters each: twice so many, those used last.
KEPT, KEPT_LENGTH = 250_000, 32
_SHIFT = 20


def _ranges(kind: str, below: int) -> str:
    """The inside of a character class of all code points under `below` whose category begins with kind."""
    out, first, last = [], None, None
    for code in range(below):
        if unicodedata.category(chr(code))[0] != kind:
            continue
        if last is None or code != last + 1:
            if first is not None:
                out.append((first, last))
            first = code
        last = code
    out.append((first, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(2)
def _pattern(below: int) -> re.Pattern:
    letter, number, space = _ranges("L", below), _ranges("N", below), "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    if below == 256:
        space = "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def pretokens(text: str) -> list[str]:
    """Cuts text by byte-level BPE's rule, with explicit classes for letters, numbers and white space; small classes, which are faster, where they do."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _pattern(sys.maxunicode + 1).findall(text)
    return _pattern(256).findall(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary of a byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Ranks of the merges of a tokenizer file, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.of_byte = [vocab[c] for c in byte_letters()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << _SHIFT | vocab[right]] = rank
            self.made.append(vocab[left + right])
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def merged(self, piece: bytes) -> int:
        """How many merges are made in piece: the adjacent pair of lowest rank, leftmost on ties, is popped until none is left."""
        n = len(piece)
        symbol = [self.of_byte[b] for b in piece]
        rank = self.rank
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << _SHIFT | symbol[i + 1])
            if r is not None:
                heap.append((r, i))
        if not heap:
            return 0
        heapq.heapify(heap)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = following[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << _SHIFT | symbol[j]) != r:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i], symbol[j] = self.made[r], -1
            after = following[i] = following[j]
            if after < n:
                preceding[after] = i
                r = rank.get(symbol[i] << _SHIFT | symbol[after])
                if r is not None:
                    heapq.heappush(heap, (r, i))
            before = preceding[i]
            if before >= 0:
                r = rank.get(symbol[before] << _SHIFT | symbol[i])
                if r is not None:
                    heapq.heappush(heap, (r, before))
        return merges


class Counter(dict):
    """Tokens of each pretoken: its bytes less its merges."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            data = piece.encode("utf-8", "surrogatepass")
            n = len(data) - (self.merges.merged(data) if len(data) > 1 else 0)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))

    def count(self, text: str) -> int:
        special = self.merges.special
        if special is None or special.search(text) is None:
            return self.plain(text)
        return sum(map(self.plain, special.split(text))) + len(special.findall(text))


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(Merges(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row's whole text.

    path: a byte-level BPE file of the tokenizers library, at the same place on every executor. A
    special string inside a text is one token, as in the library. A null text counts as empty: no
    bytes and no tokens. Rows are counted one by one, so repeated rows stay and other columns of
    docs are not read. One pass, no shuffle.
    """

    bounded_batches(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], pa.int64()),
                    pa.array([count(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
