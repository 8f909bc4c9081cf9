"""Encoding with a public byte-level BPE tokenizer: merges by a segment tree.

Over the byte positions of a piece stands a segment tree of the ranks of the pairs that begin there; its root
names the leftmost pair of least rank. A merge changes two leaves, the merged position and its left neighbour,
and kills a third, so it costs a logarithm, and a piece of n bytes n log n, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import spread

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
# Fixed pattern: how byte-level BPE of this family cuts text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 62
#: Pieces whose ids a worker keeps.
CACHE = 400_000


class SegmentTree:
    """The least ``rank << 32 | position`` over the positions of a piece."""

    def __init__(self, leaves: list[int]) -> None:
        n = 1
        while n < len(leaves):
            n *= 2
        self.n = n
        self.node = [NONE] * n + leaves + [NONE] * (n - len(leaves))
        for i in range(n - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a < b else b

    def least(self) -> int:
        return self.node[1]

    def put(self, at: int, value: int) -> None:
        node, i = self.node, at + self.n
        node[i] = value
        i //= 2
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            new = a if a < b else b
            if node[i] == new:
                break
            node[i] = new
            i //= 2


class ByteBPE:
    """Ranks of a ``.tiktoken`` file (base64 token, id)."""

    def __init__(self, data: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.pattern = regex.compile(PIECES)
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        get = ranks.get
        end = list(range(1, n + 1))  # end[i]: where the token that begins at i ends
        before = list(range(-1, n - 1))  # before[i]: where the token before the one at i begins
        tree = SegmentTree([(r << 32 | i) if (r := get(piece[i : i + 2])) is not None else NONE for i in range(n - 1)] + [NONE])
        while (top := tree.least()) != NONE:
            i = top & 0xFFFFFFFF
            j = end[i]  # the right part of the pair, which dies
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
                r = get(piece[i : end[end[i]]])
                tree.put(i, NONE if r is None else r << 32 | i)
            else:
                tree.put(i, NONE)
            tree.put(j, NONE)
            k = before[i]
            if k >= 0:
                r = get(piece[k : end[i]])
                tree.put(k, NONE if r is None else r << 32 | k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, special tokens' strings being ordinary text; none for an empty or null text."""
        out: list[int] = []
        cache = self.cache
        for piece in self.pattern.findall(text or ""):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "names"):
            self.names = {v: k for k, v in self.ranks.items()}
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _built(data: bytes) -> ByteBPE:
    return ByteBPE(data)


def vocabulary(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """A vocabulary file, read on the driver and broadcast; its size is the tokenizer's, under a megabyte."""
    data = (Path(folder) / f"{name}.tiktoken").read_bytes()
    if len(data) > 16 << 20:
        raise ValueError("a vocabulary file of over 16 MB is not broadcast")
    return documents.sparkSession.sparkContext.broadcast(data)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every row: the token ids of the whole text, without special tokens.

    An empty text has no ids, a null text too: both come out with an empty list. A blank text is encoded as it
    stands. Rows that come twice come out twice; a null key is kept.
    """
    words = vocabulary(documents, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(words.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every row; 0 for an empty or null text. The ids never leave the worker."""
    words = vocabulary(documents, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(words.value)
        for batch in batches:
            n = [len(bpe.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, n_tokens bigint")
