"""Best-fit packing of token sequences with a fixed number of open bins.

Documents are tokenised and get an end token; only those longer than a sequence are cut, into full pieces
behind a first one that may be shorter. A piece goes to the open bin that it fills best. The open bins are kept by
their free space, with a bitset of the free spaces that occur, so finding that bin is one shift and one lowest bit.
If none has room, a bin is opened; if too many are open then, the fullest closes first. A full bin closes at once.

The pieces are dealt evenly to tasks, whatever their ids, and put into an order by hash. Each task packs on its own
with bounded memory, some thousand pieces after the other, the longest of these first; the waste is mostly what
its last open bins leave free.

The ids are those of the ``tokenizers`` file. The same vocabulary as ranks gives the same ids several times faster
and is used where a text holds none of the file's special tokens; a test compares the two.

Edge cases: a null text counts as empty: its sequence is the end token alone. Repeated rows are packed each. A null
id stays null. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidescore.llm.bpe import read_ranks
from tidescore.llm.common import id_and_text

LENGTH, END, OPEN_BINS = 1024, 2, 4096
# Pieces that are placed in the order of their length before the next ones.
WINDOW = 8192
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
RESULT = PIECE + ", sequence_id bigint, offset bigint"


class Ids:
    """Token ids of a text by a tokenizer file, or by the rank file of the same vocabulary."""

    def __init__(self, json_path: str, ranks_path: str):
        self.file = Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as file:
            self.special = [token["content"] for token in json.load(file)["added_tokens"]]
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                       mergeable_ranks=read_ranks(ranks_path))

    def of(self, text: str) -> list[int]:
        if any(token in text for token in self.special):
            return self.file.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


@lru_cache(maxsize=1)
def ids_from(json_path: str | None, ranks_path: str | None) -> Ids:
    return Ids(json_path or public_tokenizers.path("byte_bpe_50k.json"),
               ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Bins:
    """Open bins by free space. ``place`` gives the bin's number and the place in it."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.limit = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.spaces = 0  # bit f is set if a bin with f free is open
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.spaces ^= 1 << free
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            found, free = self.made, self.length
            self.made += 1
        if free > size:
            if self.open == self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.by_free[free - size].append(found)
            self.spaces |= 1 << (free - size)
            self.open += 1
        return found, self.length - free


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """First token and end of each piece of a document of ``n`` tokens: all full but perhaps the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(start, start + length) for start in range(first, n, length)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
           json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The pieces of all documents, with a checksum of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_from(json_path, ranks_path).of
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.array([*ids_of(text.as_py() or ""), end], "<u4")
                rows += [(doc_id, k, start, stop - start, zlib.crc32(data[start:stop].tobytes()))
                         for k, (start, stop) in enumerate(cut(len(data), length))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), PIECE_TYPES)], PIECE_NAMES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE)


def pack(parts: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces with their ``sequence_id`` and the ``offset`` in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for start in range(0, len(lengths), WINDOW):
                for row in start + np.argsort(-lengths[start:start + WINDOW], kind="stable"):
                    number, offset[row] = bins.place(int(lengths[row]))
                    sequence[row] = first + number
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(PIECE_NAMES)], pa.array(sequence), pa.array(offset)],
                                             [*PIECE_NAMES, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.select(*PIECE_NAMES, order.alias("order")).hint("rebalance").sortWithinPartitions("order", "doc_id", "piece", "start")
    return dealt.mapInArrow(run, RESULT)


def packed(docs: DataFrame, **options) -> DataFrame:
    return pack(pieces(docs, **options))
