"""Packing of token sequences that balances what they cost to train on.

A sequence costs its tokens times a constant, and for each piece in it the square of the piece's length, since
attention stays inside a piece. Documents are tokenised, get an end token, and are cut into pieces of at most a
sequence. Pieces are taken in windows of some hundred sequences, and a window has exactly as many sequences as its
tokens fill. The pieces go in descending order to the sequence of the lowest cost that has room for the whole piece. Where
none has, the piece is cut and fills the sequences of the lowest cost that have any room. What is over, less than a
sequence, goes into the next window. At a task's end it goes into sequences whose lengths are its powers of two, which
need no padding, so nothing is ever padded.

Each task tokenises and packs what it reads, without a shuffle, and holds one window of ids. A sequence's number has
the task's partition in it.

Edge cases: a null text counts as empty: its sequence is the end token alone. Repeated rows are packed each. A null
id stays null. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidescore.llm.common import id_and_text
from tidescore.llm.packing import ids_from

LENGTH, END = 1024, 0
# Sequences of a window, and what a token costs where a pair of tokens in one piece costs 1: six times the model's width.
SEQUENCES, TOKEN_COST = 512, 6144
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
RESULT = ", ".join(f"{name} bigint" for name in NAMES)


def cost(length: int, token_cost: int = TOKEN_COST) -> int:
    """What a piece of this length costs."""
    return length * (token_cost + length)


def assign(lengths: Sequence[int], capacities: Sequence[int], token_cost: int = TOKEN_COST):
    """Places of pieces, the longest first: yields ``piece, start in the piece, length, sequence, offset``.

    The sequences have to be full at the end, so the pieces have at least as many tokens as there is room. What
    has no room any more is not yielded.
    """
    capacity = np.array(capacities, np.int64)
    free, costs = capacity.copy(), np.zeros(len(capacity), np.int64)
    never = np.iinfo(np.int64).max
    left = int(free.sum())
    for piece in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        start, rest = 0, int(lengths[piece])
        while rest and left:
            allowed = np.where(free >= rest, costs, never)
            best = int(allowed.argmin())
            if allowed[best] == never:
                best = int(np.where(free > 0, costs, never).argmin())
            size = min(rest, int(free[best]))
            yield piece, start, size, best, int(capacity[best] - free[best])
            free[best] -= size
            costs[best] += cost(size, token_cost)
            start, rest, left = start + size, rest - size, left - size


class Packer:
    """Packs documents in windows; ``rows`` gives the places found so far and forgets them."""

    def __init__(self, first: int, length: int, sequences: int, token_cost: int):
        self.number, self.length, self.sequences, self.token_cost = first, length, sequences, token_cost
        self.waiting: list[tuple] = []  # document, its tokens, start, ids of the piece
        self.tokens = 0
        self.found: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.length):
            self.waiting.append((doc_id, len(ids), start, ids[start:start + self.length]))
            self.tokens += len(self.waiting[-1][3])
            if self.tokens >= self.length * self.sequences:
                self._pack([self.length] * (self.tokens // self.length))

    def finish(self) -> None:
        full, rest = divmod(self.tokens, self.length)
        self._pack([self.length] * full + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1])

    def _pack(self, capacities: list[int]) -> None:
        placed = [0] * len(self.waiting)
        lengths = [len(piece[3]) for piece in self.waiting]
        for at, start, size, sequence, offset in assign(lengths, capacities, self.token_cost):
            doc_id, n, first, ids = self.waiting[at]
            self.found.append((doc_id, first + start, size, zlib.crc32(ids[start:start + size].tobytes()), n,
                               self.number + sequence, offset))
            placed[at] = start + size
        self.number += len(capacities)
        self.tokens -= sum(capacities)
        self.waiting = [(doc_id, n, first + done, ids[done:].copy()) for (doc_id, n, first, ids), done
                        in zip(self.waiting, placed) if done < len(ids)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*self.found)], NAMES)
            self.found = []


def balanced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
             sequences: int = SEQUENCES, token_cost: int = TOKEN_COST, json_path: str | None = None,
             ranks_path: str | None = None) -> DataFrame:
    """Where each piece of each document is; sequences are full or have a power of two as their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_from(json_path, ranks_path).of
        packer = Packer(TaskContext.get().partitionId() << 40, length, sequences, token_cost)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.array([*ids_of(text.as_py() or ""), end], "<u4"))
            yield from packer.rows()
        packer.finish()
        yield from packer.rows()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RESULT)
