"""Token ids in binary shards, in a random order that a key fixes.

Each document's token ids and an end id are cut into sequences of a fixed number of tokens, the last one padded. A
sequence has a number made of its document's id and its place in it, from a range whose size needs only the lowest
and highest id and the longest text. A keyed Feistel network with cycle-walking permutes that range: the outcome
is the sequence's slot. Shards are equal ranges of slots, sorted, and records of one size follow each other in a
shard, so the place of the n-th sequence of the training order is known from the shards' sizes alone. Reading can
begin at any sequence and goes on through files in order.

The numbers that no sequence uses leave no gaps in the files: a record's place is its rank among the slots in use.
A shard is written under a name of its own and moved into place when complete; writing it again gives the
same bytes, so a task that is repeated does no harm. Ids are compressed while they are shuffled.

Edge cases: a null text counts as empty and gives one sequence with the end id alone. Null ids are numbered like
the lowest id. Sequences with the same number (repeated ids) are ordered by their content, and all of them are
written. Ids too far apart for 62 bits are hashed into 62 bits first. An empty table writes no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidescore.llm.bpe import read_ranks
from tidescore.llm.common import folder, id_and_text, store

# Tokens of a sequence, UTF-8 bytes of text for which a shard is planned, rounds of the network.
LENGTH, SHARD_BYTES, ROUNDS = 512, 32 << 20, 6
# An id that no vocabulary has; it fills the last sequence of a document.
PAD = 0xFFFF
WIDEST = 1 << 62
NAMES = ["doc_id", "piece", "n_tokens", "ids_crc32"]
COLUMNS = "doc_id bigint, piece int, n_tokens bigint, ids_crc32 bigint"


@lru_cache(maxsize=1)
def _encoding(path: str) -> tuple[tiktoken.Encoding, int]:
    ranks = read_ranks(path)
    end = max(ranks.values()) + 1
    if end >= PAD:
        raise ValueError(f"{path} has too many entries for ids of two bytes")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), end


def _mixed(value: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A round function: 64 bits that depend on all bits of the value, the key and the round."""
    constant = (key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64
    x = value ^ np.uint64(constant)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(number: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 to ``size`` - 1. Values that leave the range are permuted on until they return."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def network(x):
        left, right = x >> half, x & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key, turn) & mask)
        return (left << half) | right

    slot = network(number.astype(np.uint64))
    outside = np.nonzero(slot >= np.uint64(size))[0]
    while len(outside):
        slot[outside] = network(slot[outside])
        outside = outside[slot[outside] >= np.uint64(size)]
    return slot


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def write_shards(docs: DataFrame, uri: str, key: int, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, shard_bytes: int = SHARD_BYTES, path: str | None = None) -> DataFrame:
    """Write the shards into a folder that all executors reach; a stored row per sequence says where it is.

    The columns are ``doc_id, piece, n_tokens, ids_crc32, shard, place`` (record in the shard) and ``slot``
    (record in the whole training order).
    """
    rows = id_and_text(docs, id_col, text_col)
    size = F.octet_length("text")
    low, high, longest, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.coalesce(F.max(size), F.lit(0)),
                                         F.coalesce(F.sum(size), F.lit(0))).first()
    low, high = (0, 0) if low is None else (low, high)
    most = longest // length + 1  # a token has a byte at least, and there is an end id
    numbers, hashed = (high - low + 1) * most, False
    if numbers > WIDEST:
        numbers, hashed = WIDEST, True
    n_shards = max(1, -(-total // shard_bytes))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = _encoding(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            if not batch.num_rows:
                continue
            found, numbered = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoding.encode_ordinary(text.as_py() or ""), end], "<u2")
                own = ((low if doc_id is None else doc_id) - low) * most
                for piece, start in enumerate(range(0, len(ids), length)):
                    data = ids[start:start + length].tobytes()
                    found.append((doc_id, piece, len(data) // 2, zlib.crc32(data), compress(data)))
                    number = own + piece
                    numbered.append(xxhash.xxh64_intdigest(b"%d" % number) >> 2 if hashed else number)
            order = permute(np.array(numbered, np.uint64), numbers, key).tolist()
            shard = [slot * n_shards // numbers for slot in order]
            columns = [*zip(*found), shard, order]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)],
                                             [*NAMES, "data", "shard", "order"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(uri)
        system.create_dir(root, recursive=True)
        expand, fill = zstandard.ZstdDecompressor().decompress, np.array(PAD, "<u2").tobytes()
        shard, stream, place, temporary = None, None, 0, ""

        def finish():
            if stream is not None:
                stream.close()
                system.move(temporary, f"{root}/{_shard_name(shard)}")

        for batch in batches:
            places = []
            for now, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                if now != shard:
                    finish()
                    shard, place, temporary = now, 0, f"{root}/.{_shard_name(now)}.{uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                ids = expand(data.as_py())
                stream.write(ids + fill * (length - len(ids) // 2))
                places.append(place)
                place += 1
            kept = [batch.column(name) for name in (*NAMES, "shard")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64())], [*NAMES, "shard", "place"])
        finish()

    cut = rows.mapInArrow(sequences, f"{COLUMNS}, data binary, shard bigint, order bigint")
    dealt = cut.repartition("shard").sortWithinPartitions("shard", "order", "doc_id", "piece", "ids_crc32")
    written = store(dealt.mapInArrow(write, f"{COLUMNS}, shard bigint, place bigint"),
                    folder(docs.sparkSession, "sequences"))
    sizes = written.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return written.join(first, "shard").withColumn("slot", F.col("first") + F.col("place")).drop("first")


def shard_sizes(uri: str, length: int = LENGTH) -> list[tuple[str, int]]:
    """The complete shards in order, with their records: all that a reader has to know."""
    system, root = _open(uri)
    files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((file.path, file.size // (2 * length)) for file in files if file.base_name.startswith("shard-"))


def read_from(uri: str, slot: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The token ids of each sequence of the training order from ``slot`` on, without their padding."""
    system, _ = _open(uri)
    for path, size in shard_sizes(uri, length):
        if slot >= size:
            slot -= size
            continue
        with system.open_input_file(path) as file:
            file.seek(slot * 2 * length)
            while data := file.read(2 * length):
                ids = np.frombuffer(data, "<u2")
                yield ids[ids != PAD]
        slot = 0
