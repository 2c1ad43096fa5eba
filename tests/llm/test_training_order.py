import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidescore.llm.bpe import read_ranks
from tidescore.llm.common import folder
from tidescore.llm.training_order import permute, read_from, shard_sizes, write_shards


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    numbers = np.arange(size, dtype=np.uint64)
    slots = permute(numbers, size, 7)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 100:
        assert (slots != permute(numbers, size, 8)).mean() > 0.9 and (slots == numbers).mean() < 0.1
    assert permute(numbers[:1], 1 << 62, 3)[0] < 1 << 62


def plain_sequences(texts, length):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {}
    for doc_id, text in texts.items():
        ids = [*encoding.encode_ordinary(text or ""), 50256]
        found |= {(doc_id, k): ids[start:start + length] for k, start in enumerate(range(0, len(ids), length))}
    return found


def test_round_trip(spark, documents_small):
    uri = folder(spark, "shards")
    found = sorted(write_shards(documents_small, uri, 11, length=64, shard_bytes=100_000).collect(),
                   key=lambda row: row.slot)
    expected = plain_sequences({row.doc_id: row.text for row in documents_small.collect()}, 64)
    assert [row.slot for row in found] == list(range(len(expected)))
    read = [ids.tolist() for ids in read_from(uri, 0, 64)]
    assert read == [expected[row.doc_id, row.piece] for row in found]
    assert len(shard_sizes(uri, 64)) > 3
    for slot in (1, len(read) // 2, len(read) - 1):
        assert [ids.tolist() for ids in read_from(uri, slot, 64)] == read[slot:]
    moved = [abs(row.slot - k) for k, row in enumerate(sorted(found, key=lambda row: (row.doc_id, row.piece)))]
    assert np.mean(moved) > len(found) / 6
    again, other = folder(spark, "shards"), folder(spark, "shards")
    write_shards(documents_small.repartition(7), again, 11, length=64, shard_bytes=100_000)
    write_shards(documents_small, other, 12, length=64, shard_bytes=100_000)
    assert [ids.tolist() for ids in read_from(again, 0, 64)] == read
    assert [ids.tolist() for ids in read_from(other, 0, 64)] != read


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, (None, "none"), (3, "again"), (3, "again"), (2**62, "far"), (-2**62, "off")])
    docs = docs.withColumnsRenamed({"lang": "slot", "source": "shard"})
    uri = folder(spark, "shards")
    found = sorted(write_shards(docs, uri, 1).collect(), key=lambda row: row.slot)
    read = [ids.tolist() for ids in read_from(uri, 0)]
    assert len(read) == len(found) and [row.slot for row in found] == list(range(len(found)))
    assert [len(ids) for ids in read] == [row.n_tokens for row in found]
    assert read[next(row.slot for row in found if row.doc_id == 1)] == [50256]
    empty = folder(spark, "shards")
    assert write_shards(docs.limit(0), empty, 1).count() == 0 and list(read_from(empty, 0)) == []
