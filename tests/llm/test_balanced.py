import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidescore.llm.balanced import END, LENGTH, Packer, assign, balanced, cost
from tidescore.llm.packing import ids_from


def check(found, texts):
    """Every id in one piece, every sequence without gaps; the padding."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
        by_doc[row.doc_id].append(row)
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= LENGTH
        padding += LENGTH - at if at & (at - 1) else 0
    for doc_id, text in texts.items():
        ids = np.array([*ids_from(None, None).file.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        at = 0
        for row in sorted(by_doc[doc_id], key=lambda row: row.start):
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at:at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    return padding


def test_documents(documents_small):
    found = balanced(documents_small, sequences=16).collect()
    assert check(found, {row.doc_id: row.text for row in documents_small.collect()}) == 0
    wholes = sum(1 for row in found if row.length == row.doc_tokens)
    assert wholes > 0.5 * len({row.doc_id for row in found})


def test_odd_rows(docs_of, odd):
    texts = [*odd, "a<|endoftext|>b", " " * 3000]
    docs = docs_of(texts).withColumnsRenamed({"lang": "start", "source": "offset"})
    assert check(balanced(docs).collect(), {k + 1: text for k, text in enumerate(texts)}) == 0
    again = balanced(docs_of([(5, "same"), (5, "same"), (None, "none")])).collect()
    assert {row.doc_id for row in again} == {5, None} and sum(row.doc_id == 5 and row.start == 0 for row in again) == 2
    assert balanced(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_each_piece_goes_to_the_lowest_cost_with_room(seed):
    choose = random.Random(seed)
    lengths = [choose.randint(1, 64) for _ in range(300)]
    capacities = [64] * (sum(lengths) // 64)
    fill, costs, last = [0] * len(capacities), [0] * len(capacities), 65
    done = defaultdict(int)
    for piece, start, size, sequence, offset in assign(lengths, capacities):
        assert start == done[piece] and offset == fill[sequence]
        if not start:
            assert lengths[piece] <= last
            last = lengths[piece]
        rest = lengths[piece] - start
        roomy = [k for k in range(len(fill)) if 64 - fill[k] >= rest] or [k for k in range(len(fill)) if fill[k] < 64]
        assert costs[sequence] == min(costs[k] for k in roomy) and sequence in roomy
        fill[sequence] += size
        costs[sequence] += cost(size)
        done[piece] += size
    assert fill == capacities


def test_costs_are_balanced():
    """Against filling the sequences one after another in descending order."""
    choose = random.Random(3)
    packer = Packer(0, 1024, 64, 6144)
    lengths = [choose.randint(5, 300) for _ in range(900)]  # any number of them fits with others
    for k, n in enumerate(lengths):
        packer.add(k, np.zeros(n, "<u4"))
    packer.finish()
    costs, plain = defaultdict(int), defaultdict(int)
    for row in packer.found:
        costs[row[5]] += cost(row[2]) if sum(r[2] for r in packer.found if r[5] == row[5]) == 1024 else 0
    at = 0
    for n in sorted(lengths, reverse=True):
        while n:
            size = min(n, 1024 - at % 1024)
            plain[at // 1024] += cost(size)
            at, n = at + size, n - size
    plain.pop(at // 1024, None)
    full = [value for value in costs.values() if value]
    assert np.std(full) < 0.5 * np.std(list(plain.values()))
