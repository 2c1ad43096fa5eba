import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidescore.llm.packing import END, LENGTH, Bins, cut, ids_from, packed


def check(found, texts):
    """Every document whole, every sequence without gaps, lengths within bounds."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
        by_doc[row.doc_id].append(row)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= LENGTH
    for doc_id, text in texts.items():
        ids = np.array([*ids_from(None, None).file.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        rows = sorted(by_doc[doc_id], key=lambda row: row.piece)
        assert [row.piece for row in rows] == list(range(len(rows))) == list(range(-(-len(ids) // LENGTH)))
        assert all(row.length == LENGTH for row in rows[1:])
        assert [row.start for row in rows] == [sum(row.length for row in rows[:k]) for k in range(len(rows))]
        for row in rows:
            assert row.ids_crc32 == zlib.crc32(ids[row.start:row.start + row.length].tobytes())
        assert rows[-1].start + rows[-1].length == len(ids)
    return len(sequences)


def test_documents(documents_small):
    found = packed(documents_small).collect()
    n = check(found, {row.doc_id: row.text for row in documents_small.collect()})
    assert n <= 1.02 * -(-sum(row.length for row in found) // LENGTH) + 1


def test_odd_rows(docs_of, odd):
    texts = [*odd, "a<|endoftext|>b", "x <|endoftext|>", " " * 3000]
    docs = docs_of(texts).withColumnsRenamed({"lang": "piece", "source": "offset"})
    check(packed(docs).collect(), {k + 1: text for k, text in enumerate(texts)})
    again = packed(docs_of([(5, "same"), (5, "same"), (None, "none")])).collect()
    assert sorted(str(row.doc_id) for row in again) == ["5", "5", "None"]
    assert packed(docs.limit(0)).count() == 0


def test_cut():
    assert cut(1, 1024) == [(0, 1)] and cut(1024, 1024) == [(0, 1024)]
    assert cut(2500, 1024) == [(0, 452), (452, 1476), (1476, 2500)]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_bins_fit_best_and_stay_bounded(limit):
    choose, bins, free = random.Random(limit), Bins(100, limit), {}
    for _ in range(2000):
        size = choose.randint(1, 100)
        fitting = [space for space in free.values() if space >= size]
        number, offset = bins.place(size)
        if fitting:
            assert 100 - offset == min(fitting) == free[number]
        else:
            assert offset == 0 and number not in free
            if len(free) == limit and size < 100:
                del free[next(key for key, space in free.items() if space == min(free.values())
                              and key not in [bin for bins_ in bins.by_free for bin in bins_])]
        free[number] = free.get(number, 100) - size
        if not free[number]:
            del free[number]
        assert bins.open == len(free) <= limit
