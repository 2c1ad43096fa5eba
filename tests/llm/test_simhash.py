import numpy as np
import pytest
import xxhash

from tidescore.llm import simhash
from tidescore.llm.simhash import fingerprint, keep_one_of_each, near_duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(ids, values):
    """The smallest id reachable, by looking at every pair."""
    found = dict.fromkeys(ids)
    values = np.array(values, np.uint64)
    for start in sorted(ids):
        if found[start] is not None:
            continue
        todo, found[start] = [start], start
        while todo:
            near = np.bitwise_count(values ^ values[ids.index(todo.pop())]) <= 4
            for k in near.nonzero()[0]:
                if found[ids[k]] is None:
                    found[ids[k]] = start
                    todo.append(ids[k])
    return found


def test_against_all_pairs(documents_small):
    rows = documents_small.select("doc_id", "text").collect()
    prints = {row.doc_id: plain_fingerprint(row.text) for row in rows}
    expected = plain_components(list(prints), list(prints.values()))
    found = near_duplicates(documents_small).collect()
    assert {row.doc_id: int(row.fingerprint, 16) for row in found} == prints
    assert {row.doc_id: row.component_id for row in found} == expected
    kept = sorted(row.doc_id for row in keep_one_of_each(documents_small).collect())
    assert kept == sorted(set(expected.values()))


def random_prints(spark, n, spread):
    """Fingerprints around a few centres, with up to ``spread`` bits flipped."""
    random = np.random.default_rng(3)
    values = random.integers(0, 2**63, 12, dtype=np.uint64)[random.integers(0, 12, n)]
    for _ in range(spread):
        values ^= np.uint64(1) << random.integers(0, 64, n, dtype=np.uint64)
    return values, spark.createDataFrame([(k, int(value)) for k, value in enumerate(values.view(np.int64).tolist())],
                                         "doc_id bigint, value bigint")


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 7])
@pytest.mark.parametrize("spread", [3, 6])
def test_links_are_all_found_also_in_split_groups(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values, prints = random_prints(spark, 600, spread)
    found = {row.value: row.component_id for row in simhash.link(prints).collect()}
    expected = plain_components(list(range(600)), values.tolist())
    assert [found[value] for value in values.view(np.int64).tolist()] == [expected[k] for k in range(600)]


def test_odd_rows(docs_of, odd):
    docs = docs_of([*odd, (None, "word"), (None, None)]).withColumnRenamed("lang", "component_id")
    found = near_duplicates(docs).collect()
    assert len(found) == len(odd) + 2
    by_id = {row.doc_id: row for row in found if row.doc_id is not None}
    assert {by_id[k].component_id for k in (1, 2, 3)} == {1} and by_id[1].fingerprint == "0" * 16
    assert by_id[5].component_id == 4 and by_id[7].fingerprint == f"{fingerprint('x' * 100_000):016x}"
    assert {row.component_id for row in found if row.doc_id is None} == {4, 1}
    assert keep_one_of_each(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0


def test_many_equal_texts(docs_of):
    found = near_duplicates(docs_of(["same text here for all"] * 500 + ["another text that is not the same"])).collect()
    assert {row.component_id for row in found} == {1, 501}


def words_of(seed, n=400):
    random = np.random.default_rng(seed)
    return [f"w{k}" for k in random.integers(0, 5000, n)]


def test_null_ids_link_bridge_and_leave_one_row(docs_of):
    base = words_of(1)
    near, far, other = base[:-1] + ["x"], ["y"] + base[:-2] + ["z", "x"], words_of(2)
    values = [np.uint64(fingerprint(" ".join(words))) for words in (base, near, far, other)]
    apart = [int(np.bitwise_count(values[i] ^ values[j])) for i, j in ((0, 1), (1, 2), (0, 3))]
    assert apart[0] <= 4 and apart[1] <= 8 and apart[2] > 8
    docs = docs_of([(None, " ".join(base)), (None, " ".join(near)), (None, " ".join(near)),
                    (None, " ".join(other)), (8, " ".join(other)), (9, " ".join(words_of(3)))])
    found = near_duplicates(docs).collect()
    assert sorted(row.component_id for row in found if row.component_id is not None) == [8, 8, 9]
    kept = keep_one_of_each(docs).collect()
    assert sorted(row.doc_id or 0 for row in kept) == [0, 8, 9] and len(kept) == 3
    assert [row.text for row in kept if row.doc_id is None][0] in (" ".join(base), " ".join(near))


FAR = 0x3FFFFFFF00000000


def test_a_fingerprint_of_a_null_id_bridges(spark):
    prints = spark.createDataFrame([(5, 0), (None, 0b1111), (7, 0b11111111), (None, FAR), (None, FAR + 1)],
                                   "doc_id bigint, value bigint")
    found = {row.value: (row.first_one, row.component_id) for row in
             simhash.link(prints).withColumnRenamed("first", "first_one").collect()}
    assert {found[value] for value in (0, 0b1111, 0b11111111)} == {(0, 5)}
    assert found[FAR] == found[FAR + 1] == (FAR, None)
