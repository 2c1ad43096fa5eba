import random

import pytest
from pyspark.sql import functions as F

from tidescore.llm import lines
from tidescore.llm.common import without_places
from tidescore.llm.lines import all_lines, deduplicate_lines, line_components, line_report, signatures
from brute import groups, removed_lines, shingles, without
from brute import normal as brute_normal


def test_against_all_pairs(documents_small):
    docs = {row.doc_id: row.text for row in documents_small.collect()}
    expected = removed_lines(docs)
    found = {row.doc_id: row.removed for row in line_report(documents_small).collect()}
    assert found == {doc_id: expected.get(doc_id, []) for doc_id in docs}
    cleaned = {row.doc_id: row.text for row in deduplicate_lines(documents_small).collect()}
    assert cleaned == {doc_id: without(text, expected.get(doc_id, [])) for doc_id, text in docs.items()}


def variants(n, changes):
    """Lines that differ from one base in some letters."""
    choose = random.Random(8)
    base = [choose.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
    found = set()
    while len(found) < n:
        line = list(base)
        for _ in range(choose.randint(0, changes)):
            line[choose.randrange(400)] = choose.choice("abcdefghij")
        found.add(" ".join("".join(line).split()))
    return sorted(found)


@pytest.mark.parametrize("changes", [2, 12])
def test_a_large_group_of_near_copies(docs_of, changes):
    texts = variants(120, changes)
    found = {row.id: row.component for row in line_components(all_lines(docs_of(texts), "doc_id", "text")).collect()}
    sets = [shingles(text) for text in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if
              len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    names = [row.name for row in sorted(all_lines(docs_of(texts), "doc_id", "text").collect(), key=lambda row: row.doc)]
    expected = groups(range(len(texts)), linked)
    kinds = {}
    for k, name in enumerate(names):
        kinds.setdefault(expected[k], set()).add(found.get(name, name))
    assert all(len(kind) == 1 for kind in kinds.values()) and len(set.union(*kinds.values())) == len(kinds)


def test_one_shuffle_for_the_signatures(docs_of):
    plan = signatures(all_lines(docs_of(["one line\nand another"]), "doc_id", "text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Python" not in text and "Arrow" not in text


def test_odd_rows(docs_of, odd):
    docs = docs_of([*odd, (None, "only here once\nword"), (None, None)]).withColumnsRenamed(
        {"lang": "removed", "source": "line"})
    cleaned = deduplicate_lines(docs)
    assert cleaned.columns == docs.columns
    texts = {row.doc_id: row.text for row in cleaned.collect() if row.doc_id is not None}
    assert [texts[k] for k in (1, 2, 4, 5)] == [None, "", "word", ""] and texts[3] == odd[2]
    assert texts[7] == odd[6] and texts[6] == odd[5]
    assert {row.text for row in cleaned.filter("doc_id IS NULL").collect()} == {"only here once", None}
    report = {row.doc_id: (row.n_lines, row.n_removed) for row in line_report(docs.select("doc_id", "text")).collect()}
    assert report[1] == (0, 0) and report[5] == (1, 1) and report[6] == (3, 0)
    assert deduplicate_lines(docs.limit(0)).count() == 0


def test_long_lines_are_read_whole(docs_of):
    choose = random.Random(2)
    line = "".join(choose.choice("abcdefghij ") for _ in range(3 * lines.PIECE))
    other = line[:-10] + "0123456789"
    text = " ".join(line.split())
    found = line_components(all_lines(docs_of([text, other, text[::-1]]), "doc_id", "text")).collect()
    assert len(found) == 2 and len({row.component for row in found}) == 1


def test_repeated_ids_are_one_document(docs_of):
    docs = docs_of([(1, "the same line stands here"), (1, "the same line stands here"), (2, "the same line stands here")])
    assert sorted((row.doc_id, row.text) for row in deduplicate_lines(docs).collect()) == [
        (1, "the same line stands here"), (1, "the same line stands here"), (2, "")]


@pytest.mark.parametrize("chunk", [lines.CHUNK, 5])
def test_crowded_buckets_lose_no_pair_that_shares_a_band(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    choose = random.Random(5)
    common = "".join(choose.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    texts = []
    for _ in range(150):
        tail = "".join(choose.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150))
        near = "".join(choose.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(39))
        texts += [common + tail, common + tail[:-39] + near]
    read = all_lines(docs_of(texts), "doc_id", "text")
    names = [row.name for row in sorted(read.collect(), key=lambda row: row.doc)]
    found = {row.id: row.component for row in line_components(read).collect()}
    minima = {row.name: row.minima for row in signatures(read).collect()}

    def agree(one, other):
        same = [a == b for a, b in zip(minima[one], minima[other])]
        return sum(same) >= 15 and any(all(same[k:k + lines.ROWS]) for k in range(0, len(same), lines.ROWS))

    sets = [shingles(text) for text in texts]
    near = [(names[k], names[k + 1]) for k in range(0, len(texts), 2)
            if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]) and agree(names[k], names[k + 1])]
    assert len(near) > 140 and all(found.get(one) == found.get(other, -1) for one, other in near)
    assert len({found[one] for one, _ in near}) == len(near)


def test_large_components_share_a_crowded_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 5)
    test_a_large_group_of_near_copies(docs_of, 12)


def test_rows_that_share_an_id_lose_only_their_own_lines(docs_of):
    docs = docs_of([(1, "the line that stands in two places"), (None, "the line that stands in two places\nkept alpha"),
                    (None, "unique at the very start\nkept beta"), (3, "a first text of three"),
                    (3, "quite another one\nthe line that stands in two places")])
    texts = ["a first text of three", "kept alpha", "quite another one", "the line that stands in two places",
             "unique at the very start\nkept beta"]
    assert sorted(row.text for row in deduplicate_lines(docs).collect()) == texts
    assert sorted((row.doc_id or 0, row.n_lines, row.removed) for row in line_report(docs).collect()) == [
        (0, 2, []), (0, 2, [0]), (1, 1, []), (3, 1, []), (3, 2, [1])]


def test_columns_named_like_those_of_the_join(docs_of):
    docs = docs_of(["one line that stands twice\nrest", "one line that stands twice\nother rest"]).withColumnsRenamed(
        {"lang": "removed__", "source": "doc__", "n_chars": "whole__"})
    cleaned = deduplicate_lines(docs)
    assert cleaned.columns == docs.columns
    assert sorted(row.text for row in cleaned.collect()) == ["one line that stands twice\nrest", "other rest"]


def test_places_are_left_out_in_one_pass(spark):
    choose = random.Random(6)
    rows = [([str(k) for k in range(n)], sorted(choose.sample(range(n), choose.randint(0, n)))) for n in range(1, 12)]
    rows += [(["a", "b"], []), (["a", "b"], [0, 1]), ([str(k) for k in range(100_000)], list(range(0, 100_000, 2)))]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, lines array<string>, places array<int>")
    found = df.select("k", without_places(F.col("lines"), F.col("places")).alias("left")).collect()
    for row in found:
        held, places = rows[row.k][0], set(rows[row.k][1])
        assert row.left == [line for at, line in enumerate(held) if at not in places]


def test_pairs_are_the_same_with_and_without_carried_sets(docs_of, monkeypatch):
    choose, texts = random.Random(3), []
    for _ in range(12):
        word = "".join(choose.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
        texts += [word[:k] for k in (24, 29, 33, 36, 38, 39, 40)]
    read = all_lines(docs_of(texts), "doc_id", "text")
    found = []
    for carried in (0, 128):
        monkeypatch.setattr(lines, "CARRIED", carried)
        found.append(sorted(line_components(read).collect()))
    assert found[0] == found[1] and len(found[0]) > 60


def near_and_far(choose, n):
    """Lines of more than ``CARRIED`` shingles that share a long passage, most pairs below the similarity, and near copies."""
    def letters(size):
        return "".join(choose.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))

    common, texts = letters(300), []
    for _ in range(n):
        tail = letters(120)
        texts += [common + tail, common + tail[:-20] + letters(20)]
    return texts


def test_rough_sets_lose_no_similar_pair(spark):
    choose = random.Random(12)
    texts = near_and_far(choose, 12)
    texts += [text[:400] + "x" * k for k, text in enumerate(texts)]
    sides = [spark.createDataFrame(list(enumerate(texts)), "k int, text string").select(
        F.col("k").alias(f"k_{end}"), lines._shingles(F.col("text")).alias(f"set_{end}")).withColumns(
            {f"n_{end}": F.size(f"set_{end}"), f"rough_{end}": lines._rough(F.col(f"set_{end}"))}) for end in "ab"]
    both = sides[0].crossJoin(sides[1]).filter("k_a < k_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    found = both.select(lines._may_be_alike("a", "b", 0.8).alias("may"),
                        lines._alike(common, F.col("n_a"), F.col("n_b"), 0.8).alias("alike")).collect()
    assert all(row.may for row in found if row.alike) and sum(row.alike for row in found) > 24
    assert sum(row.may for row in found) < sum(row.alike for row in found) + 20


def test_pairs_that_are_not_similar_do_not_leave_a_crowded_bucket(docs_of, monkeypatch):
    texts, kept, stored = near_and_far(random.Random(7), 60), {}, lines.store

    def store(df, path):
        found = stored(df, path)
        if path.endswith("/crossed"):
            kept["pairs"] = found.count()
        return found

    monkeypatch.setattr(lines, "store", store)
    found = line_components(all_lines(docs_of(texts), "doc_id", "text")).collect()
    assert len(found) == len(texts) and len({row.component for row in found}) == len(texts) // 2
    assert kept["pairs"] <= len(texts)


def test_documents_are_read_once(documents_small, monkeypatch):
    read, stored = [], lines.store

    def store(df, path):
        read.append(any("documents.parquet" in file for file in df.inputFiles()))
        return stored(df, path)

    monkeypatch.setattr(lines, "store", store)
    found = lines.removed_lines(documents_small)
    assert sum(read) == 1 and not any("documents.parquet" in file for file in found.inputFiles())


def test_white_space_of_all_kinds_is_folded(spark):
    texts = ["two  spaces", "a\ttab", "a\x0bline\x0cfeed", "back\r", "  Both ends ", "plain Text", "Straße  É", ""]
    found = spark.createDataFrame([(text,) for text in texts], "text string").select(lines.normal(F.col("text"))).collect()
    assert [row[0] for row in found] == [brute_normal(text) for text in texts]
