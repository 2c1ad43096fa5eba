"""Ranked lexical search by bit-sliced Bloom signatures.

Documents are indexed where they are read. A shard holds some documents of similar vocabulary size and a matrix
of bits: a column for each document, and rows that are the slices. A term has three rows by hash, and a
document that holds the term has its bit in all of them, so the AND of the three is a bitmap that overestimates which
documents hold it. A term that occurs 2, 4, 8, ... times in a document is set under a key for that level too.

A query sums its terms' weights over the bitmaps of a level; such a slice sum, times what the level adds at most to the
score of a document of this length, added over the levels, is an upper bound of each document's score. A document is
provably excluded if its bound is below the k-th best exact score that the task has found for the query. All others are scored
exactly, from the shard's own lists of terms and occurrences: the k with the highest bounds first, then those that
still are not excluded.

Document frequencies, the number of documents and of terms are those of the whole table. The queries are a stated set; they
are dealt into blocks of bounded size, and such a block is what is broadcast to all shards.

Terms are compared by their bytes. All numbers but the logarithm are integers. Equal scores go by ascending id,
null ids last. Edge cases: null and empty texts have no terms, so they neither count nor are found, and as
queries have no result. Rows with a null or repeated id are found each. Query rows with one id, null too, are one
query with the terms of all. An empty table gives an empty result. Texts are read whole; a task holds some thousand documents
at once, fewer long ones, or one very long one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidescore.llm.common import delete, folder, id_and_text, store
from tidescore.operators.skew import broadcast_if_small

# Slices of a key, and slices of a shard for each key of its longest documents.
HASHES, SLICES = 3, 16
# Documents and bytes of text that are indexed together, and query terms of a block, about.
DOCUMENTS, TEXT_BYTES, QUERY_TERMS = 4096, 8 << 20, 200_000
SCALE, SATURATION, LENGTH_WEIGHT = 1_000_000_000, 1000, 20
ARRAYS = {"doc_ids": np.int64, "id_is_null": np.bool_, "lengths": np.int64, "slices": np.uint8, "starts": np.int64,
          "numbers": np.int32, "times": np.int32}
INDEX = ("n_docs bigint, n_terms bigint, n_slices bigint, levels int, terms array<binary>, holders array<int>, "
         + ", ".join(f"{name} binary" for name in ARRAYS))
FOUND = "item_id bigint, doc_id bigint, score bigint"


def _alphabet() -> bytes:
    """Bytes as they are compared: capital letters lowered, and a space for all that is in no term."""
    table = bytearray(range(256))
    for byte in range(128):
        if not chr(byte).isalnum():
            table[byte] = ord(" ")
        elif ord("A") <= byte <= ord("Z"):
            table[byte] = byte + 32
    return bytes(table)


ALPHABET = _alphabet()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in its order, with repeats."""
    return (text or "").encode().translate(ALPHABET).split()


def term_hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(term) for term in terms), np.uint64, len(terms))


def slices_of(hashes: np.ndarray, level: int, n_slices: int) -> np.ndarray:
    """The rows of terms at a level, as ``(terms, HASHES)``; ``n_slices`` is a power of two."""
    rows = []
    for k in range(HASHES):
        mixed = (hashes ^ np.uint64(HASHES * level + k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        rows.append((mixed ^ (mixed >> np.uint64(32))) & np.uint64(n_slices - 1))
    return np.stack(rows, axis=1).astype(np.int64)


def contribution(times, length_part):
    """What a term adds to a score, but for its weight."""
    return SCALE * times // (SATURATION * times + LENGTH_WEIGHT * length_part)


def _shards(docs: list[tuple[int | None, list[bytes]]]) -> Iterator[dict]:
    """Index rows of some documents, each of those whose numbers of keys have the same power of two."""
    docs = [doc for doc in docs if doc[1]]
    if not docs:
        return
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(words) for _, words in docs], np.int64)
    ids = np.fromiter((numbers[word] for _, words in docs for word in words), np.int64, int(lengths.sum()))
    vocabulary = np.array(list(numbers), object)
    postings, times = np.unique(np.repeat(np.arange(len(docs)), lengths) * len(numbers) + ids, return_counts=True)
    doc, term = np.divmod(postings, len(numbers))
    level = np.frexp(times)[1] - 1  # floor of the logarithm
    size = np.ceil(np.log2(np.bincount(doc, level + 1))).astype(np.int64)
    hashes = term_hashes(vocabulary)
    for own_size in np.unique(size):
        members = np.nonzero(size == own_size)[0]
        mine = size[doc] == own_size
        place = np.searchsorted(members, doc[mine])
        own, number = np.unique(term[mine], return_inverse=True)
        n_slices, own_level, own_times = SLICES << int(own_size), level[mine], times[mine]
        bits = np.zeros((n_slices, len(members)), bool)
        for at in range(int(own_level.max()) + 1):
            there = own_level >= at
            for row in slices_of(hashes[own], at, n_slices).T:
                bits[row[number[there]], place[there]] = True
        arrays = {"doc_ids": [docs[k][0] or 0 for k in members], "id_is_null": [docs[k][0] is None for k in members],
                  "lengths": lengths[members], "slices": np.packbits(bits, axis=1),
                  "starts": np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(members))))),
                  "numbers": number, "times": own_times}
        yield {"n_docs": len(members), "n_terms": int(lengths[members].sum()), "n_slices": n_slices,
               "levels": int(own_level.max()) + 1, "terms": vocabulary[own].tolist(),
               "holders": np.bincount(number, minlength=len(own)).tolist(),
               **{name: np.asarray(arrays[name], kind).tobytes() for name, kind in ARRAYS.items()}}


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                documents: int = DOCUMENTS) -> DataFrame:
    """The index, stored under the path: a row for each shard."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("n_slices", pa.int64()), ("levels", pa.int32()),
                            ("terms", pa.list_(pa.binary())), ("holders", pa.list_(pa.int32())),
                            *((name, pa.binary()) for name in ARRAYS)])
        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                waiting.append((doc_id, terms_of(text)))
                size += len(text)
                if len(waiting) >= documents or size >= TEXT_BYTES:
                    for shard in _shards(waiting):
                        yield pa.RecordBatch.from_pylist([shard], schema)
                    waiting, size = [], 0
        for shard in _shards(waiting):
            yield pa.RecordBatch.from_pylist([shard], schema)

    return store(id_and_text(docs, id_col, text_col).mapInArrow(index, INDEX), path)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``: the distinct terms of each query."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = list(set(terms_of(text.as_py())))
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(terms), pa.int64()),
                                                      pa.array(terms, pa.binary())], ["item_id", "term"])

    return id_and_text(queries, id_col, text_col).mapInArrow(split, "item_id bigint, term binary").distinct()


class Queries:
    """A block of queries: their ids, the different terms, and each query's terms by number, with weights."""

    def __init__(self, rows: list, n_docs: int):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        lists, weights = defaultdict(list), defaultdict(list)
        for row in rows:
            lists[row.item_id].append(numbers[bytes(row.term)])
            weights[row.item_id].append(weight(row.n, n_docs))
        self.ids = list(lists)
        self.terms = list(numbers)
        self.lists = [np.array(lists[item]) for item in self.ids]
        self.weights = [np.array(weights[item], np.int64) for item in self.ids]


def weight(n_holders: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_holders + 1)))


class Shard:
    """A row of the index, with what each of its postings adds to a score of weight 1."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.terms, self.n_slices, self.levels = row["terms"], row["n_slices"], row["levels"]
        self.slices = self.slices.reshape(self.n_slices, -1)
        self.part = 50 + 50 * self.lengths * n_docs // n_terms
        self.value = contribution(self.times.astype(np.int64), np.repeat(self.part, np.diff(self.starts)))

    def bounds(self, queries: Queries, hashes: np.ndarray) -> np.ndarray:
        """An upper bound of each document's score for each query, as ``(queries, documents)``."""
        found = np.zeros((len(queries.ids), len(self.lengths)))
        before = np.zeros(len(self.lengths), np.int64)
        for level in range(self.levels):
            rows = slices_of(hashes, level, self.n_slices)
            maps = np.bitwise_and.reduce(self.slices[rows], axis=1)
            there = np.nonzero(maps.any(axis=1))[0]
            most = contribution(np.minimum((2 << level) - 1, self.lengths), self.part)
            adds, before = np.maximum(most - before, 0), np.maximum(most, before)
            if not len(there):
                continue
            place = np.full(len(maps), -1)
            place[there] = np.arange(len(there))
            bits = np.unpackbits(maps[there], axis=1, count=len(self.lengths)).astype(np.float64)
            for k, (numbers, weights) in enumerate(zip(queries.lists, queries.weights)):
                at = place[numbers]
                known = at >= 0
                if known.any():
                    found[k] += (weights[known].astype(np.float64) @ bits[at[known]]) * adds
        return found

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, by the weight of each term of the shard."""
        first, sizes = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.numbers[at]] * self.value[at], ends - sizes)

    def term_numbers(self, terms: dict[bytes, int]) -> np.ndarray:
        """For each term of the shard its number in the queries, or -1."""
        return np.fromiter((terms.get(bytes(term), -1) for term in self.terms), np.int64, len(self.terms))


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores, ids, nulls) -> None:
        good = scores >= self.least
        self.scores, self.ids, self.nulls = (np.concatenate(pair) for pair in (
            (self.scores, scores[good]), (self.ids, ids[good]), (self.nulls, nulls[good])))
        if len(self.scores) > self.k:
            kept = np.lexsort((self.ids, self.nulls, -self.scores))[:self.k]
            self.scores, self.ids, self.nulls = self.scores[kept], self.ids[kept], self.nulls[kept]
        if len(self.scores) == self.k:
            self.least = max(1, int(self.scores.min()))


def _search(shard: Shard, queries: Queries, hashes: np.ndarray, terms: dict[bytes, int], best: list[Best]) -> None:
    bounds = shard.bounds(queries, hashes)
    numbers = shard.term_numbers(terms)
    of_query = np.zeros(len(queries.terms) + 1, np.int64)  # the last one for terms of no query
    for bound, own, listed, weights in zip(bounds, best, queries.lists, queries.weights):
        left = np.nonzero(bound >= own.least)[0]
        if not len(left):
            continue
        of_query[listed] = weights
        shard_weights = of_query[numbers]
        of_query[listed] = 0
        first = left
        if len(left) > own.k:
            order = np.argpartition(-bound[left], own.k)
            first, left = left[order[:own.k]], left[order[own.k:]]
        else:
            left = left[:0]
        own.add(shard.scores(first, shard_weights), shard.doc_ids[first], shard.id_is_null[first])
        left = left[bound[left] >= own.least]
        if len(left):
            own.add(shard.scores(left, shard_weights), shard.doc_ids[left], shard.id_is_null[left])


def _searching(queries_broadcast, k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = queries_broadcast.value
        hashes, terms = term_hashes(queries.terms), {term: at for at, term in enumerate(queries.terms)}
        best = [Best(k) for _ in queries.ids]
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                _search(Shard(row, n_docs, n_terms), queries, hashes, terms, best)
        for item_id, own in zip(queries.ids, best):
            if len(own.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_id] * len(own.scores), pa.int64()),
                     pa.array(own.ids, pa.int64(), mask=own.nulls), pa.array(own.scores, pa.int64())],
                    ["item_id", "doc_id", "score"])
    return run


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           query_id_col: str = "item_id", query_text_col: str = "text", documents: int = DOCUMENTS,
           block_terms: int = QUERY_TERMS) -> DataFrame:
    """For each query the k best documents with a score above 0: ``item_id, rank`` (from 1), ``doc_id, score``."""
    spark = docs.sparkSession
    paths = [folder(spark, name) for name in ("slices", "query_terms", "ranked")]
    index = build_index(docs, paths[0], id_col, text_col, documents)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = query_terms(queries, query_id_col, query_text_col)
    names = broadcast_if_small(asked.select("term").distinct())
    held = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("held")).select(
        F.col("held.terms").alias("term"), F.col("held.holders").alias("n"))
    frequencies = held.join(names, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    weighted = store(asked.join(frequencies, "term"), paths[1])
    n_blocks = -(-weighted.count() // block_terms)
    store(spark.createDataFrame([], FOUND), paths[2])
    columns = ["terms", "n_slices", "levels", *ARRAYS]
    for number in range(n_blocks):
        block = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number)
        compiled = spark.sparkContext.broadcast(Queries(block.collect(), n_docs))
        found = index.select(*columns).mapInArrow(_searching(compiled, k, n_docs, n_terms), FOUND)
        found.write.mode("append").parquet(paths[2])
        compiled.unpersist()
    for path in paths[:2]:
        delete(spark, path)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = spark.read.schema(FOUND).parquet(paths[2])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
