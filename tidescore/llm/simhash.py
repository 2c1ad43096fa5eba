"""Near-duplicate documents by SimHash, with pivot distance tables between the candidates and the exact test.

The fingerprint of a text has 64 bits, each the majority of that bit over the XXH64 hashes of its word shingles.
Two fingerprints link if at most four bits differ. Such a pair agrees in at least two of six blocks of bits, so
fingerprints are grouped by each pair of blocks, and no link can be missed. In a group, each fingerprint has a row
of precomputed Hamming distances to fixed reference fingerprints; by the triangle inequality, a pair whose rows
differ by more than four in any coordinate cannot link and is discarded. The survivors are verified. Of the links
in a group only a spanning forest is returned, and connected components over all groups give the result.

Equal fingerprints are one vertex, however many documents share them. A group with more than ``CHUNK``
fingerprints is dealt out as pairs of chunks to separate tasks, so no task holds more than two chunks of it.

Edge cases: null, empty and blank texts have fingerprint zero and link with each other like any others. A text
with fewer words than a shingle is one shingle. Repeated rows get the same result. A null id takes part in its
component, and links others, but never names it; a component without any id has a null one. An empty table gives an
empty result. Where one document of each component is kept, null-id rows go if a row with an id is there; of those
that are among themselves, one row with the text of the smallest hash stays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import folder, free_name, id_and_text, store
from tidescore.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit and width of each
REFERENCES = np.random.default_rng(64).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.arange(
    32, dtype=np.uint64) % np.uint64(2)
CHUNK = 2048
# Shingle hashes whose bits are counted at once.
PIECE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    pairs = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i:i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed number, since Spark has no unsigned ones."""
    @F.pandas_udf("bigint")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64))
    return apply(text)


def _block_keys(value: Column) -> Column:
    """A number for each pair of blocks: which pair it is, and the bits in it."""
    def bits(first, width):
        return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for table, (one, two) in enumerate(itertools.combinations(BLOCKS, 2)):
        both = F.shiftleft(bits(*one), two[1]).bitwiseOR(bits(*two))
        keys.append(both.bitwiseOR(F.lit(table << 22)))
    return F.array(*keys)


def _union(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Join the pairs' components in ``label``; the positions of the pairs that joined something."""
    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    used = []
    for position, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        i, j = root(i), root(j)
        if i != j:
            label[max(i, j)] = min(i, j)
            used.append(position)
    return used


def _links(group: np.ndarray, value: np.ndarray, own: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected in each group, for rows that come sorted by group.

    ``side`` is 0 for rows of a group that is whole. Of a pair of chunks it is 1 or 2, and only pairs across
    them are looked at, since each chunk is also paired with itself.
    """
    n, label, found = len(group), np.arange(len(group)), []
    table = np.bitwise_count(value[:, None] ^ REFERENCES).astype(np.int8)
    left = np.arange(n)
    for offset in range(1, n):
        left = left[left + offset < n]
        left = left[group[left] == group[left + offset]]
        if not len(left):
            break
        right = left + offset
        differ = (label[left] != label[right]) & ((side[left] == 0) | (side[left] != side[right]))
        i, j = left[differ], right[differ]
        near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= DISTANCE
        i, j = i[near], j[near]
        near = np.bitwise_count(value[i] ^ value[j]) <= DISTANCE
        i, j = i[near], j[near]
        for position in _union(label, i, j):
            found.append((own[i[position]], own[j[position]]))
        while len(i) and (label[label] != label).any():
            label = label[label]
    return found


def _group_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rest is None or not len(rest):
            continue
        group = rest["group"].to_numpy()
        end = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
        if end:
            columns = [rest[name].to_numpy()[:end] for name in ("value", "own", "side")]
            yield pd.DataFrame(_links(group[:end], columns[0].view(np.uint64), columns[1], columns[2]),
                               columns=["a", "b"], dtype="int64")
        rest = rest.iloc[end:].reset_index(drop=True)


def _grouped(values: DataFrame) -> DataFrame:
    """Rows ``group, side, value, own``: each group at most two chunks large, groups of one left out."""
    keyed = values.select("value", "own", F.explode(_block_keys(F.col("value"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    whole = known.filter("chunks = 1").select(F.col("key").alias("group"), F.lit(0).alias("side"), "value", "own")
    mine = F.pmod(F.xxhash64("value"), F.col("chunks"))
    split = (known.filter("chunks > 1").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))))
    group = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return whole.unionAll(split.select(group.alias("group"), side.alias("side"), "value", "own"))


def link(prints: DataFrame) -> DataFrame:
    """From ``doc_id, value`` (a stored frame) to ``value, first, component_id`` for every distinct fingerprint.

    The fingerprints are the vertices, with or without an id; ``first`` is the smallest of a component.
    """
    values = prints.groupBy("value").agg(F.min("doc_id").alias("own"))
    groups = _grouped(values.select("value", F.col("value").alias("own"))).repartition("group").sortWithinPartitions("group")
    found = components(groups.mapInPandas(_group_links, "a bigint, b bigint"))
    linked = values.join(found, F.col("value") == F.col("id"))
    names = linked.groupBy("component").agg(F.min("own").alias("smallest"))
    named = found.join(names, "component")
    return values.join(named, F.col("value") == F.col("id"), "left").select(
        "value", F.coalesce("component", "value").alias("first"),
        F.when(F.col("id").isNull(), F.col("own")).otherwise(F.col("smallest")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    return _linked(docs, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, whole, value, first, component_id`` of each document; ``whole`` is the hash of its text."""
    rows = id_and_text(docs, id_col, text_col)
    prints = store(rows.select("doc_id", F.xxhash64("text").alias("whole"), fingerprint_of(F.col("text")).alias("value")),
                   folder(docs.sparkSession, "prints"))
    return prints.join(link(prints), "value")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component, with all their columns. Rows with one id stay or go together.

    A component of null ids alone keeps one row.
    """
    found = _linked(docs, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    identified = docs.filter(F.col(f"`{id_col}`").isNotNull()).join(gone, id_col, "left_anti")
    stays = found.filter("doc_id IS NULL AND component_id IS NULL").groupBy("first").agg(F.min("whole").alias("whole__"))
    nameless = docs.filter(F.col(f"`{id_col}`").isNull())
    name = free_name(docs, "whole__")
    kept = nameless.join(stays.select(F.col("whole__").alias(name)), F.xxhash64(F.col(f"`{text_col}`")) == F.col(name), "left_semi")
    return identified.unionByName(kept.dropDuplicates([text_col])).select(*[f"`{column}`" for column in docs.columns])
