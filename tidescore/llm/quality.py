"""Quality rules: counts over a text's words and lines, and how often its lines occur on the same host.

Lines are normalised (lower case, single spaces, every number a zero) and hashed. For each host and line the
distinct documents are counted. Lines in more than ``most_documents`` documents and more than ``most_share`` of the
host's documents are removed, and a document is depleted if less than ``least_left`` of its words remain. Only hashes
are shuffled, and counts combine before that; adaptive execution can split a line that very many documents share.

Edge cases: a null text counts as empty; it has no words, fails the base rule and is not kept. A null host is a
host of its own. Rows that share an id are one document where documents are counted, and each gets its own counts
and verdict; rows that are equal get equal ones. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import folder, store

MOST_DOCUMENTS, MOST_SHARE, LEAST_LEFT = 8, 0.01, 0.3
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of the words
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list[bytes]) -> int:
    """Words that are part of a run of three that occurs twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.uint64)
    base = np.uint64(len(number))
    if len(number) < 1 << 21:
        runs = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # the number of a run of two, then of three, so that no product passes 64 bits
        runs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1].astype(np.uint64) * base + ids[2:]
    _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
    again, inside = times[which] > 1, np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= again
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()  # of bytes: at ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def counts_of(text: Column) -> Column:
    @F.pandas_udf(COUNTS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in COUNTS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([counts(value) for value in texts], columns=names, dtype="int64")
    return apply(text)


def lines_of(text: Column) -> Column:
    """For each line of a text its hash, null if it has no word, and the number of its words."""
    def described(line):
        normal = F.regexp_replace(F.regexp_replace(F.trim(F.lower(line)), r"[\x20\x09-\x0D]+", " "), r"\p{Nd}+", "0")
        words = F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda word: word != "")).cast("bigint")
        return F.struct(F.when(words > 0, F.xxhash64(normal)).alias("line"), words.alias("words"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), described)


def frequent_lines(rows: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """From ``doc_id, host, lines`` to the ``host, line`` of the lines above both limits, stored."""
    hosts = rows.groupBy("host").agg(F.count_distinct("doc_id").alias("n_documents"))
    lines = rows.select("doc_id", "host", F.explode("lines.line").alias("line")).filter("line IS NOT NULL")
    found = lines.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") > most_documents)
    found = found.join(hosts, "host").filter(F.col("n") > most_share * F.col("n_documents"))
    return store(found.select("host", "line"), folder(rows.sparkSession, "frequent_lines"))


def _described(docs: DataFrame, host_col: str, id_col: str, text_col: str) -> DataFrame:
    """Id and text of a row, hashes of its host and of itself, and its lines."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    host = F.col(f"`{host_col}`").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(host.isNull(), host).alias("host"),
                       F.xxhash64(doc_id, host.isNull(), host, text).alias("row"), lines_of(text).alias("lines"))


def _bad_lines(rows: DataFrame, most_documents: int, most_share: float) -> DataFrame:
    """From stored rows of ``_described`` to ``row, bad``: the frequent lines of each row that has some."""
    frequent = frequent_lines(rows, most_documents, most_share)
    lines = rows.select("row", "host", F.explode("lines.line").alias("line")).filter("line IS NOT NULL")
    return (lines.join(frequent, ["host", "line"], "left_semi")
            .groupBy("row").agg(F.collect_set("line").alias("bad")))


def _with_removed(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows with ``bad`` and ``n_removed_words``, the words in these lines."""
    inside = F.filter("lines", lambda line: F.array_contains("bad", line["line"]))
    removed = F.aggregate(inside["words"], F.lit(0).cast("bigint"), lambda total, words: total + words)
    return rows.join(bad, "row", "left").withColumn(
        "n_removed_words", F.when(F.col("bad").isNull(), F.lit(0).cast("bigint")).otherwise(removed))


def remove_frequent_lines(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                          most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """Three columns: the id, the text that is left without frequent lines, and ``n_removed_words``."""
    rows = _described(docs, host_col, id_col, text_col)
    stored = store(rows.drop("text"), folder(docs.sparkSession, "lines"))
    rows = _with_removed(rows, _bad_lines(stored, most_documents, most_share))
    both = F.zip_with(F.split("text", "\n"), "lines",
                      lambda text, found: F.struct(text.alias("text"), found["line"].alias("line")))
    left = F.filter(both, lambda line: line["line"].isNull() | ~F.array_contains("bad", line["line"]))
    cleaned = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(left["text"], "\n"))
    return rows.select("doc_id", cleaned.alias("text"), "n_removed_words")


def quality(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
            most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT
            ) -> DataFrame:
    """A row per document: its id, the counts, ``base_failed``, ``kept`` and ``n_removed_words``.

    ``base_failed`` holds for texts with under 50 words, and for those of whose words over 50 percent are in
    repeated runs of three. ``kept`` also needs that the document is not depleted.
    """
    rows = _described(docs, host_col, id_col, text_col).withColumn("counts", counts_of(F.col("text"))).drop("text")
    rows = store(rows, folder(docs.sparkSession, "lines"))
    found = _with_removed(rows, _bad_lines(rows, most_documents, most_share)).select(
        F.col("doc_id").cast("bigint"), "counts.*", "n_removed_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < least_left * F.col("n_words")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")
