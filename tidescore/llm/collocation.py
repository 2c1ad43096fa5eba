"""Collocations of two to four words, each language apart, counted from the longest windows alone.

A text is cut into pieces at punctuation and ends of lines, and those into words. A window is a word with the three
that follow it in its piece, padded with the empty text where the piece ends. Only such windows are counted. A phrase
of k words occurs where a window begins with it, so its count is the sum over the windows with that prefix, and
one ROLLUP over the four columns gives the counts of all phrases of one to four words, and of all words.

A phrase that occurs ``least`` times holds only shorter ones that do. Runs of two words are therefore first counted by hash,
in a bitmap of 2^28 bits of those that may be frequent, then runs of three whose pairs may be; a window is padded
already where the next word makes a run that is in none of them. This shortens windows, which makes far fewer different ones,
and changes no count that is asked for: a frequent run is always in its bitmap. The bitmaps have the same size for
any table; with more runs than bits they shorten fewer windows.

A cut of a phrase into two scores ``2000000 * a // (l + r)`` by the counts of the phrase and its parts, and the phrase has
the score of its worst cut. All of this is in decimals, which are exact beyond 64 bits.

Edge cases: a null text counts as empty, a null language as ``und``. Equal scores go by count, then by the phrase's bytes.
Repeated rows count each. An empty table gives an empty result, as does one without frequent phrases. Texts are read whole;
a task holds some megabytes of text at once, or one longer text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescore.llm.common import delete, folder, store

LEAST, FIRST, LONGEST = 30, 2000, 4
# An inner phrase goes if a longer one has this many percent of its occurrences.
COVERED = 80
# Bits of the hash of a run, bytes of text that are looked at together, parts of a language that are ranked apart.
RUN_BITS, TEXT_BYTES, PARTS = 28, 8 << 20, 128
# Bytes of Spark's bitmaps.
BITMAP = 4096
NAMES = [f"w{k}" for k in range(1, LONGEST + 1)]
WINDOWS = "lang string, " + ", ".join(f"{name} string" for name in NAMES) + ", n bigint"
EDGE = b"\xff"  # in no UTF-8 text


def _alphabet() -> bytes:
    """Bytes as they are compared: capital letters lowered, ends of pieces as one mark, tabs as spaces."""
    table = bytearray(range(256))
    for letter in range(ord("A"), ord("Z") + 1):
        table[letter] = letter + 32
    for mark in b".,;:!?\n\x0b\x0c\r":
        table[mark] = EDGE[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


ALPHABET = _alphabet()


class Words:
    """Numbered words of some texts of one language: 0 is the end of a piece."""

    def __init__(self, texts: list[str]):
        data = (EDGE + EDGE.join(text.encode() for text in texts) + EDGE).translate(ALPHABET)
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        numbers[EDGE] = 0
        tokens = data.replace(EDGE, b" " + EDGE + b" ").split()
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = [b"", *list(numbers)[1:]]

    def starts(self, lang: str, bits: int, often: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Where words are; for runs of 2, 3, ... words that start there whether they may be frequent, by these bitmaps;
        and the hashes of the runs of one word more, -1 for those that end a piece or hold a run that is not frequent.
        """
        own = np.fromiter((xxhash.xxh64_intdigest(word) for word in self.words), np.uint64, len(self.words))
        ids = np.concatenate((self.ids, np.zeros(LONGEST, np.int64)))
        n = len(self.ids)
        hashes = own[ids] ^ np.uint64(xxhash.xxh64_intdigest(lang, 1))
        fits, frequent = ids != 0, []
        for size in range(2, len(often) + 3):
            # A run is one word shorter and the word after it; it fits if both runs of the size before do.
            fits = np.append(fits[:-1] & fits[1:], False)
            word = np.append(own[ids[size - 1:]], np.zeros(size - 1, np.uint64))
            hashes = (hashes * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes ^= hashes >> np.uint64(31)
            code = np.where(fits, (hashes >> np.uint64(64 - bits)).astype(np.int64), -1)
            if size - 2 < len(often):
                fits = fits & (often[size - 2][code >> 3] >> (code & 7).astype(np.uint8) & 1).astype(bool)
                frequent.append(fits[:n])
        return np.nonzero(self.ids)[0], frequent, code[:n]

    def windows(self, at: np.ndarray, longer: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Different windows, as one array of word numbers for each column, and their counts.

        ``longer`` says for each start whether the window there has 2, 3 and 4 words.
        """
        code, parts, counts = self.ids[at], [], []
        columns = [np.arange(len(self.words))]  # words of the codes so far
        for k in range(LONGEST):
            ends = ~longer[k][at] if k < LONGEST - 1 else np.ones(len(at), bool)
            times = np.bincount(code[ends], minlength=len(columns[0]))
            there = np.nonzero(times)[0]
            counts.append(times[there])
            parts.append([column[there] for column in columns] + [np.zeros(len(there), np.int64)] * (LONGEST - k - 1))
            at, code = at[~ends], code[~ends]
            if not len(at):
                break
            different, code = np.unique(code * len(self.words) + self.ids[at + k + 1], return_inverse=True)
            before, word = np.divmod(different, len(self.words))
            columns = [column[before] for column in columns] + [word]
        return [np.concatenate(column) for column in zip(*parts)], np.concatenate(counts)


def _by_language(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[tuple[str, Words]]:
    """The texts of one language after another, as many together as ``text_bytes`` allows."""
    texts, sizes = defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            texts[lang].append(text)
            sizes[lang] += len(text) + 1
            if sum(sizes.values()) >= text_bytes:
                most = max(sizes, key=sizes.get)
                del sizes[most]
                yield most, Words(texts.pop(most))
    while texts:
        lang = next(iter(texts))
        yield lang, Words(texts.pop(lang))


def frequent_runs(texts: DataFrame, least: int, run_bits: int, text_bytes: int, shorter: Sequence[Broadcast]) -> np.ndarray:
    """The bitmap, as bytes, of the hashes under which at least so many runs lie. It has ``2 ** run_bits`` bits.

    The runs are of two words, or one more for each bitmap of shorter ones that is given.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_language(batches, text_bytes):
            hashes = words.starts(lang, run_bits, [bits.value for bits in shorter])[2]
            found, times = np.unique(hashes[hashes >= 0], return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["run", "n"])

    often = texts.mapInArrow(runs, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    number = F.col("run") + 1  # Spark's bitmaps count from 1
    maps = often.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    found = np.zeros(1 << (run_bits - 3), np.uint8)
    for row in maps.toLocalIterator():
        first = (row.part - 1) * BITMAP
        found[first:first + BITMAP] = np.frombuffer(bytes(row.bits), np.uint8)[:max(0, len(found) - first)]
    return found


def window_counts(texts: DataFrame, least: int, run_bits: int, text_bytes: int) -> DataFrame:
    """``lang, w1 .. w4, n``: the windows, padded with nulls, and how often each occurs."""
    often: list[Broadcast] = []
    for _ in range(LONGEST - 2):
        often.append(texts.sparkSession.sparkContext.broadcast(frequent_runs(texts, least, run_bits, text_bytes, often)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_language(batches, text_bytes):
            at, frequent, code = words.starts(lang, run_bits, [bits.value for bits in often])
            columns, times = words.windows(at, [*frequent, code >= 0])
            if len(times):
                names = pa.array([None, *words.words[1:]], pa.binary()).cast(pa.string())
                langs = pa.array([lang]).take(pa.array(np.zeros(len(times), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [langs, *[names.take(pa.array(column)) for column in columns], pa.array(times, pa.int64())],
                    ["lang", *NAMES, "n"])

    return texts.mapInArrow(windows, WINDOWS).groupBy("lang", *NAMES).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """``lang, words, n``: all phrases of one to four words that occur so often, and each language's words as no words."""
    padded = windows.select("lang", *[F.coalesce(name, F.lit("")).alias(name) for name in NAMES], "n")
    rolled = padded.rollup("lang", *NAMES).agg(
        F.sum("n").alias("n"), F.grouping_id("lang", *NAMES).alias("rolled"))
    # The grouping number has a bit for each column that is summed over, the last column's the lowest.
    size = sum(F.when(F.col("rolled") < (1 << k), 1).otherwise(0) for k in range(LONGEST))
    last = F.coalesce(F.element_at(F.array(*NAMES), F.greatest(size, F.lit(1))), F.lit(""))
    # Prefixes that end in padding go before anything is summed, since this needs none of the sums.
    prefixes = rolled.filter(F.col("rolled") < 1 << LONGEST).filter((F.col("rolled") == (1 << LONGEST) - 1) | (last != ""))
    often = prefixes.filter((F.col("rolled") == (1 << LONGEST) - 1) | (F.col("n") >= least))
    return often.select("lang", F.slice(F.array(*NAMES), 1, size).alias("words"), "n")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def scored_phrases(counts: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, score`` by the lowest-scoring cut of each phrase of two words or more."""
    phrases = counts.filter(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")),
                             "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.filter(F.size("words") > 0).select("lang", F.col("words").alias(side), F.col("n").alias(name))
        cuts = cuts.join(part, ["lang", side])
    a, parts = _exact("a"), _exact("l") + _exact("r")
    cuts = cuts.withColumns({"a19": a * 2_000_000, "parts": parts}).withColumn("score", F.expr("a19 div parts"))
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "words", "a").agg(worst.alias("cut")).select("lang", "words", "a", "cut.*")


def not_inside(phrases: DataFrame) -> DataFrame:
    """The phrases without those that occur almost only inside a longer one."""
    longer = phrases.filter(F.size("words") > 2).select("lang", F.col("words").alias("all"), F.col("a").alias("most"))
    sizes = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("all") - 1)))
    inner = sizes.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)))
    inner = inner.select("lang", F.slice("all", F.col("first"), F.col("size")).alias("words"), "most")
    most = inner.groupBy("lang", "words").agg(F.max("most").alias("most"))
    covered = F.coalesce(_exact("most") * 100 >= _exact("a") * COVERED, F.lit(False))
    return phrases.join(most, ["lang", "words"], "left").filter(~covered).drop("most")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 first: int = FIRST, run_bits: int = RUN_BITS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Each language's best phrases: ``lang, rank`` (from 1), ``phrase, a, l, r, n, score``.

    The counts of the phrases are stored in the shared folder, where the result reads them.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spark, path = docs.sparkSession, folder(docs.sparkSession, "windows")
    windows = store(window_counts(texts, least, run_bits, text_bytes), path)
    counts = store(phrase_counts(windows, least), folder(spark, "phrases"))
    delete(spark, path)
    totals = counts.filter(F.size("words") == 0).select("lang", "n")
    kept = not_inside(scored_phrases(counts)).withColumn("phrase", F.array_join("words", " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language may hold most phrases: the best of each of its parts are found first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for group in (["lang", "part"], ["lang"]):
        kept = kept if "part" in kept.columns else kept.withColumn("part", part)
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        kept = kept.withColumn("rank", place).filter(F.col("rank") <= first)
    return kept.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
