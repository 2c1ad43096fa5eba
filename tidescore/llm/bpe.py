"""Byte-level BPE encoding and decoding by recursive SQL, run by DuckDB inside each Spark task.

The pieces of a text (each match of the split pattern) are encoded apart. A Python worker keeps the frequent ones that
it has encoded, a bounded number, for its later tasks as well; any other piece is encoded where it stands. Its bytes become rows of word, position and token. In a round of the recursive query, neighbouring rows
join the merge table, the leftmost pair of the lowest rank in each word is contracted to one row, and words without
such a pair leave the recursion. For long words a second form contracts, in one round, as many pairs of the lowest
rank from the left as the plain form would contract one after another: up to and with the first whose
contraction makes a pair of lower rank. Decoding joins the tokens with the vocabulary and aggregates their bytes
in order.

The merge table holds every pair of entries whose bytes together are an entry; its rank is that entry's.

Edge cases: a null text counts as empty and has no tokens. Repeated rows get the same result; an empty table gives an
empty result. Texts are read whole; a worker holds a bounded number of words at once, and long ones only for a
batch, so only a single piece of a text needs memory in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tidescore.llm.common import id_and_text

# Words of more bytes than this take the form that contracts several pairs in a round.
LONG = 64
# Bytes of words in one query, documents looked at together, and encoded words that a worker remembers, up to twice.
QUERY_BYTES, DOCUMENTS, REMEMBERED = 400_000, 500, 400_000
# Characters of the longest word that is remembered.
LONGEST = 256
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# place: word * 2**32 + position, the positions of a word without gaps.
SHORT_WORDS = """
WITH RECURSIVE step AS (
  SELECT place, token, false AS done FROM start
  UNION ALL
  SELECT s.place - coalesce((s.place > b.place)::BIGINT, 0) AS place,
         CASE WHEN s.place = b.place THEN b.rank ELSE s.token END AS token, b.place IS NULL AS done
  FROM step s LEFT JOIN (
    SELECT best.rank_place // 4294967296 AS rank, best.word * 4294967296 + best.rank_place % 4294967296 AS place, word
    FROM (SELECT a.place >> 32 AS word, min(rank::BIGINT * 4294967296 + (a.place & 4294967295)) AS rank_place
          FROM step a JOIN step c ON c.place = a.place + 1 JOIN merges ON l = a.token AND r = c.token
          WHERE NOT a.done AND NOT c.done GROUP BY 1) best) b ON b.word = s.place >> 32
  WHERE NOT s.done AND (b.place IS NULL OR s.place <> b.place + 1)
)
SELECT place, token FROM step WHERE done"""

LONG_WORDS = """
WITH RECURSIVE step AS (
  SELECT place, token, false AS done FROM start
  UNION ALL
  SELECT place - gone_before AS place, CASE WHEN hit THEN best ELSE token END AS token, best IS NULL AS done
  FROM (
    SELECT *, coalesce(sum(gone::BIGINT) OVER (PARTITION BY word ORDER BY place), 0)::BIGINT AS gone_before FROM (
      SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY place), false) AS gone FROM (
        SELECT *, free AND coalesce(sum(lower::BIGINT) OVER (
          PARTITION BY word ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS hit FROM (
          SELECT q.*, free AND (coalesce(x.rank < best, false) OR coalesce(y.rank < best, false)) AS lower FROM (
            SELECT *, CASE WHEN lag(free, 2) OVER (PARTITION BY word ORDER BY place) THEN best ELSE before END AS onleft
            FROM (
              SELECT *, at_best AND row_number() OVER (PARTITION BY word, at_best, island ORDER BY place) % 2 = 1 AS free
              FROM (
                SELECT *, place - sum(at_best::BIGINT) OVER (PARTITION BY word ORDER BY place) AS island FROM (
                  SELECT *, coalesce(rank = best, false) AS at_best FROM (
                    SELECT p.*, rank, min(rank) OVER (PARTITION BY word) AS best FROM (
                      SELECT place, token, place >> 32 AS word, lag(token) OVER w AS before,
                             lead(token) OVER w AS after, lead(token, 2) OVER w AS second
                      FROM step WHERE NOT done WINDOW w AS (PARTITION BY place >> 32 ORDER BY place)) p
                    LEFT JOIN merges ON l = token AND r = after))))) q
          LEFT JOIN merges x ON x.l = onleft AND x.r = best LEFT JOIN merges y ON y.l = best AND y.r = second))))
  WHERE NOT gone
)
SELECT place, token FROM step WHERE done"""

# One ordered list for each word, from which both results are read.
WORDS = """
SELECT word, len(found) AS n, array_to_string(list_transform(found, lambda x: x.token), ' ') AS ids,
       unhex(array_to_string(list_transform(found, lambda x: x.entry), '')) AS decoded
FROM (SELECT place >> 32 AS word, list({{'token': token, 'entry': entry}} ORDER BY place) AS found
      FROM ({tokens}) JOIN vocabulary USING (token) GROUP BY 1)"""


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Left, right and rank of every pair of entries that makes an entry."""
    return [(ranks[entry[:cut]], ranks[entry[cut:]], rank) for entry, rank in ranks.items()
            for cut in range(1, len(entry)) if entry[:cut] in ranks and entry[cut:] in ranks]


class Encoder:
    """Encodes pieces of text in an in-memory database with one thread."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        left, right, rank = (np.array(column, np.int32) for column in zip(*merge_rows(ranks)))
        merges = pa.table({"l": left, "r": right, "rank": rank})
        vocabulary = pa.table({"token": np.fromiter(ranks.values(), np.int32),
                               "entry": [entry.hex() for entry in ranks]})
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.byte = np.array([ranks[bytes([value])] for value in range(256)], np.int32)
        self.database = duckdb.connect(config={"threads": 1, "memory_limit": "4GB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.database.register("rows", rows)
            self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.database.unregister("rows")

    def look_up(self, words: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """``encode`` of each word, from memory where an earlier call had it."""
        if len(self.known) > REMEMBERED:  # what is still in use comes back from the older half
            self.known, self.older = {}, self.known
        missing = words.difference(self.known)
        again = missing.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(missing - again)
        encoded = dict(zip(new, self.encode(new)))
        self.known.update(encoded)
        found = dict(zip(words, map(self.known.__getitem__, words)))
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        return found

    def encode(self, words: list[str]) -> list[tuple[int, str, bytes]]:
        """For each word the number of its tokens, their ids as text, and what they decode to."""
        data = [word.encode() for word in words]
        found: list = [None] * len(words)
        for query, chosen in ((SHORT_WORDS, [i for i, word in enumerate(data) if len(word) <= LONG]),
                              (LONG_WORDS, [i for i, word in enumerate(data) if len(word) > LONG])):
            start = 0
            while start < len(chosen):
                end, size = start, 0
                while end < len(chosen) and (end == start or size + len(data[chosen[end]]) <= QUERY_BYTES):
                    size, end = size + len(data[chosen[end]]), end + 1
                for word, n, ids, decoded in self._run(query, [data[i] for i in chosen[start:end]]):
                    found[chosen[start + word]] = (n, ids, decoded)
                start = end
        return found

    def _run(self, query: str, data: list[bytes]) -> Iterator[tuple[int, int, str, bytes]]:
        sizes = np.array([len(word) for word in data])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = (np.repeat(np.arange(len(data)), sizes) << 32) + np.arange(sizes.sum()) - first
        token = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        self.database.register("start", pa.table({"place": place, "token": token}))
        result = self.database.sql(WORDS.format(tokens=query)).to_arrow_table()
        self.database.unregister("start")
        return zip(*(result.column(name).to_pylist() for name in ("word", "n", "ids", "decoded")))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                      pattern: str | None = None) -> DataFrame:
    """A row per document: ``doc_id``, the ids as text (joined by a space), their number, and the decoded bytes."""
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _task(path, pattern, _whole), "doc_id bigint, n_tokens bigint, ids string, decoded binary")


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                    pattern: str | None = None) -> DataFrame:
    """The same with digests of the ids and of the decoded bytes in their place."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_task(path, pattern, _digests), RESULT)


def _whole(doc_ids, counts, ids, decoded) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())],
        ["doc_id", "n_tokens", "ids", "decoded"])


def _digests(doc_ids, counts, ids, decoded) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(counts, pa.int64()),
         pa.array([hashlib.sha256(text.encode()).hexdigest() for text in ids], pa.string()),
         pa.array([hashlib.sha256(data).hexdigest() for data in decoded], pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _joined(values: pa.Array, ends: np.ndarray, between: str | bytes) -> list:
    """For each document its words' results, one after the other."""
    listed = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values)
    return pc.binary_join(listed, pa.scalar(between, values.type)).to_pylist()


def _task(path: str | None, pattern: str | None, result):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        split = regex.compile(pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(start, DOCUMENTS)
                pieces = [split.findall(text) if text else [] for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, pieces)])
                # Arrow tells the words apart and joins their results, so Python looks at each distinct word only once.
                flat = pa.array(chain.from_iterable(pieces), pa.large_string()).dictionary_encode()
                words = flat.dictionary.to_pylist()
                n, text, data = zip(*map(encoder.look_up(set(words)).__getitem__, words)) if words else ((), (), ())
                before = np.concatenate(([0], np.cumsum(np.array(n, np.int64)[flat.indices.to_numpy()])))
                counts = before[ends[1:]] - before[ends[:-1]]
                ids, decoded = (_joined(pa.array(values, kind).take(flat.indices), ends, between) for values, kind, between in
                                ((text, pa.large_string(), " "), (data, pa.large_binary(), b"")))
                yield result(part.column(0), counts, ids, decoded)
    return run
