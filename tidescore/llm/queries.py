"""The registered queries of this subpackage. Each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidescore.llm import (
    balanced,
    bpe,
    collocation,
    language,
    lines,
    packing,
    quality,
    ranked,
    search,
    secrets,
    simhash,
    toxicity,
    training_order,
)
from tidescore.llm.common import documents, folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(documents(spark, sf_dir))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


@query
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


@query
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each sequence in the shards, which are written below the shared folder."""
    return training_order.write_shards(documents(spark, sf_dir), folder(spark, "shards"), key=20240229)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


@query
def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, by its whole text."""
    docs = documents(spark, sf_dir)
    return search.top_k(docs, docs.filter("doc_id % 20 = 0"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    return ranked.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op12_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.balanced(documents(spark, sf_dir))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(documents(spark, sf_dir))


ORACLES["op9_quality_rules"] = r"""
    WITH docs AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
                  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
    runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
             FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
    again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM runs, range(3) AS three(k) WHERE times > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words,
                     regexp_replace(regexp_replace(trim(lower(line)), '[\x20\x09-\x0D]+', ' ', 'g'), '\p{Nd}+', '0', 'g')
                       AS name
              FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs)),
    repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n_words > 0 GROUP BY doc_id),
    hosts AS (SELECT source, count(DISTINCT doc_id) AS n_docs FROM docs GROUP BY source),
    frequent AS (SELECT source, name FROM lines JOIN hosts USING (source) WHERE n_words > 0
                 GROUP BY source, name, n_docs
                 HAVING count(DISTINCT doc_id) > 8 AND count(DISTINCT doc_id) > 0.01 * n_docs),
    removed AS (SELECT doc_id, sum(n_words) AS n FROM lines JOIN frequent USING (source, name) GROUP BY doc_id),
    counted AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: len(w))), 0) AS word_chars,
                       len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(repeated.n, 0) AS n_dup_lines,
                       coalesce(again.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
                FROM docs LEFT JOIN repeated USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN removed USING (doc_id))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept,
           CAST(n_removed_words AS BIGINT) AS n_removed_words
    FROM counted"""


ORACLES["op11_ranked_search"] = r"""
    WITH words AS (
      SELECT row_id, doc_id, term, count(*) AS tf FROM (
        SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)) GROUP BY ALL),
    docs AS (SELECT row_id, CAST(sum(tf) AS BIGINT) AS n FROM words GROUP BY row_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
    lengths AS (SELECT row_id, 50 + (50 * n * docs) // terms AS m FROM docs, whole),
    items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
                FROM words, whole GROUP BY term, docs),
    scores AS (SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
               FROM items JOIN weights USING (term) JOIN words USING (term) JOIN lengths USING (row_id) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 50"""

ORACLES["op13_collocations"] = r"""
    WITH pieces AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
    counts AS (
      SELECT lang, words[i:i + k - 1] AS words, k, CAST(count(*) AS HUGEINT) AS n
      FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces), range(1, 5) AS sizes(k)
      WHERE i + k - 1 <= len(words) GROUP BY 1, 2, 3),
    totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
    candidates AS (SELECT lang, words, k, n AS a FROM counts WHERE k > 1 AND n >= 30),
    cuts AS (
      SELECT c.lang, c.words, c.k, a, cut, l.n AS l, r.n AS r, 2000000 * a // (l.n + r.n) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
      JOIN counts l ON l.lang = c.lang AND l.words = c.words[:cut] JOIN counts r ON r.lang = c.lang AND r.words = c.words[cut + 1:]),
    worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
    inner_phrases AS (
      SELECT lang, words[i:i + size - 1] AS words, max(a) AS most
      FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)) GROUP BY 1, 2),
    kept AS (SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM worst w LEFT JOIN inner_phrases USING (lang, words)
             WHERE coalesce(100 * most < 80 * a, true))
    SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
           CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    JOIN totals USING (lang) WHERE rank <= 2000"""
