import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidescore.llm.ranked import Queries, Shard, _shards, ranked, term_hashes, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda letter: letter[0].lower(), term) for term in TERM.findall(text or "")]


def brute(docs, items, k=50):
    """Over (id, text) rows: every document scored for every item."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(doc_id, own) for doc_id, own in counts if own]
    n_docs, total = len(counts), sum(sum(own.values()) for _, own in counts)
    df = Counter(term for _, own in counts for term in own)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    found = []
    for item_id, own_terms in asked.items():
        scored = []
        for doc_id, own in counts:
            m = 50 + 50 * sum(own.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1000000000 * own[t] // (1000 * own[t] + 20 * m)) for t in own_terms if own[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            found.append((item_id, rank, None if none else doc_id, -score))
    return sorted(found, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def some_text(choose, words, n):
    return "".join(choose.choice(words) + choose.choice([" ", " ", "-", "_", ". ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_against_scoring_all(spark, seed):
    choose = random.Random(seed)
    words = ["Ab", "ab", "é", "É", "日本", "x9", "\x80z"] + [f"w{int(choose.paretovariate(0.6))}" for _ in range(200)]
    docs = [(k, some_text(choose, words, int(choose.paretovariate(0.5)) % 900)) for k in range(400)]
    docs += [(k + 1000, "same same text") for k in range(100)] + [(7, "same same text")] * 3 + [(None, "same text"), (None, None)]
    items = [(k, some_text(choose, words, choose.randint(1, 40))) for k in range(12)] + [(50, "same"), (51, "text none such"), (52, "")]
    found = ranked(*frames(spark, docs, items), documents=64, block_terms=100)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)
    assert sorted(map(tuple, ranked(*frames(spark, docs, items), k=3).collect()), key=str) == brute(docs, items, 3)


def test_bounds_hold_and_exclude():
    """No bound is below the exact score, and together they are not far above."""
    choose = random.Random(4)
    docs = [(k, terms_of(" ".join(f"w{int(choose.paretovariate(0.8))}" for _ in range(choose.randint(1, 500))))) for k in range(300)]
    n_terms = sum(len(own) for _, own in docs)
    df = Counter(term for _, own in docs for term in set(own))

    class Row:
        def __init__(self, item_id, term):
            self.item_id, self.term, self.n = item_id, term, df[term]

    queries = Queries([Row(1, term) for term in sorted(df)[:40]] + [Row(2, term) for term in sorted(df)[20:23]], len(docs))
    names = {term: at for at, term in enumerate(queries.terms)}
    total = np.zeros(2)
    for row in _shards(docs):
        shard = Shard(row, len(docs), n_terms)
        bounds, numbers = shard.bounds(queries, term_hashes(queries.terms)), shard.term_numbers(names)
        for bound, listed, weights in zip(bounds, queries.lists, queries.weights):
            of_query = {number: value for number, value in zip(listed.tolist(), weights.tolist())}
            own = [of_query.get(number, 0) for number in numbers.tolist()]
            exact = shard.scores(np.arange(len(shard.lengths)), np.array(own, np.int64))
            assert (bound >= exact).all()
            total += [bound.sum(), exact.sum()]
    assert total[0] < 1.5 * total[1]


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, *odd]).withColumnsRenamed({"source": "score", "n_chars": "rank"})
    items = docs_of([*odd]).withColumnsRenamed({"doc_id": "item_id", "lang": "doc_id"})
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    assert sorted(map(tuple, ranked(docs, items).collect()), key=str) == brute(rows, [(k + 1, text) for k, text in enumerate(odd)])
    assert ranked(docs.limit(0), items).count() == 0 and ranked(docs, items.limit(0)).count() == 0
    both = spark.createDataFrame([(None, "word"), (None, "long"), (3, None), (4, "word"), (4, "word")], "item_id bigint, text string")
    assert sorted(map(tuple, ranked(docs, both).collect()), key=str) == brute(rows, [tuple(row) for row in both.collect()])
