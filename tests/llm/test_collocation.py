import random
import re
from collections import Counter, defaultdict

import pytest

from tidescore.llm.collocation import collocations


def brute(rows, least, first=2000):
    """Over (lang, text): every phrase counted where it stands."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda letter: letter[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i:i + k])] += 1
    found = []
    for lang, own in counts.items():
        candidates = {phrase: a for phrase, a in own.items() if len(phrase) > 1 and a >= least}
        scored = []
        for phrase, a in candidates.items():
            cuts = [(2000000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            inside = any(len(other) > len(phrase) and 100 * b >= 80 * a
                         and any(other[i:i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
                         for other, b in candidates.items())
            if not inside:
                scored.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize("seed", range(3))
def test_against_counting_each_phrase(spark, seed):
    choose = random.Random(seed)
    words = ["the", "The", "a", "b", "New", "york", "city", "été", "ÉTÉ", "x\x00y", "日本", "\xa0", "w1", "w2"]
    seps = [" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!", "\x0b", "\x1c"]
    rows = []
    for _ in range(120):
        text = "".join(choose.choice(words) + choose.choice(seps) for _ in range(choose.randint(0, 60)))
        rows.append((choose.choice(["en", "en", "de", None, "und"]), text + " new york city hall" * choose.randint(0, 2)))
    found = collocations(frame(spark, rows), least=6, text_bytes=3000)
    expected = brute(rows, 6)
    assert len(expected) > 30
    assert sorted(map(tuple, found.collect())) == expected
    assert sorted(map(tuple, collocations(frame(spark, rows), least=6, first=5).collect())) == brute(rows, 6, 5)


def test_few_bits_change_nothing(spark):
    """With all runs under few hashes windows are only longer."""
    choose = random.Random(9)
    rows = [("en", " ".join(choose.choice("abcdefg") for _ in range(50))) for _ in range(20)]
    expected = brute(rows, 5)
    for bits in (28, 15, 4):
        assert sorted(map(tuple, collocations(frame(spark, rows), least=5, run_bits=bits).collect())) == expected


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, "end of it", "end of it."] * 20).withColumnsRenamed({"source": "words", "n_chars": "n"})
    found = collocations(docs)
    assert sorted(map(tuple, found.collect())) == brute([("en", row.text) for row in docs.collect()], 30)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(frame(spark, [(None, None), ("en", None)])).count() == 0
