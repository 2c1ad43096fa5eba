import re
from collections import Counter

from tidescore.llm.quality import counts, quality, remove_frequent_lines, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def line_name(line):
    return re.sub(r"\d+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))


def test_counts(documents_small, odd):
    for text in [*odd, *(row.text for row in documents_small.collect()), "a b c a b c", "a a a a", "x y z\x1cq"]:
        assert counts(text) == plain_counts(text)


def test_repeated_words_with_very_many_words():
    words = [b"%d" % k for k in range(1 << 21)] + [b"0", b"1", b"2", b"x"]
    assert repeated_words(words) == 6


def test_verdicts_against_plain_rules(documents_small):
    rows = documents_small.collect()
    hosts, having = Counter(row.source for row in rows), Counter()
    for row in rows:
        having.update({(row.source, line_name(line)) for line in row.text.split("\n") if WORD.search(line)})
    for found in quality(documents_small, most_documents=2, most_share=0.05, least_left=0.5).collect():
        row = next(row for row in rows if row.doc_id == found.doc_id)
        n = having
        gone = sum(len(WORD.findall(line)) for line in row.text.split("\n") if WORD.search(line)
                   and n[row.source, line_name(line)] > max(2, 0.05 * hosts[row.source]))
        expected = plain_counts(row.text)
        assert tuple(found)[1:6] == expected and found.n_removed_words == gone
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert found.base_failed == failed
        assert found.kept == (not failed and expected[0] - gone >= 0.5 * expected[0])


def test_lines_are_removed_per_host(spark):
    texts = [(k, f"Page {k} of 9\nown words number {'abcdefghijklmnop'[k]} here\n\n  page 7  OF 1") for k in range(12)]
    docs = spark.createDataFrame([(k, text, "a" if k < 10 else "b") for k, text in texts], "doc_id int, text string, source string")
    found = {row.doc_id: (row.text, row.n_removed_words) for row in remove_frequent_lines(docs).collect()}
    assert found[3] == ("own words number d here\n", 8) and found[11] == (texts[11][1], 0)


def test_odd_rows(docs_of, odd):
    docs = docs_of([*odd, (None, "word " * 60), (None, "word " * 60)]).withColumnsRenamed({"lang": "kept", "n_chars": "row"})
    found = quality(docs).collect()
    assert len(found) == len(odd) + 2
    by_id = {row.doc_id: row for row in found}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[None].n_words == 60 and by_id[None].base_failed
    assert quality(docs.limit(0)).count() == 0
    assert quality(docs_of(["a b"], source=None)).first().n_words == 2
    copies = quality(docs_of([(7, "same words " + " ".join(map(str, range(100))))] * 30)).collect()
    assert len(copies) == 30 and all(row.kept and row.n_removed_words == 0 for row in copies)
