import numpy as np
import pytest

from tidescore.llm.language import (PIECE, LanguageModel, fit_language, identify_language, keep_identified,
                                    predictions, subwords)


@pytest.fixture(scope="module")
def documents_tenth(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents_tenth):
    return fit_language(documents_tenth)


def test_held_out_accuracy(documents_tenth):
    found = predictions(documents_tenth).join(documents_tenth.select("doc_id", "lang"), "doc_id").collect()
    held_out = [row for row in found if row.held_out]
    assert len(found) == 1000 and 200 < len(held_out) < 300
    assert np.mean([row.lang == row.lang_pred for row in held_out]) > 0.98
    assert np.mean([row.accepted for row in held_out]) > 0.99
    assert all(0 <= row.score <= 1 for row in found)


def test_subwords():
    def grams(text):
        data = b" " + text.encode() + b" "
        return sum(1 for n in (2, 3, 4) for i in range(len(data) - n + 1) if b" " not in data[i + 1:i + n - 1]
                   and not (data[i] == data[i + n - 1] == 32))

    def count(text):
        return sum(len(found) for found in subwords(text))

    for text in ("a", "ab cd", "é ß", "word " * 50):
        assert count(text) >= grams(text.strip()) - text.count(" ") * 3
    assert count("") == 0 and count("ab1cd") == count("ab cd") == count("AB.CD")
    long = "some words here " * (PIECE // 8)
    assert count(long) == pytest.approx(count("some words here ") * (PIECE // 8), rel=0.01)


def test_unknown_texts_are_rejected(model):
    for text in (None, "", "  ", "1234 !?", "\n\n"):
        assert model.predict(text) == ("und", 0.0, False)
    assert model.predict("привет мир это текст" * 3)[1] < 0.999
    assert LanguageModel([], np.zeros((1, 0)), np.zeros(0), 1.0, 1.0).predict("text") == ("und", 0.0, False)


def test_odd_rows(docs_of, odd, model):
    docs = docs_of([*odd, (None, "the text and the words")]).withColumnRenamed("n_chars", "Language")
    found = identify_language(docs, model)
    assert found.columns == [*docs.columns, "language_"] and found.count() == len(odd) + 1
    assert keep_identified(docs, model).columns == docs.columns
    assert [row.lang_pred for row in predictions(docs_of(["a text"], lang=None)).collect()] == ["und"]
    assert predictions(docs_of(["a text"]).limit(0)).count() == 0
    one = predictions(docs_of(["some text", "some text", "other words", None])).collect()
    assert [row.lang_pred for row in sorted(one)] == ["en", "en", "en", "und"]
