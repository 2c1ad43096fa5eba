import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidescore.llm import bpe
from tidescore.llm.bpe import Encoder, encode_and_decode, encoded_digests, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH),
                             special_tokens={})


def test_words_against_the_library(plain):
    choose = random.Random(4)
    words = ["a" * n for n in (1, 2, 3, 63, 64, 65, 66, 131, 1000)] + ["ab" * 90, "tion" * 40, "éà" * 50, "=" * 77]
    words += ["".join(choose.choices("etaoinshrdlu", k=choose.randint(1, 150))) for _ in range(150)]
    words += ["".join(choose.choices("的我你他们是在中国人民", k=choose.randint(1, 90))) for _ in range(40)]
    for word, (n, ids, decoded) in zip(words, Encoder(PATH).encode(words)):
        expected = plain.encode_ordinary(word)
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)), word.encode())


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_documents_round_trip(documents_small, plain):
    texts = {row.doc_id: row.text for row in documents_small.collect()}
    for row in encoded_digests(documents_small).collect():
        ids = plain.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == digest(" ".join(map(str, ids)).encode())
        assert row.decoded_sha256 == digest(texts[row.doc_id].encode())


def test_odd_rows(docs_of, odd, plain):
    docs = docs_of(odd).withColumnRenamed("source", "ids")
    found = sorted(encode_and_decode(docs).collect())
    assert [row.doc_id for row in found] == list(range(1, len(odd) + 1))
    for row, text in zip(found, odd):
        ids = plain.encode_ordinary(text or "")
        assert (row.n_tokens, row.ids, row.decoded) == (len(ids), " ".join(map(str, ids)), (text or "").encode())
    assert encoded_digests(docs.limit(0)).count() == 0


def test_remembered_words_are_those_encoded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    choose, encoder, asked = random.Random(9), Encoder(PATH), []
    words = ["".join(choose.choices("etaoin", k=choose.randint(1, 9))) for _ in range(60)] + ["x" * 300]
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda new: asked.extend(new) or encode(new))
    expected = dict(zip(words, encode(words)))
    for _ in range(30):
        some = set(choose.sample(words, 12))
        assert encoder.look_up(some) == {word: expected[word] for word in some}
        assert len(encoder.known) <= 20 + 12 and "x" * 300 not in encoder.known
    assert 60 < len(asked) < 30 * 12


def test_ids_and_bytes_come_from_one_ordered_list():
    """An ordered aggregate for each result sorted every word's tokens twice."""
    for form in (bpe.SHORT_WORDS, bpe.LONG_WORDS):
        assert bpe.WORDS.format(tokens=form).count("ORDER BY place)") - form.count("ORDER BY place)") == 1
    words = ["unbelievable" * 3, "a", "é", "x" * 500, " 12345"]
    for word, (n, ids, decoded) in zip(words, Encoder(PATH).encode(words)):
        assert decoded == word.encode() and n == len(ids.split(" "))


def test_a_word_is_remembered_over_hundreds_of_thousands_of_others(monkeypatch):
    """Most new words of a task stood in earlier tasks, far back."""
    encoder, asked = Encoder(PATH), []
    monkeypatch.setattr(encoder, "encode", lambda new: asked.extend(new) or [(1, "0", b"") for _ in new])
    encoder.look_up({"first"})
    for start in range(0, 600_000, 20_000):
        encoder.look_up({str(k) for k in range(start, start + 20_000)})
    assert len(asked) == 600_001
    encoder.look_up({"first", "0"})
    assert len(asked) == 600_001


def test_results_of_words_are_joined_by_document(docs_of, plain):
    texts = ["one two one", "", None, "two", "one"]
    rows = encode_and_decode(docs_of(texts)).collect()
    assert [(row.n_tokens, row.ids, row.decoded) for row in sorted(rows)] == [
        (len(ids := plain.encode_ordinary(text or "")), " ".join(map(str, ids)), (text or "").encode()) for text in texts]
