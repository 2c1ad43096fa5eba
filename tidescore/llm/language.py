"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is lower-cased, what is no letter becomes a space, and the subwords are the runs of two to four UTF-8
bytes that have a space at most at their ends. Each subword is hashed to a row of an embedding table; the rows of
a text are averaged and go through a linear layer and a softmax. A temperature fitted on rows kept out of the
training calibrates the probabilities, and the acceptance threshold is set on the same rows.

Edge cases: a null text, and one without a letter, gets ``und``, score 0 and is rejected. Empty tables give empty
results. Without a labelled row to learn from every text is ``und``. Repeated rows are scored alike; equal scores
of two languages give the alphabetically first. Long texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import free_name, remainder, sample_by_class

BITS = 13
SIZES = (2, 3, 4)
DIMENSIONS = 16
# Rows that the model may learn from, about; the only bound on data in this operator.
MAX_ROWS = 3000
# Bytes that one pass of the feature code holds at most.
PIECE = 1 << 20
UNKNOWN = "und"
RESULT = "lang_pred string, score double, accepted boolean"

LETTER = re.compile(r"[^\W\d_]")
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _pieces(text: str) -> Iterator[np.ndarray]:
    data = b" " + text.lower().encode("utf-8", "ignore").translate(LETTERS_ONLY) + b" "
    overlap = max(SIZES) - 1
    for start in range(0, max(1, len(data) - overlap), PIECE):
        yield np.frombuffer(data[start:start + PIECE + overlap], np.uint8)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's subwords, a piece at a time. A subword on a border is in one piece only."""
    for data in _pieces(text):
        wide, space = data.astype(np.uint32), data == 32
        for n in SIZES:
            count = min(len(data) - n + 1, PIECE)
            if count < 1:
                continue
            key, inner = wide[:count].copy(), space[:count] & space[n - 1:n - 1 + count]
            for k in range(1, n):
                key |= wide[k:k + count] << np.uint32(8 * k)
                if k < n - 1:
                    inner |= space[k:k + count]
            hashed = (key * np.uint32(2654435761) + np.uint32(n * 97)) * np.uint32(2246822519)
            yield (hashed >> np.uint32(32 - BITS))[~inner]


def _frequencies(text: str) -> np.ndarray:
    counts = np.zeros(1 << BITS)
    for buckets in subwords(text):
        counts += np.bincount(buckets, minlength=1 << BITS)
    return counts / max(1.0, counts.sum())


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a row of logits for each bucket: the embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.table.take(buckets, axis=0).sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        chances = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(chances.argmax())
        return self.languages[best], float(chances[best]), bool(chances[best] >= self.threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _train(x: np.ndarray, y: np.ndarray, n_classes: int, epochs: int, rate: float, batch: int = 32):
    """Plain minibatch SGD on the cross entropy; rows are weighted so that each class counts alike."""
    random = np.random.default_rng(7)
    embedding = random.normal(0, 0.1, (x.shape[1], DIMENSIONS)).astype(np.float32)
    linear, bias = np.zeros((DIMENSIONS, n_classes), np.float32), np.zeros(n_classes, np.float32)
    weight = len(y) / n_classes / np.maximum(1, np.bincount(y, minlength=n_classes))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(random.permutation(len(y)), max(1, len(y) // batch)):
            features, target = x[rows], y[rows]
            hidden = features @ embedding
            error = _softmax(hidden @ linear + bias)
            error[np.arange(len(rows)), target] -= 1
            error = (error * weight[target, None] / len(rows)).astype(np.float32)
            back = error @ linear.T
            linear -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            embedding -= step * 20 * features.T @ back
    return embedding @ linear, bias


def _dense(sample: pd.DataFrame) -> np.ndarray:
    found = np.zeros((len(sample), 1 << BITS), np.float32)
    for row, bucket, share in zip(found, sample["bucket"], sample["share"]):
        row[np.frombuffer(bucket, np.int32)] = np.frombuffer(share, np.float32)
    return found


def fit_language(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                 max_rows: int = MAX_ROWS, epochs: int = 30, rate: float = 2.0, rejected: float = 0.001
                 ) -> LanguageModel:
    """Learn from the rows with a label and a letter, or from about ``max_rows`` of them.

    A fifth of the sample is not trained on. It sets the temperature (least cross entropy) and the threshold:
    the score that a share of ``rejected`` of its rightly predicted texts does not reach, at most one half.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{label}`").cast("string").alias("label"))
    rows = sample_by_class(rows.filter("label IS NOT NULL AND text IS NOT NULL"), "label", "id", max_rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for label, text in zip(batch["label"], batch["text"]):
                counts = _frequencies(text)
                if counts.any():
                    used = counts.nonzero()[0]
                    found.append((label, used.astype(np.int32).tobytes(), counts[used].astype(np.float32).tobytes()))
            yield pd.DataFrame(found, columns=["label", "bucket", "share"])

    sample = rows.select("label", "text").mapInPandas(
        features, "label string, bucket binary, share binary").toPandas()
    languages = sorted(set(sample["label"]))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    order = [zlib.crc32(bytes(bucket) + bytes(share)) for bucket, share in zip(sample["bucket"], sample["share"])]
    sample = sample.assign(order=order).sort_values(["order", "label"], kind="stable").reset_index(drop=True)
    y = np.array([languages.index(value) for value in sample["label"]])
    n_trained = len(y) - (len(y) // 5 if len(y) >= 5 * len(languages) else 0)  # the order is by hash
    chosen = slice(n_trained, None) if n_trained < len(y) else slice(None)
    table, bias = _train(_dense(sample[:n_trained]), y[:n_trained], len(languages), epochs, rate)
    logits, target = _dense(sample[chosen]) @ table + bias, y[chosen]

    def loss(temperature):
        chances = _softmax(logits.astype(np.float64) / temperature)
        return -np.log(np.maximum(1e-12, chances[np.arange(len(target)), target])).mean()

    temperature = min((2.0 ** k for k in np.arange(-5, 3.25, 0.25)), key=loss)
    chances = _softmax(logits / temperature)
    right = chances.max(axis=1)[chances.argmax(axis=1) == target]
    threshold = min(0.5, float(np.quantile(right, rejected))) if len(right) else 0.5
    return LanguageModel(languages, table.astype(np.float32), bias.astype(np.float64), float(temperature), threshold)


def language_of(model: LanguageModel):
    """A column function from text to the struct of ``RESULT``."""
    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(text) for text in texts],
                               columns=["lang_pred", "score", "accepted"])
    return predict


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` and one more, ``language``: a struct of the prediction.

    If ``docs`` has a column of that name, underscores are added to the new one's.
    """
    return docs.withColumn(free_name(docs, "language"), language_of(model)(F.col(f"`{text_col}`")))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language the model accepts, with the columns they had."""
    name = free_name(docs, "language")
    return identify_language(docs, model, text_col).filter(f"{name}.accepted").select(*[f"`{c}`" for c in docs.columns])


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from: crc32 of the id modulo 4 is not 2."""
    return docs.filter(remainder(id_col, 4) != 2)


def predictions(docs: DataFrame) -> DataFrame:
    """A row per document: its id, whether it was held out, the predicted language, the score, the acceptance."""
    model = fit_language(training_rows(docs))
    rows = docs.select(F.col("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"),
                       language_of(model)(F.col("text")).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")
