"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A text's words (lower-cased runs of letters and digits) are hashed to 32 bits, and each hash that enough of a
label's documents have, counted over all training rows, is a row of an embedding table; all others share the row of
the padding, which stays zero. The share of documents that is asked for bounds the table, whatever the number of rows. Filters over one, two and three neighbouring words slide over the whole text; each keeps its highest
activation, and a logistic layer makes the score of these. Everything is trained in numpy by minibatch Adam, with the
rarer label weighted up: in each round every task trains a copy of the network on all its rows, a batch of them in
memory, and the copies, of which only changed bits travel, are averaged block by block, weighted by their rows. Every labelled row is learned from; only
the network, its vocabulary and counts come to the driver.

The score is calibrated on the quarter of the rows, by a hash of their words, that is kept out of the training, from
counts of rounded outputs: a logistic curve is fitted to the raw outputs there, and
shifted so that 0.5 is where the F1 of the label is best. A threshold for each language is chosen in the same
way on that language's rows of the calibration set, where there are enough; the language decides only which
threshold applies, never the score.

Edge cases: null and empty texts, and texts without a word, are scored like a text of padding. Without a labelled
row, or with one label only, each score is that label's share (0 without any). Repeated rows score alike. Rows of
the label table without a document, and null labels, are not learned from; an id labelled twice counts twice. An
empty table gives an empty result. Long texts are scored in overlapping pieces, whose maxima are the text's.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidescore.llm.common import delete, folder, remainder, store
from tidescore.operators.skew import among_keys

DIMENSIONS, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
# Training documents of a label that a hash has to be in for a row of its own: at least so many, and one in so many.
LEAST_DOCUMENTS, ONE_IN = 3, 1500
# Training rows up to which there are more rounds; and the words of a row that one training step looks at.
FEW_ROWS, WINDOW = 6000, 4096
# Numbers of a network that are averaged together; steps of a raw output that calibration tells apart, of one unit.
NUMBERS, STEPS = 16384, 512
# Bits of the bitmap, as a power of two, by which texts without a label are left out before the join.
LABEL_BITS = 25
# Share of the words that a training step replaces by unknown ones, so that no single word decides.
DROPPED = 0.5
# Words whose activations are held at once when scoring.
PIECE = 1 << 16
# Calibration rows of a language, and toxic ones among them, for a threshold of its own.
LEAST_ROWS, LEAST_TOXIC = 100, 10
WORD = re.compile(r"[^\W_]+")


def word_hashes(text: str | None) -> np.ndarray:
    crc = zlib.crc32
    words = WORD.findall((text or "").lower())
    return np.fromiter((crc(word.encode("utf-8", "ignore")) for word in words), np.uint32, len(words))


def packed_words(text: str | None) -> bytes:
    """The words of a text, compressed: shorter than their hashes, which repeat less."""
    return zlib.compress(" ".join(WORD.findall((text or "").lower())).encode("utf-8", "ignore"), 6)


@F.pandas_udf(BinaryType())
def hashes_of_packed(packed: pd.Series) -> pd.Series:
    """The bytes of ``word_hashes`` from ``packed_words``."""
    words = (zlib.decompress(value) for value in packed)
    return pd.Series([np.array([zlib.crc32(word) for word in value.split(b" ")] if value else [], np.uint32).tobytes()
                      for value in words], dtype=object)


def table_rows(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows of the embedding table, with padding (row 0, like unknown words) for the widest filter at both ends."""
    edge = np.zeros(max(WIDTHS) - 1, np.int32)
    if not len(known):
        return np.concatenate([edge, np.zeros(len(hashes), np.int32), edge])
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.concatenate([edge, np.where(known[place] == hashes, place + 1, 0).astype(np.int32), edge])


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width, dimensions, filters
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def new(random: np.random.Generator, rows: int) -> Network:
        embedding = random.normal(0, 0.05, (rows, DIMENSIONS)).astype(np.float32)
        embedding[0] = 0
        return Network(embedding,
                       [random.normal(0, (width * DIMENSIONS) ** -0.5, (width, DIMENSIONS, FILTERS)).astype(np.float32)
                        for width in WIDTHS],
                       [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                       random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def prepare(self) -> Network:
        """The embedding and each filter's row multiplied once, so that scoring only looks up and adds."""
        self.tables = [np.stack([self.embedding @ rows for rows in filters]) for filters in self.filters]
        return self

    def raw(self, ids: np.ndarray) -> float:
        pooled = []
        for tables, bias, width in zip(self.tables, self.biases, WIDTHS):
            best = np.full(FILTERS, -np.inf, np.float32)
            for start in range(0, len(ids) - width + 1, PIECE):
                part = ids[start:start + PIECE + width - 1]
                count = len(part) - width + 1
                sums = tables[0].take(part[:count], axis=0)
                for k in range(1, width):
                    sums += tables[k].take(part[k:k + count], axis=0)
                best = np.maximum(best, sums.max(axis=0))
            pooled.append(np.maximum(best + bias, 0))
        return float(np.concatenate(pooled) @ self.out + self.out_bias)


class Training:
    """A network with the state of its training: Adam's moments, and for each row of the embedding the sum of squares."""

    def __init__(self, random: np.random.Generator, rows: int):
        self.net = Network.new(random, rows)
        self.moments = [(np.zeros_like(value), np.zeros_like(value)) for value in self.dense()]
        self.squares = np.full(rows, 1e-8, np.float32)
        self.step = 0

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, *self.net.biases, self.net.out]

    def arrays(self) -> list[np.ndarray]:
        return [self.net.embedding, *self.dense(), *[part for pair in self.moments for part in pair], self.squares]

    def numbers(self) -> np.ndarray:
        """Everything that tasks average, as one row of numbers."""
        return np.concatenate([*[value.ravel() for value in self.arrays()], [self.net.out_bias, self.step]])

    def take(self, numbers: np.ndarray) -> None:
        at = 0
        for value in self.arrays():
            value[...] = numbers[at:at + value.size].reshape(value.shape)
            at += value.size
        self.net.out_bias, self.step = float(numbers[at]), max(1, round(float(numbers[at + 1])))

    def learn(self, texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, rate: float,
              random: np.random.Generator) -> None:
        """Adam on the weighted logistic loss, once over the texts, a text at a time within small batches.

        Of a text longer than ``WINDOW`` words, each round looks at another window.
        """
        net, dense = self.net, self.dense()
        for batch in np.array_split(random.permutation(len(texts)), max(1, len(texts) // 16)):
            grads = [np.zeros_like(value) for value in dense]
            bias_grad, touched, changes = 0.0, [], []
            for row in batch:
                ids = texts[row]
                if len(ids) > WINDOW:
                    start = random.integers(0, len(ids) - WINDOW + 1)
                    ids = ids[start:start + WINDOW]
                ids = np.where(random.random(len(ids)) < DROPPED, 0, ids)
                vectors = net.embedding[ids]
                pooled, places = [], []
                for filters, bias, width in zip(net.filters, net.biases, WIDTHS):
                    count = len(ids) - width + 1
                    sums = vectors[:count] @ filters[0]
                    for k in range(1, width):
                        sums = sums + vectors[k:k + count] @ filters[k]
                    places.append(sums.argmax(axis=0))
                    pooled.append(sums[places[-1], np.arange(FILTERS)] + bias)
                hidden = np.concatenate(pooled)
                active = np.maximum(hidden, 0)
                chance = 1 / (1 + np.exp(-np.clip(active @ net.out + net.out_bias, -30, 30)))
                error = (chance - toxic[row]) * weight[row] / len(batch)
                grads[-1] += error * active
                bias_grad += error
                back = error * net.out * (hidden > 0)
                for i, width in enumerate(WIDTHS):
                    own = back[i * FILTERS:(i + 1) * FILTERS]
                    grads[len(WIDTHS) + i] += own
                    for k in range(width):
                        at = places[i] + k
                        grads[i][k] += (vectors[at] * own[:, None]).T
                        touched.append(ids[at])
                        changes.append(net.filters[i][k].T * own[:, None])
            self.step += 1
            for value, grad, (mean, square) in zip(dense, grads, self.moments):
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                value -= rate * (mean / (1 - 0.9 ** self.step)) / (np.sqrt(square / (1 - 0.999 ** self.step)) + 1e-8)
            net.out_bias -= rate * 0.5 * float(np.clip(bias_grad, -1, 1))
            used, place = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(used), DIMENSIONS), np.float32)
            np.add.at(total, place, np.concatenate(changes))
            used, total = used[used > 0], total[used > 0]
            self.squares[used] += (total ** 2).mean(axis=1)
            net.embedding[used] -= 5 * rate * total / np.sqrt(self.squares[used])[:, None]


def train(texts: list[np.ndarray], toxic: np.ndarray, rows: int, epochs: int, rate: float, seed: int = 5) -> Network:
    """A network from texts that are all here, in so many rounds over them."""
    random = np.random.default_rng(seed)
    training = Training(random, rows)
    weight = np.where(toxic == 1, len(toxic) / max(1, 2 * toxic.sum()), len(toxic) / max(1, 2 * (1 - toxic).sum()))
    for _ in range(epochs):
        training.learn(texts, toxic, weight, rate, random)
    return training.net


def difference(numbers: np.ndarray, base: np.ndarray) -> bytes:
    """The bits in which float32 numbers differ from others, byte after byte of each: numbers that stayed take no space."""
    bits = numbers.view(np.uint32) ^ base.view(np.uint32)
    return zlib.compress(bits.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def restored(packed: bytes, base: np.ndarray) -> np.ndarray:
    """The numbers of ``difference``, exactly."""
    bits = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
    return (bits ^ base.view(np.uint32)).view(np.float32)


def train_apart(rows: DataFrame, known: np.ndarray, counts: dict[int, int], epochs: int, rate: float, seed: int = 5
                ) -> Network:
    """A network from all rows ``label, words``: in each round every task learns from its own, and the copies are averaged."""
    training, total = Training(np.random.default_rng(seed), len(known) + 1), sum(counts.values())
    weights = np.array([total / (2 * counts[0]), total / (2 * counts[1])])

    def one_round(number: int, base: np.ndarray):
        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, seen, own = TaskContext.get().partitionId(), 0, copy.deepcopy(training)
            random = np.random.default_rng([seed, number, part])
            for batch in batches:
                texts = [table_rows(np.frombuffer(words, np.uint32), known) for words in batch["words"]]
                toxic = batch["label"].to_numpy(np.int64)
                if len(toxic):
                    own.learn(texts, toxic, weights[toxic], rate, random)
                    seen += len(toxic)
            if seen:
                numbers = own.numbers().astype(np.float32)
                for block, start in enumerate(range(0, len(numbers), NUMBERS)):
                    yield pd.DataFrame({"block": [block], "part": [part], "n": [seen],
                                        "numbers": [difference(numbers[start:start + NUMBERS], base[start:start + NUMBERS])]})

        def average(blocks: pd.DataFrame) -> pd.DataFrame:
            blocks, block = blocks.sort_values("part"), int(blocks["block"].iloc[0])
            own = base[block * NUMBERS:(block + 1) * NUMBERS]
            found = sum(restored(numbers, own) * (n / blocks["n"].sum())
                        for numbers, n in zip(blocks["numbers"], blocks["n"].astype(float)))
            return pd.DataFrame({"block": [block], "numbers": [found.astype(np.float64).tobytes()]})
        return learn, average

    for number in range(epochs):
        learn, average = one_round(number, training.numbers().astype(np.float32))
        copies = rows.select("label", "words").mapInPandas(learn, "block int, part int, n bigint, numbers binary")
        mean = copies.groupBy("block").applyInPandas(average, "block int, numbers binary").collect()
        training.take(np.concatenate([np.frombuffer(row.numbers) for row in sorted(mean, key=lambda row: row.block)]))
    return training.net


@dataclass
class ToxicityModel:
    network: Network | None
    known: np.ndarray
    slope: float
    shift: float
    constant: float
    thresholds: dict[str, float]

    def score(self, text: str | None) -> float:
        if self.network is None:
            return self.constant
        return float(_logistic(self.slope * self.network.raw(table_rows(word_hashes(text), self.known)) + self.shift))


def _logistic(value):
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _calibrated(raw: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over ``n`` rows each, by Newton steps with a weak pull to slope one."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        chance = _logistic(slope * raw + shift)
        spread, error = n * np.maximum(chance * (1 - chance), 1e-6), n * (chance - toxic)
        gradient = np.array([(error * raw).sum() + (slope - 1), error.sum()])
        curvature = np.array([[(spread * raw * raw).sum() + 1, (spread * raw).sum()],
                              [(spread * raw).sum(), spread.sum() + 1e-3]])
        change = np.clip(np.linalg.solve(curvature, gradient), -1, 1)
        slope, shift = slope - change[0], shift - change[1]
    return max(slope, 1e-3), shift


def best_threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle between the two scores where cutting gives the best F1."""
    order = np.argsort(-score, kind="stable")
    ranked, hits, taken = score[order], (toxic * weight)[order].cumsum(), weight[order].cumsum()
    f1 = 2 * hits / (taken + (toxic * weight).sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # no cut between equal scores
    best = int(f1.argmax())
    return float((ranked[best] + (ranked[best + 1] if best + 1 < len(ranked) else 0)) / 2)


def known_words(rows: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """The hashes, ascending, that enough of a label's rows ``label, words`` have, out of ``counts`` of each label."""
    least = {label: max(LEAST_DOCUMENTS, -(-n // ONE_IN)) for label, n in counts.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, own in batch.groupby("label"):
                words = np.concatenate([np.unique(np.frombuffer(words, np.uint32)) for words in own["words"]])
                found, n = np.unique(words, return_counts=True)
                ends = np.searchsorted(found >> 24, np.arange(257))
                packed = [packed_counts(found[start:end], n[start:end]) for start, end in zip(ends[:-1], ends[1:])]
                yield pd.DataFrame({"range": np.arange(256), "label": label, "packed": packed})[ends[1:] > ends[:-1]]

    def frequent(ranges: pd.DataFrame) -> pd.DataFrame:
        known = []
        for label, own in ranges.groupby("label"):
            words, n = (np.concatenate(part) for part in zip(*[counts_of_packed(packed) for packed in own["packed"]]))
            found, place = np.unique(words, return_inverse=True)
            known.append(found[np.bincount(place, n) >= least[label]])
        return pd.DataFrame({"word": np.unique(np.concatenate(known)).astype(np.int64)})

    found = (rows.select("label", "words").mapInPandas(count, "range int, label int, packed binary")
             .groupBy("range").applyInPandas(frequent, "word bigint"))
    return np.sort(found.toPandas()["word"].to_numpy(np.int64)).astype(np.uint32)


def packed_counts(words: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending 32-bit words and how often each was found: gaps and numbers, byte after byte of each, compressed."""
    both = np.concatenate([np.diff(words, prepend=np.uint32(0)), n.astype(np.uint32)])
    return zlib.compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def counts_of_packed(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1).copy().view(np.uint32)[..., 0]
    return both[0].cumsum(dtype=np.uint32), both[1]


def labelled_words(docs: DataFrame, labels: DataFrame, label: str, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """``label, lang, words, kept_out`` of each labelled row; rows of the same words are kept out together.

    Rows without a label go before their words are read, but for a few, and only the words of the others are shuffled.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [packed_words(text) for text in batch["text"]]
            order = np.array([zlib.crc32(word_hashes(text).tobytes()) for text in batch["text"]], np.int64)
            yield pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "words": words, "order": order,
                                "kept_out": order % 4 == 3})

    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.filter("label IN (0, 1) AND id IS NOT NULL")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))
    read = among_keys(rows.filter("id IS NOT NULL"), known, "id", LABEL_BITS).mapInPandas(
        hashed, f"id {rows.schema['id'].dataType.simpleString()}, lang string, words binary, order bigint, kept_out boolean")
    return (read.join(known, "id").sortWithinPartitions("order", "label", "lang")
            .select("label", "lang", hashes_of_packed("words").alias("words"), "kept_out"))


def raw_counts(rows: DataFrame, network: Network, known: np.ndarray) -> pd.DataFrame:
    """``raw, label, lang, n``: how many rows have an output, which is rounded so that their number is bounded."""
    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.array([network.raw(table_rows(np.frombuffer(words, np.uint32), known)) for words in batch["words"]])
            yield pd.DataFrame({"step": np.round(np.clip(raw, -60, 60) * STEPS).astype(np.int32), "label": batch["label"],
                                "lang": batch["lang"]})

    found = (rows.select("label", "lang", "words").mapInPandas(outputs, "step int, label int, lang string")
             .groupBy("step", "label", "lang").agg(F.count(F.lit(1)).alias("n")).toPandas())
    found = found.sort_values(["step", "label", "lang"], kind="stable").reset_index(drop=True)
    return found.assign(raw=found["step"] / STEPS)


def rounds(n: int, epochs: int) -> int:
    """Rounds over ``n`` rows: more of few rows; of many, as many as look at ``epochs * FEW_ROWS`` rows, three rounds at least."""
    return max(epochs, min(30, FEW_ROWS // n)) if n <= FEW_ROWS else max(3, -(-epochs * FEW_ROWS // n))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", lang_col: str = "lang",
                 id_col: str = "doc_id", text_col: str = "text", epochs: int = 8, rate: float = 0.01) -> ToxicityModel:
    """Learn from all labelled rows; a quarter of them calibrates."""
    spark, base = docs.sparkSession, folder(docs.sparkSession, "labelled")
    rows = store(labelled_words(docs, labels, label, lang_col, id_col, text_col), base)
    counts = {(row["kept_out"], row["label"]): row["count"] for row in rows.groupBy("kept_out", "label").count().collect()}
    total = {value: sum(n for (_, own), n in counts.items() if own == value) for value in (0, 1)}
    if not all(total.values()):
        delete(spark, base)
        return ToxicityModel(None, np.zeros(0, np.uint32), 1.0, 0.0, float(total[1] > 0), {})
    apart = all(counts.get((out, value)) for out in (False, True) for value in (0, 1))
    chosen, check = (rows.filter("NOT kept_out"), rows.filter("kept_out")) if apart else (rows, rows)
    own = {value: counts[False, value] for value in (0, 1)} if apart else total
    known = known_words(chosen, own)
    network = train_apart(chosen, known, own, rounds(sum(own.values()), epochs), rate).prepare()
    found = raw_counts(check, network, known)
    raw, target, n = found["raw"].to_numpy(), found["label"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    slope, shift = _calibrated(raw, target, n)
    cut = best_threshold(_logistic(slope * raw + shift), target, n)
    shift -= float(np.log(cut / (1 - cut))) if 0 < cut < 1 else 0.0
    score, lang = _logistic(slope * raw + shift), found["lang"].to_numpy()
    thresholds = {}
    for value in sorted({value for value in lang if isinstance(value, str)}):
        mine = lang == value
        if n[mine].sum() >= LEAST_ROWS and (target * n)[mine].sum() >= LEAST_TOXIC:
            thresholds[value] = best_threshold(score[mine], target[mine], n[mine])
    network.embedding = network.embedding[:0]  # scoring needs only the tables
    delete(spark, base)
    return ToxicityModel(network, known, slope, shift, 0.0, thresholds)


def toxicity_of(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(value) for value in texts], dtype="float64")
    return apply(text)


def threshold_of(model: ToxicityModel, lang: Column) -> Column:
    """The threshold of a language: its own, or 0.5."""
    found = F.lit(0.5)
    for value, threshold in model.thresholds.items():
        found = F.when(lang == value, F.lit(threshold)).otherwise(found)
    return found


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that a model may learn from: crc32 of the id modulo 5 is not 0."""
    return labels.filter(remainder(id_col, 5) != 0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: id, ``held_out``, ``score``, ``predicted``, and ``flagged`` by its language's threshold."""
    model = fit_toxicity(docs, training_labels(labels))
    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"),
                       toxicity_of(model, F.col("text")).alias("score"), F.col("lang"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       (F.col("score") >= threshold_of(model, F.col("lang"))).alias("flagged"))
