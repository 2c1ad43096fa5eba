"""Secret scan: three plain patterns, and a guess-cost search over values that stand where a credential would.

The patterns find assignments to a secret's name, access keys and long hexadecimal runs. Beyond these, a value
after a word like password, passphrase or bearer is segmented at minimum cost into dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans. The cost is the decimal logarithm of the guesses that
an attacker would need. Values that cost at least ``least_guesses`` are added as spans of kind ``guess``; cheaper
ones (``changeme``, ``summer2024``) are placeholders or prose and are not. Such a value ends at white space or at its opening
quote, whatever symbols are in it; a quoted one may hold blanks if its quote closes in the same line. Commas, semicolons and
quotes at its very end are not part of it unless it is quoted. It is added unless the patterns' spans cover all of it.

The dictionary is the public rank file of a byte-level tokenizer: its entries that are whole words, by rank.

Edge cases: a null text counts as empty and has no spans; repeated rows give repeated results; an empty table gives
an empty result. Positions are code points, the end is exclusive. A text is read whole, whatever its length; the
segmentation costs all the suffixes of a value at once, since in a value other names may stand, and takes time in
proportion to its length. Equal starts are ordered by kind.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import free_name

KINDS = ("assign", "access", "hex", "guess")
# log10 of the guesses from which a value counts as a secret.
LEAST_GUESSES = 10.0
RESULT = ("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, "
          "most_guesses double")

ASCII = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("pass", "pwd", "secret", "token", "key", "bearer", "credential", "authorization")
CONTEXT = re.compile(
    r"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?"""
    r"""|authorization["']?\s*[:=]\s*["']?basic|authorization|bearer)["']?"""
    r"""(?:\s*(?::=|=>|[:=])\s*|\s+(?:is|was)\s+|(?<=bearer)\s+|(?<=basic)\s+)"""
    r"""(?:(["'`])(?=(?:(?!\1)[^\n]){6})|(?=(?!["'`])\S{6}))""", ASCII)
BLANK = re.compile(r"\s")
# What ends a sentence or an enclosing string, and not the value before it.
AFTER = ",;\"'`"

# Costs as log10 of guesses: of a character that nothing explains, and of each further segment.
CHARACTER, SEGMENT = 1.0, 0.3
LONGEST_WORD, LONGEST_RUN, LONGEST_PERIOD = 20, 64, 8
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
COMMON = ("password", "passwd", "secret", "changeme", "example", "letmein", "welcome", "admin", "default", "test",
          "placeholder", "yourpassword", "username", "dummy", "sample", "login", "guest", "root", "none", "null")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(
    r"(?:(?:19|20)\d\d|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)"
    r"|(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))")


class Span(NamedTuple):
    start: int
    kind: int  # index into KINDS
    end: int
    value: int  # where the secret itself begins


@lru_cache(maxsize=2)
def word_costs(path: str) -> dict[str, float]:
    """log10 of the rank of each whole word of three letters and more."""
    costs = {word: math.log10(2 + i) for i, word in enumerate(COMMON)}
    with open(path, "rb") as lines:
        for line in lines:
            entry, rank = line.split()
            word = base64.b64decode(entry).decode("utf-8", "ignore")
            if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                costs.setdefault(word[1:].lower(), math.log10(len(COMMON) + 2 + int(rank)))
    return costs


def _key_places() -> dict[str, tuple[int, int]]:
    return {key: (row, column) for row, keys in enumerate(KEYBOARD) for column, key in enumerate(keys)}


PLACES = _key_places()


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The move from key to key, if they are neighbours."""
    if a not in PLACES or b not in PLACES:
        return None
    (row, column), (to_row, to_column) = PLACES[a], PLACES[b]
    move = to_row - row, to_column - column
    return move if move != (0, 0) and max(map(abs, move)) == 1 else None


def _runs(lower: str) -> list[list[tuple[int, float]]]:
    """By start: where a walk, a sequence or a repeat can end, and its cost without a segment's own."""
    n = len(lower)
    found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for start in range(n):
        turns, last = 0, None
        for end in range(start + 1, min(n, start + LONGEST_RUN)):
            move = _step(lower[end - 1], lower[end])
            if move is None:
                break
            turns, last = turns + (move != last), move
            if end - start >= 2:
                found[start].append((end + 1, math.log10(47) + math.log10(end - start) + 0.6 * turns))
        for difference in (-1, 0, 1):
            end = start + 1
            while end < min(n, start + LONGEST_RUN) and ord(lower[end]) - ord(lower[end - 1]) == difference:
                end += 1
                if end - start >= 3:
                    found[start].append((end, CHARACTER + math.log10(end - start)))
    for period in range(2, LONGEST_PERIOD + 1):
        equal = 0
        for i in range(period, n):
            equal = equal + 1 if lower[i] == lower[i - period] else 0
            if equal >= period and equal % period == 0:
                found[i + 1 - equal - period].append((i + 1, period * CHARACTER + math.log10(equal // period + 1)))
    return found


class Costs:
    """log10 of the guesses for a value and all its suffixes: the cheapest ways to cut them into explained and unexplained spans."""

    def __init__(self, value: str, words: dict[str, float]):
        lower = "".join(one if len(one) == 1 else letter for letter, one in ((letter, letter.lower()) for letter in value))
        plain = lower.translate(LEET)
        n, runs = len(value), _runs(lower)
        for start in range(n):
            if lower[start].isdigit():
                for end in range(start + 4, min(n, start + 10) + 1):
                    if DATE.fullmatch(lower, start, end):
                        cost = math.log10(120 if end - start == 4 else 120 * 365) + 0.3 * (not lower[start:end].isdigit())
                        runs[start].append((end, cost))
        best, brute = [0.0] * (n + 1), math.inf
        for start in range(n - 1, -1, -1):
            brute = min(brute, best[start + 1] + SEGMENT) + CHARACTER
            least = brute
            for end in range(start + 3, min(n, start + LONGEST_WORD) + 1):
                for form, extra in ((lower, 0.0), (plain, 0.3)):
                    cost = words.get(form[start:end])
                    if cost is not None:
                        upper = 0.3 if value[start:end] != lower[start:end] else 0.0
                        least = min(least, best[end] + SEGMENT + cost + extra + upper)
            for end, cost in runs[start]:
                least = min(least, best[end] + SEGMENT + cost)
            best[start] = least
        self.best = np.array(best)
        # By period: how many characters from one on equal those a period before them.
        letters = np.array([ord(letter) for letter in lower], np.int64)
        self.equal = {}
        for period in range(2, LONGEST_PERIOD + 1):
            differ = np.nonzero(np.append(letters[period:] != letters[:-period], True))[0] if n > period else np.zeros(1, int)
            places = np.arange(max(1, n - period + 1))
            self.equal[period] = differ[np.searchsorted(differ, places)] - places
        self.repeats = np.log10(np.arange(n + 2) + 1.0)

    def of(self, start: int) -> float:
        """The cost of the suffix that begins there. A repeat that goes on there counts from there."""
        least = float(self.best[start])
        for period, equal in self.equal.items():
            times = int(equal[start]) // period if start < len(equal) else 0
            if times:
                rest = self.best[start + 2 * period:start + (times + 1) * period + 1:period]
                least = min(least, SEGMENT + period * CHARACTER + float((rest + self.repeats[1:times + 1]).min()))
        return least


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses for a value."""
    return Costs(value, words).of(0)


class Values:
    """The values of one text that stand in a credential's place, and their costs. Values with one end share their costs."""

    def __init__(self, text: str, words: dict[str, float]):
        self.text, self.words, self.blank = text, words, -1
        self.known: dict[int, tuple[int, Costs]] = {}

    def end(self, start: int, quote: str | None) -> int:
        if self.blank < start:
            match = BLANK.search(self.text, start)
            self.blank = match.start() if match else len(self.text)
        if quote is None:
            return start + len(self.text[start:self.blank].rstrip(AFTER)) if self.text[self.blank - 1] in AFTER else self.blank
        end = self.text.find(quote, start, self.blank)
        return end if end >= 0 else self._closing(start, quote)

    def _closing(self, start: int, quote: str) -> int:
        """The quote that closes a value with blanks, unless it is an apostrophe; without one the value ends at the blank."""
        line = self.text.find("\n", self.blank)
        line = len(self.text) if line < 0 else line
        end = self.text.find(quote, self.blank, line)
        while end >= 0:
            if not (self.text[end - 1].isalnum() and self.text[end + 1:end + 2].isalnum()):
                return end
            end = self.text.find(quote, end + 1, line)
        return self.blank

    def cost(self, start: int, end: int) -> float:
        if end - start < 6:
            return 0.0
        first, costs = self.known.get(end, (start + 1, None))
        if first > start:
            for old in [old for old in self.known if old <= start]:
                del self.known[old]
            first, costs = start, Costs(self.text[start:end], self.words)
            self.known[end] = first, costs
        return costs.of(start - first)


def find_secrets(text: str | None, words: dict[str, float], least_guesses: float = LEAST_GUESSES
                 ) -> tuple[list[Span], float]:
    """All spans of a text by start and kind, and the highest cost among the values in a credential's place."""
    text, most = text or "", 0.0
    spans = [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    folded = text.lower()
    if not any(name in folded for name in NAMES):
        return sorted(spans), most
    spans += [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    covered = _stretches(spans)
    at, match, values = 0, CONTEXT.search(text), Values(text, words)
    while match:
        start = match.end()
        end = values.end(start, match[1])
        cost = values.cost(start, end)
        most = max(most, cost)
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        inside = at < len(covered) and covered[at][0] <= start and end <= covered[at][1]
        if cost >= least_guesses and not inside:
            spans.append(Span(start, 3, end, start))
        # In a cheap value another name can stand, with a value that is not cheap.
        match = CONTEXT.search(text, end if cost >= least_guesses else start)
    return sorted(spans), most


def _stretches(spans: list[Span]) -> list[list[int]]:
    """Disjoint stretches of text, in order, that the spans cover."""
    found: list[list[int]] = []
    for span in sorted(spans):
        if found and span.start < found[-1][1]:
            found[-1][1] = max(found[-1][1], span.end)
        else:
            found.append([span.start, span.end])
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[span.kind]}:{span.start}:{span.end}" for span in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each secret replaced; overlapping secrets become one mark."""
    parts, at = [], 0
    for start, end in sorted((span.value, span.end) for span in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _words(path: str | None) -> dict[str, float]:
    return word_costs(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def secrets_of(words_path: str | None = None, least_guesses: float = LEAST_GUESSES):
    """A column function from text to the struct of ``RESULT``."""
    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _words(words_path)
        for texts in batches:
            rows = []
            for text in texts:
                spans, most = find_secrets(text, words, least_guesses)
                base = [span for span in spans if span.kind < 3]
                counts = [sum(span.kind == kind for span in spans) for kind in range(4)]
                rows.append((*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                             counts[3], most))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess",
                                              "most_guesses"])
    return scan


def scan_secrets(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All columns and rows of ``docs`` and one more, ``secrets``: a struct of counts and spans.

    If ``docs`` has a column of that name, underscores are added to the new one's.
    """
    return docs.withColumn(free_name(docs, "secrets"), secrets_of(**options)(F.col(f"`{text_col}`")))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", words_path: str | None = None,
                   least_guesses: float = LEAST_GUESSES) -> DataFrame:
    """``docs`` with the secrets in the text replaced by a mark; texts without one, and nulls, stay as they are."""
    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _words(words_path)
        for texts in batches:
            yield pd.Series([text if text is None else redacted(text, find_secrets(text, words, least_guesses)[0], mark)
                             for text in texts], dtype=object)

    return docs.withColumn(text_col, replace(F.col(f"`{text_col}`")))


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document: its id, the counts of the plain patterns, their digest, all spans, and what was added."""
    return docs.select("doc_id", secrets_of()(F.col("text")).alias("found")).select("doc_id", "found.*")
