"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios.

The n-grams are of word shapes, since what makes a text good or bad here lies in its form
(tables, shouting, litter, repetition) in any language: one shape per word from its case,
length, marks and whether it equals the word before it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.llm import linear
from glycospan.llm.common import mixed, word_codes, words_of

ORDERS = 4
LENGTHS = (1, 3, 6, 10, 16)


@lru_cache(maxsize=200_000)
def shape(word: bytes) -> int:
    """A small number for the look of a word: case, length class, marks inside and at the end."""
    text = word.decode("utf-8", "surrogatepass")
    core = text.rstrip(".,;:!?\"')]}")
    tail = text[len(core) :]
    letters = [c for c in core if c.isalpha()]
    if not letters:
        case = 0 if any(map(str.isdigit, core)) else 1
    elif core.isupper():
        case = 2 if len(letters) > 1 else 3
    elif core.islower():
        case = 4
    else:
        case = 5 if core[:1].isupper() and core[1:].islower() else 6
    marks = min(3, sum(not c.isalnum() for c in core))
    ending = 0 if not tail else 1 if tail == "," else 2 if tail == "." else 3 if len(tail) == 1 else 4 if len(set(tail)) == 1 else 5
    length = sum(len(core) > n for n in LENGTHS)
    return ((case * 4 + marks) * 6 + ending) * 6 + length


def shape_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 1 to 4 shapes, and of the mean repetition, of each text."""
    codes, words, offsets = word_codes(words_of(texts))
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), lengths)
    shapes = np.fromiter(map(shape, words), np.uint64, len(words))[codes] * np.uint64(2)
    shapes[1:] += (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    rows, buckets, gram = [], [], np.zeros(len(codes), np.uint64)
    for order in range(1, ORDERS + 1):
        gram = mixed(shapes) if order == 1 else mixed(gram[:-1] * np.uint64(31) + mixed(shapes[order - 1 :]))
        whole = row[: len(gram)] == row[order - 1 :]
        rows.append(row[: len(gram)][whole])
        buckets.append((gram[whole] % np.uint64(linear.BUCKETS)).astype(np.int64))
    return linear.distinct(np.concatenate(rows), np.concatenate(buckets)) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(df: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", most: int = linear.MAX_PER_CLASS, cost: float = 0.1) -> linear.Model:
    """The model from at most ``most`` labelled documents of each class among those that ``learn`` allows."""
    return linear.fit(linear.training_rows(df, labels, label_col, learn, id_col, text_col, label_id_col, most), shape_ngrams, cost)


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more) of every document.

    Learns from the labels that are not held out. Null and empty texts get the score of a
    text without features, null ids count as held out, equal rows get equal scores; without
    usable labels every score is one half. Texts are scored whole, without a shuffle.
    """
    model = train(df, labels, ~held_out(), id_col=id_col, text_col=text_col, **options)
    return linear.score(df, model, held_out(), id_col, text_col)
