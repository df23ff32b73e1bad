"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.llm import linear

ORDERS = (3, 4, 5, 6)
_MIX = np.uint32(0x9E3779B1)


def hashed(data: np.ndarray):
    """For each order its buckets: entry i is the n-gram of the bytes from i on."""
    gram = data.astype(np.uint32) + np.uint32(1)
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + data[order - 1 :]
        if order in ORDERS:
            yield order, ((gram ^ (gram >> np.uint32(15))) * _MIX + np.uint32(order)) * _MIX >> np.uint32(12)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as UTF-8 bytes, each between spaces, and where they start and end."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def char_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams (bytes of the lower-cased text) of each text, each once."""
    return _found(texts, None)


def _found(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = joined(texts)
    rows, buckets = [], []
    for order, grams in hashed(data):
        at = np.arange(len(grams)) if wanted is None else np.flatnonzero(wanted[grams])
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + order <= offsets[row + 1]
        rows.append(row[whole])
        buckets.append(grams[at[whole]].astype(np.int64))
    return linear.distinct(np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Weighted:
    """The n-grams that have a weight: all that counts when scoring."""

    def __init__(self, weights: np.ndarray):
        self.wanted = weights != 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _found(texts, self.wanted)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(df: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", most: int = linear.MAX_PER_CLASS // 2, cost: float = 0.1) -> linear.Model:
    """The model from at most ``most`` labelled documents of each class among those that ``learn`` allows."""
    model = linear.fit(linear.training_rows(df, labels, label_col, learn, id_col, text_col, label_id_col, most), char_ngrams, cost)
    model.features = Weighted(model.weights)
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more) of every document.

    Learns from the labels that are not held out. Null and empty texts get the score of a
    text without features, null ids count as held out, equal rows get equal scores; without
    usable labels every score is one half. Texts are scored whole, without a shuffle.
    """
    model = train(df, labels, ~held_out(), id_col=id_col, text_col=text_col, **options)
    return linear.score(df, model, held_out(), id_col, text_col)
