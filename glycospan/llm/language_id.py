"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language gives, from any place of a text, the
longest piece that also stands in the language's text. A text is parsed into such longest
pieces; the language that needs the fewest, weighed by the bits it takes to name a place in
its text, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.llm.common import slices, texts_of

#: Labelled documents of each language, those with the smallest hash of their text, and characters
#: taken of each. Together they bound what is learned: about 64 KB of text for each language.
DOCUMENTS, PIECE = 64, 1_024
#: Languages that are learned, those with the most labelled texts.
LANGUAGES = 64
#: A parse begins anew after so many bytes, so that long texts are parsed in parallel.
SEGMENT = 1_024
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII characters that aren't letters become spaces; other bytes stay.
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which what is no ASCII letter and no other character is one space."""
    if not text:
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split())


def automaton(text: bytes, codes: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of ``text`` as a table of states by character code; 0 is no transition.

    State 1 is the start. ``codes`` numbers the bytes from 1; code 0 has no transition.
    """
    edges: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes[np.frombuffer(text, np.uint8)].tolist():
        new = len(edges)
        edges.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:  # q stands for longer strings too: split it
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(edges), width), np.int32)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to
    return table


@dataclass(frozen=True)
class Languages:
    """The names of the languages and the text that each was learned from."""

    names: tuple[str, ...]
    texts: tuple[bytes, ...]


@lru_cache(maxsize=2)
def compiled(learned: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each byte, all automata in one table, start state of each, bits of a phrase of each)."""
    used = np.unique(np.frombuffer(b"".join(learned.texts), np.uint8))
    codes = np.zeros(256, np.int64)
    codes[used] = np.arange(1, len(used) + 1)
    tables, starts, size = [], [], 0
    for text in learned.texts:
        table = automaton(text, codes, len(used) + 1)
        tables.append(np.where(table > 0, table + size, 0))
        starts.append(size + 1)
        size += len(table)
    bits = np.log2(np.maximum([len(t) for t in learned.texts], 2))
    return codes, np.concatenate(tables), np.array(starts), bits


def phrases(texts: list[bytes], learned: Languages, segment: int = SEGMENT) -> np.ndarray:
    """Phrases of each text in the parse by each language: a row for each text.

    Segments of all texts are parsed side by side, one byte of each at a time.
    """
    codes, table, starts, _ = compiled(learned)
    data = codes[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    pieces = -(-sizes // segment)
    owner = np.repeat(np.arange(len(texts)), pieces)
    first = (ends - sizes)[owner] + segment * (np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner])
    length = np.minimum(segment, ends[owner] - first)
    order = np.argsort(-length, kind="stable")
    owner, first, length = owner[order], first[order], length[order]
    count = np.zeros((len(owner), len(starts)), np.int32)
    state = np.tile(starts, (len(owner), 1))
    flat, width = table.ravel(), table.shape[1]
    alive = np.searchsorted(-length, -np.arange(length.max(initial=0)))  # segments longer than each place
    for at, n in enumerate(alive.tolist()):
        c = data[first[:n] + at][:, None]
        now = state[:n]
        step = flat[now * width + c]
        stuck = (step == 0) & (now != starts)  # the longest match ends before this byte, which begins the next
        count[:n] += stuck
        step = np.where(stuck, flat[starts * width + c], step)
        unknown = step == 0  # a byte that the language's text lacks is a phrase of its own
        count[:n] += unknown
        state[:n] = np.where(unknown, starts, step)
    count += state != starts
    out = np.zeros((len(texts), len(starts)), np.int64)
    np.add.at(out, owner, count)
    return out


def judge(texts: list[str | None], learned: Languages) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text.

    The score is the winner's share of the likelihoods that the parses' bits stand for.
    """
    if not learned.names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    spelled = [normalised(t) for t in texts]
    cost = phrases(spelled, learned) * compiled(learned)[3]
    best = cost.argmin(axis=1)  # the first name wins ties
    share = 1 / np.exp2(np.clip(cost.min(axis=1, keepdims=True) - cost, -1000, 0)).sum(axis=1)
    spoken = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
    return [learned.names[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)], np.where(spoken, share, 0.0)


# --- Spark -----------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learn(df: DataFrame, allowed: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, piece: int = PIECE, languages: int = LANGUAGES) -> Languages:
    """Bounded text of each language, from rows that ``allowed``, a condition on doc_id, lets in.

    Copies of a text count once. Rows with a null id, language or text are left out, and so
    are texts without a letter. Of a longer text the piece begins at a place given by its hash.
    """
    rows = texts_of(df, id_col, text_col, lang_col).withColumn("lang", F.col("more_0").cast("string"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & allowed)
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("mark"))
    marks = hashed.groupBy("lang", "mark").count().drop("count")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = marks.withColumn("place", place).where(F.col("place") <= documents)
    most = marks.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    keys = [(r.lang, r.mark) for r in chosen.join(F.broadcast(most.select("lang")), "lang").collect()]
    if not keys:
        return Languages((), ())
    wanted = df.sparkSession.createDataFrame(sorted(keys), "lang string, mark long")
    start = F.pmod(F.col("mark"), F.greatest(F.length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    cut = hashed.join(F.broadcast(wanted), ["lang", "mark"]).select("lang", "mark", F.substring("text", start, F.lit(piece)).alias("piece"))
    pieces = cut.groupBy("lang", "mark").agg(F.min("piece").alias("piece")).orderBy("lang", "mark").collect()
    names = tuple(sorted({r.lang for r in pieces}))
    texts = tuple(b" ".join(normalised(r.piece) for r in pieces if r.lang == name) for name in names)
    return Languages(names, texts)


_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(df: DataFrame, learned: Languages, marked: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; see ``identify_languages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = judge(batch.column("text").to_pylist(), learned)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = texts_of(df, id_col, text_col).withColumn("held_out", F.coalesce(marked, F.lit(True)))
    return rows.mapInArrow(run, _OUT)


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text when
    there is nothing to learn from. Null ids count as held out, equal texts get equal results,
    ties go to the first name in order. Texts are parsed whole, in one pass without a shuffle.
    """
    learned = learn(df, ~held_out(), lang_col, id_col, text_col, **options)
    return identify(df, learned, held_out(), id_col, text_col)
