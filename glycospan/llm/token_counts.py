"""Token counts of a BPE piece model by a deterministic transducer over chunks of text.

The automaton reads characters. Its state holds, for the positions in reach of a token,
the last token of the encoding up to there and how many tokens it has less than the
newest position; a transition is annotated with the change of the count. States and
transitions are made when first needed. A run of spaces sets it back, as no piece has a
space behind another character, so a chunk of text acts on any state as
``(head, count, tail)``: a head to be read from the state before, a count that is the
same for every state, and a tail to be read on from a fresh state. These maps compose
associatively, so chunks are worked on in parallel and merged in any grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.llm.common import partitions, slices, texts_of
from glycospan.llm.merges import Merges

#: Characters of a chunk; longer texts are spread over tasks.
CHUNK = 1 << 16
#: Words and transitions kept by a Python worker; a full cache is emptied, which costs time only.
CACHE, STEPS = 400_000, 250_000
#: A run of spaces with what follows up to the next run.
_UNIT = re.compile(r"[^ ]+| +[^ ]*")
_BORDER = re.compile(r"(?<=[^ ]) ")


class PieceCounter:
    """Transducer of a sentence-piece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        with open(path, "rb") as file:
            model = schema.ModelProto.FromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and spaces in front are supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        pieces = [(p.piece.replace("▁", " "), p.score) for p in model.pieces if p.type == 1]
        if any(" " in p.lstrip(" ") for p, _ in pieces):
            raise ValueError("a piece has a space behind another character")
        # pieces of spaces alone have one score and merge last and from the left, so each takes all it can
        sizes = sorted({1, *(len(p) for p, _ in pieces if not p.strip(" "))})
        self.blank, self.blanks = sizes[-1], [0]
        for n in range(1, self.blank):
            self.blanks.append(1 + self.blanks[n - max(k for k in sizes if k <= n)])
        ranked = sorted((p for p in pieces if p[0].strip(" ") or len(p[0]) == 1), key=lambda p: -p[1])
        self.merges = Merges({p: i for i, (p, _) in enumerate(ranked)}, list)
        self.starts = {p[:n] for p, _ in ranked for n in range(1, len(p))}
        self._words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        # A state: the suffix that begins a piece, and (last token, tokens less than now) for each of its positions.
        self._states: list[tuple] = [("", (("", 0),))]
        self._numbers: dict[tuple, int] = {self._states[0]: 0}
        self._steps: dict[tuple[int, str], tuple[int, int]] = {}

    def _step(self, number: int, char: str) -> tuple[int, int]:
        """The transition from a state by a character: the next state and the change of the token count."""
        suffix, last = self._states[number]
        if char not in self.merges.ranks:
            return 0, len(char.encode("utf-8", "surrogatepass"))  # byte fallback; nothing merges with it
        ranks, merges = self.merges.ranks, self.merges
        for size in range(len(suffix) + 1, 0, -1):
            token = suffix[len(suffix) + 1 - size :] + char
            if token in ranks:
                before, less = last[size - 1]
                if merges.apart(before, token):
                    break
        change = 1 - less
        suffix += char
        keep = next(n for n in range(len(suffix), -1, -1) if not n or suffix[len(suffix) - n :] in self.starts)
        state = (suffix[len(suffix) - keep :], ((token, 0), *((t, n + change) for t, n in last[:keep])))
        made = self._numbers.setdefault(state, len(self._states))
        if made == len(self._states):
            self._states.append(state)
        return made, change

    def word(self, text: str) -> int:
        """Tokens of a stretch without spaces, except perhaps one in front, read from a fresh state."""
        if len(self._steps) > STEPS:
            self._forget()
        state, count, steps = 0, 0, self._steps
        for char in text:
            done = steps.get((state, char))
            if done is None:
                done = steps[state, char] = self._step(state, char)
            state = done[0]
            count += done[1]
        return count

    def run(self, spaces: int) -> int:
        """Tokens of a run of spaces that merge with nothing else."""
        return spaces // self.blank + self.blanks[spaces % self.blank]

    def unit(self, text: str) -> int:
        """Tokens of a run of spaces and the characters up to the next run."""
        word = text.lstrip(" ")
        spaces = len(text) - len(word)
        if not word:
            return self.run(spaces)
        if spaces < 2:
            return self.word(text)
        # the last space merges with the word if its first token says so; else it belongs to the run
        if self.first(" " + word) == " ":
            return self.run(spaces) + self.word(word)
        return self.run(spaces - 1) + self.word(" " + word)

    def first(self, text: str) -> str:
        """The first token of a stretch, as far as the piece model can reach."""
        return self.merges.merge(text[: 1 + next((i for i, c in enumerate(text[1:]) if c not in self.merges.ranks), len(text))])[0]

    def count(self, text: str) -> int:
        """Tokens of a text that begins in a fresh state."""
        known, total = self._words, 0
        for unit in _UNIT.findall(text):
            n = known.get(unit)
            if n is None:
                n = self.unit(unit)
                if len(unit) < 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[unit] = n
            total += n
        return total

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, tail) of a chunk; the tail is None if no run of spaces begins in it."""
        first = _BORDER.search(text)
        if not first:
            return text, 0, None
        start = first.start()
        end = start + len(text[start:].rstrip(" ")) if text.endswith(" ") else len(text)
        last = text.rfind(" ", start, end)
        last = start + len(text[start : last + 1].rstrip(" ")) if end == len(text) else end
        return text[:start], self.count(text[start:last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def total(self, maps: list[tuple]) -> int:
        """Tokens of the text whose chunks have these maps, composed pairwise level by level."""
        maps = [(self.prefix, 0, None), *maps] if any(m[0] or m[2] for m in maps) else []
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.count(m[0]) + m[1] + self.count(m[2] or "") for m in maps)


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    """The transducer, compiled once in each Python worker and then extended as texts need it."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text.

    A null text counts as empty and has no tokens; each row gives one row, also when ids
    are null or repeated. Texts of up to ``chunk`` characters are counted where they are.
    Longer ones are cut, their chunks dealt out to all tasks, and the chunk maps, which are
    small as long as a text has spaces, composed per text.
    """
    texts = texts_of(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.replace("text", F.lit("▁"), F.lit(" ")).alias("text"))
    long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for part in slices(batches):
            counts = [own.total([own.chunk(t)]) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for part in slices(batches):
            made = [own.chunk(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keys), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))],
                names=[*keys, "head", "count", "tail"],
            )

    def together(chunks: pd.DataFrame) -> pd.DataFrame:
        own, first = counter(path), chunks.sort_values("place", kind="stable")
        copies = int((first.place == 0).sum())  # rows with the same id and text have the same chunks
        first = first.drop_duplicates("place")
        n = own.total([(h, c, None if t is None or t != t else t) for h, c, t in zip(first["head"], first["count"], first["tail"], strict=True)])
        return pd.DataFrame({"doc_id": first.doc_id.iloc[:1].repeat(copies), "n_bytes": first.n_bytes.iloc[0], "n_tokens": n})

    keys = ["doc_id", "mark", "n_bytes", "place"]
    places = F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int"))).alias("place")
    cut = texts.where(long).select("doc_id", "n_bytes", F.xxhash64("text").alias("mark"), "text", places)
    cut = cut.withColumn("text", F.expr(f"substr(text, place * {chunk} + 1, {chunk})")).repartition(partitions(df), "mark", "place")
    chunks = cut.mapInArrow(maps, "doc_id long, mark long, n_bytes long, place int, head string, count long, tail string")
    shape = "doc_id long, n_bytes long, n_tokens long"
    return texts.where(~long).mapInArrow(whole, shape).unionByName(chunks.groupBy("doc_id", "mark").applyInPandas(together, shape))


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """The counts and whether they exceed a context of ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
