"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one token that can end its encoding: the token that
ends there, whose own start is a prefix with a last token that stays apart from it.
Storing that token for each prefix gives the encoding by walking back, makes appending
exact (nothing stored before changes), and confines an edit to the bytes after it until
the stored tokens agree again.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glycospan.llm.common import slices, texts_of
from glycospan.llm.merges import Merges

#: Pieces and units kept by a Python worker; a full cache is emptied, which costs time only.
CACHE = 700_000
#: A space between two characters that are no white space: no piece reaches across its left side.
_UNITS = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")


def cached(known: dict[str, bytes], key: str, make: Callable[[str], bytes]) -> bytes:
    """``make(key)``, kept unless the key is long."""
    value = known.get(key)
    if value is None:
        value = make(key)
        if len(key) < 40:
            if len(known) >= CACHE:
                known.clear()
            known[key] = value
    return value


class BytePairs:
    """A rank file with its splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, (x.strip() for x in file)))}
        self.pattern = regex.compile(pattern)
        self.merges = Merges(self.ranks, lambda piece: [piece[i : i + 1] for i in range(len(piece))])
        self.longest = max(map(len, self.ranks))
        self.nodes = {t[:n]: -1 for t in self.ranks for n in range(1, len(t))} | self.ranks
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._units: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._last: dict[bytes, bytes] = {b"": b""}

    def piece(self, text: str) -> bytes:
        """Packed ids of one piece; a piece that is a token itself is that token, as in the library."""
        data = text.encode()
        whole = self.ranks.get(data)
        return array("I", [whole] if whole is not None else self.program(data)).tobytes()

    def program(self, data: bytes) -> list[int]:
        """Ids of a piece from the last tokens of its prefixes, of which pieces seen before left many."""
        last, ranks, merges = self._last, self.ranks, self.merges
        known, size = merges.known, len(data)
        if size > 200:
            return Prefixes(self, data).ids()
        if len(last) > CACHE:
            last.clear()
            last[b""] = b""
        done = size
        while data[:done] not in last:
            done -= 1
        for end in range(done + 1, size + 1):  # an append of one byte each
            for begin in range(max(0, end - self.longest), end):
                token = data[begin:end]
                if token in ranks:
                    before = last[data[:begin]]
                    stays = known.get((before, token))
                    if merges.apart(before, token) if stays is None else stays:
                        last[data[:end]] = token
                        break
            else:
                raise ValueError(f"no token ends at byte {end}: a byte is missing from the vocabulary")
        out, at = [], size
        while at:
            token = last[data[:at]]
            out.append(ranks[token])
            at -= len(token)
        return out[::-1]

    def unit(self, text: str) -> bytes:
        """Packed ids of a stretch of text that starts and ends between pieces."""
        return b"".join([cached(self._pieces, p, self.piece) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        units = _UNITS.split(text) if text else []
        out = list(map(self._units.get, units))
        if None in out:
            out = [cached(self._units, u, self.unit) if x is None else x for u, x in zip(units, out, strict=True)]
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


class Prefixes:
    """The last token of every prefix of one piece, open to appends and edits."""

    def __init__(self, vocabulary: BytePairs, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[bytes | None] = [b""]
        self.append(data)

    def append(self, data: bytes) -> Prefixes:
        """Add bytes at the end: what is stored for the old prefixes stays right."""
        old = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        self._fill(max(0, old - self.vocabulary.longest), old)
        return self

    def _fill(self, start: int, old: int, stop: Callable[[int], bool] | None = None) -> int:
        """Last tokens of the prefixes longer than ``old``, by the tokens that begin at ``start`` or later.

        ``stop`` is asked after each prefix whether to end; returns how long that prefix is.
        """
        data, last, merges, nodes = self.data, self.last, self.vocabulary.merges, self.vocabulary.nodes
        known, size = merges.known, len(self.data)
        for begin in range(start, size):
            before = last[begin]
            if before is None:
                raise ValueError(f"no token ends at byte {begin}: a byte is missing from the vocabulary")
            if stop and begin > old and stop(begin):
                return begin
            for end in range(begin + 1, size + 1):
                token = data[begin:end]
                rank = nodes.get(token)
                if rank is None:
                    break
                if rank >= 0 and end > old and last[end] is None:
                    stays = known.get((before, token))
                    if merges.apart(before, token) if stays is None else stays:
                        last[end] = token
        return size

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes ``start`` to ``end``; returns how many prefixes were worked out again.

        Prefixes up to ``start`` stay. After the new bytes, once as many last tokens in a
        row as the longest token has bytes equal the old ones, all later ones do too.
        """
        old, shift, same = self.last, len(data) - (end - start), 0
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1] + [None] * (len(self.data) - start)

        def settled(at: int) -> bool:
            nonlocal same
            same = same + 1 if at - shift > end and old[at - shift] == self.last[at] else 0
            return same >= self.vocabulary.longest

        at = self._fill(max(0, start - self.vocabulary.longest), start, settled)
        self.last[at + 1 :] = old[at - shift + 1 :]
        return at - start

    def ids(self) -> list[int]:
        """Ids of the whole piece, walking back from its last token."""
        out, at = [], len(self.data)
        while at:
            out.append(self.vocabulary.ranks[self.last[at]])
            at -= len(self.last[at])
        return out[::-1]


class Document:
    """An encoded text that can be appended to and edited; only pieces near a change are split anew."""

    def __init__(self, vocabulary: BytePairs, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        self.pieces = [Prefixes(vocabulary, p.encode()) for p in vocabulary.pattern.findall(text)]

    def append(self, text: str) -> Document:
        return self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> Document:
        """Put ``text`` in place of characters ``start`` to ``end``.

        The split restarts two pieces before the change (a piece's end depends on the
        characters up to the next piece) and stops where a new border meets an old one
        behind two unchanged pieces.
        """
        pattern, spans, at = self.vocabulary.pattern, [], 0
        for p in self.pieces:
            spans.append((at, at := at + len(p.data.decode())))
        keep = max(0, next((i for i, s in enumerate(spans) if s[1] >= start), len(spans)) - 2)
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        old = {s[0] + shift: i for i, s in enumerate(spans) if s[0] >= end}
        new, met, at = [], 0, spans[keep][0] if keep < len(spans) else 0
        for match in pattern.finditer(self.text, at):
            i = old.get(match.start())
            met = met + 1 if i is not None else 0
            if met > 2:
                new += self.pieces[i:]
                break
            new.append(Prefixes(self.vocabulary, match.group().encode()))
        self.pieces = self.pieces[:keep] + new
        return self

    def ids(self) -> list[int]:
        ranks = self.vocabulary.ranks
        return [i for p in self.pieces for i in ([ranks[p.data]] if p.data in ranks else p.ids())]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """The vocabulary, loaded once in each Python worker."""
    return BytePairs(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of every text and the bytes they decode to.

    Returns doc_id, ``ids`` (binary: little-endian unsigned 32-bit numbers), n_tokens,
    ``decoded`` (binary), and the columns of ``keep``. Each match of ``pattern`` is encoded
    separately, without special tokens. A null text counts as empty: no ids. Ids may be null
    or repeated, each row gives one row. No shuffle; a text is worked on whole in one task.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = ", ".join(["", *(f"more_{i} {fields[c]}" for i, c in enumerate(keep))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for part in slices(batches):
            ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.binary()), *(part.column(i) for i in range(2, part.num_columns))],
                names=["doc_id", "ids", "n_tokens", "decoded", *part.schema.names[2:]],
            )

    out = texts_of(df, id_col, text_col, *keep).mapInArrow(encode, f"doc_id long, ids binary, n_tokens long, decoded binary{kept}")
    return out.withColumnsRenamed({f"more_{i}": c for i, c in enumerate(keep)})


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hexadecimal SHA-256 of ids and decoded bytes."""
    return encoded.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
