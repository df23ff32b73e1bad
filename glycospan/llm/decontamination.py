"""Benchmark decontamination: a broadcast set of n-gram hashes probed by every window of the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.llm.common import cover, inside, runs_of, slices, texts_of, window_hashes, word_codes, word_hashes

WINDOW = 10
#: Bytes of benchmark text in one broadcast set; a larger benchmark is taken in as many parts as it needs.
PART_BYTES = 16 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Every byte that is no ASCII letter or digit and below 128 becomes a space.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_NORMAL = bytes(_WORDS[_LOWER[c]] for c in range(256))


def normal_words(texts: list[str | None]) -> list[list[bytes]]:
    """Words of each text: A-Z in lower case, runs of ASCII letters, digits and all characters above 127."""
    return [(t or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split() for t in texts]


class Windows:
    """The windows of a benchmark: hashes to probe and the words to verify a hit with."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[bytes, ...], set[int]] = {}
        for item, words in zip((i for i, _ in items), normal_words([t for _, t in items]), strict=True):
            size = min(width, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                self.items.setdefault(tuple(words[at : at + size]), set()).add(item)
        for window in self.items:
            for word in window:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.numbers = word_hashes(list(self.vocabulary))
        self.hashes: dict[int, np.ndarray] = {}
        for size in sorted({len(w) for w in self.items}):
            codes = np.array([[self.vocabulary[x] for x in w] for w in self.items if len(w) == size]).reshape(-1)
            self.hashes[size] = np.unique(window_hashes(self.numbers[codes - 1], size)[::size])

    def find(self, words: list[list[bytes]]) -> list[tuple[np.ndarray, set[int]]]:
        """For each text: which words are hit, and the items whose windows occur."""
        get = self.vocabulary.get
        flat = [w for ws in words for w in ws]
        codes = np.fromiter((get(w, 0) for w in flat), np.int64, len(flat))
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        values = np.concatenate(([np.uint64(0)], self.numbers))[codes]
        hit, found = np.zeros(len(flat), bool), [set() for _ in words]
        strange = np.concatenate(([0], np.cumsum(codes == 0)))
        for size, hashes in self.hashes.items():
            probes = len(flat) - size + 1
            if probes <= 0:
                continue
            starts = np.flatnonzero((strange[size:] == strange[:probes]) & inside(offsets, size, probes))
            if not len(starts):
                continue
            probed = window_hashes(values, size)[starts]
            at = np.minimum(np.searchsorted(hashes, probed), len(hashes) - 1)
            good = []
            for start in starts[hashes[at] == probed].tolist():
                items = self.items.get(tuple(flat[start : start + size]))
                if items:
                    good.append(start)
                    found[int(np.searchsorted(offsets, start, side="right")) - 1] |= items
            if good:
                hit |= cover(np.array(good), size, len(flat))
        return [(hit[a:b], f) for a, b, f in zip(offsets, offsets[1:], found, strict=False)]


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's items with a part number, so that no part holds much more than ``part_bytes``."""
    items = texts_of(benchmark, item_col, text_col).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n = 1 + int(total) // part_bytes
    return items.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def find_hits(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, part_bytes: int = PART_BYTES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: n_words, ``spans`` of hit words (start, end), n_hit, and the sorted ``items`` found.

    A window is ``width`` consecutive words of an item, or the whole item if it has fewer
    words but not none. The benchmark is read on the driver in parts of bounded size, and
    each part is broadcast; with more than one part the documents are scanned once for
    each and the spans of a document united. Null texts have no words, null items and
    items without words no windows; rows with null or repeated ids each give their row.
    ``keep`` names columns to carry along.
    """
    found = _found(df, benchmark, id_col, text_col, item_col, item_text_col, width, part_bytes, keep)
    return found.select("doc_id", "n_words", "spans", "n_hit", "items", *(F.col(f"more_{i}").alias(c) for i, c in enumerate(keep)))


def _found(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, part_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """The findings, with the columns of ``keep`` called more_0, more_1, ..."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = "".join(f", more_{i} {fields[c]}" for i, c in enumerate(keep))
    shape = f"doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>{kept}"
    items, n = parts_of(benchmark, item_col, item_text_col, part_bytes)
    texts, context = texts_of(df, id_col, text_col, *keep), df.sparkSession.sparkContext

    def scan(part: int) -> DataFrame:
        rows = [(r.doc_id, r.text) for r in items.where(F.col("part") == part).toLocalIterator()]
        windows = context.broadcast(Windows([r for r in rows if r[0] is not None], width))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                words = normal_words(piece.column("text").to_pylist())
                found = windows.value.find(words)
                spans = [[{"start": int(a), "stop": int(b)} for a, b in zip(*runs_of(hit), strict=True)] if hit.any() else [] for hit, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                        pa.array([sorted(f) for _, f in found], pa.list_(pa.int64())),
                        *(piece.column(i) for i in range(2, piece.num_columns)),
                    ],
                    names=["doc_id", "n_words", "spans", "items", *piece.schema.names[2:]],
                )

        return texts.mapInArrow(probe, shape)

    if n == 1:
        found = scan(0)
    else:
        texts = texts.withColumn(f"more_{len(keep)}", F.xxhash64("text"))
        shape += f", more_{len(keep)} long"
        found = united([scan(p) for p in range(n)], len(keep))
    return found.withColumn("n_hit", hit_words(F.col("spans")))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long"))


def united(scans: list[DataFrame], kept: int) -> DataFrame:
    """The findings of all parts per document: spans merged, items joined.

    Documents are told apart by id and text; the same row twice has the same findings, and
    comes back as often as the first scan has it.
    """
    mark = f"more_{kept}"
    hits = [s.where(F.size("items") > 0).select("doc_id", mark, "spans", "items") for s in scans[1:]]
    rest = hits[0]
    for more in hits[1:]:
        rest = rest.unionByName(more)
    rest = rest.groupBy(F.col("doc_id").alias("id2"), F.col(mark).alias("mark2")).agg(F.flatten(F.collect_set("spans")).alias("spans2"), F.flatten(F.collect_set("items")).alias("items2"))
    both = scans[0].join(rest, F.col("doc_id").eqNullSafe(F.col("id2")) & F.col(mark).eqNullSafe(F.col("mark2")), "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("spans2", F.array().cast("array<struct<start:int,stop:int>>"))))

    def merge(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        apart = (F.size(done) == 0) | (last["stop"] < span["start"])
        return F.when(F.size(done) == 0, F.array(span)).when(apart, F.concat(done, F.array(span))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown)))

    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), merge)
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("items2", F.array().cast("array<bigint>")))))
    return both.withColumn("spans", merged).withColumn("items", items).drop("id2", "mark2", "spans2", "items2", mark)


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The documents without any hit, with all their columns, whatever their names.

    A null or empty text has no words and stays; rows with null or repeated ids are judged
    each by its own text. Without benchmark items everything stays.
    """
    found = _found(df, benchmark, id_col, text_col, item_col, item_text_col, width, part_bytes, tuple(df.columns))
    return found.where(F.size("items") == 0).select(*(F.col(f"more_{i}").alias(c) for i, c in enumerate(df.columns)))


def remove_spans(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text without the hit words, and the rest of the text unchanged.

    A hit span goes from its first word's first byte to its last word's last byte.
    A null text stays null; null and repeated ids are kept, one row for each row.
    """
    spans = find_hits(df, benchmark, id_col, text_col, keep=(text_col,), **options).withColumnRenamed(text_col, "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "body"):
            out = []
            for text, hit in zip(piece.column("body").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                out.append(text if text is None or not hit else _without(text, hit))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return spans.select("doc_id", "body", "spans").mapInArrow(cut, "doc_id long, text string")


def _without(text: str, spans: list[dict]) -> str:
    data = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    starts, ends = runs_of(word)
    out, at = [], 0
    for span in spans:
        out.append(data[at : starts[span["start"]]])
        at = int(ends[span["stop"] - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digest of the findings: the items sorted as strings and joined by commas."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
