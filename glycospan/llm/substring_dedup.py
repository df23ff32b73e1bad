"""Removal of word sequences that also stand in an earlier document, by fixed-block anchors.

Every document's words are cut into blocks of 25, each of which is a reference. A window of 50
words, wherever it begins, holds a whole block of the document it is compared with; so each
text is probed with the hash of every 25 words, and a hash that is a block somewhere and occurs
twice is an anchor. Windows around an anchor are extended to all 50 words and compared
across documents; runs of equal windows are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.llm import packed
from glycospan.llm.common import cover, inside, partitions, slices, texts_of, window_hashes, word_codes, word_hashes, words_of

WINDOW = 50
#: Bytes of text whose probes are packed together, so that equal ones are sent once.
TOGETHER = 12 << 20
#: Bytes of an anchor's hash that are sent; its bucket adds to them. A chance hit costs a comparison only.
ANCHOR_BYTES = 4


def hashed_words(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts)."""
    codes, distinct, offsets = word_codes(words_of(texts))
    return (word_hashes(distinct, seed)[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def _row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def anchors(texts: DataFrame, block: int, buckets: int) -> DataFrame:
    """Probes for other tasks (packed, flag: is a reference block), and the hits that are seen here already.

    Of equal probes only one leaves the task, flagged if any of them is a block; probes
    equal to another one here are hits already.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=TOGETHER):
            values, offsets = [], [np.zeros(1, np.int64)]
            for small in slices([part]):
                v, o = hashed_words(small.column("text").to_pylist())
                values.append(v)
                offsets.append(o[1:] + offsets[-1][-1])
            values, offsets = np.concatenate(values), np.concatenate(offsets)
            hashes = window_hashes(values, block)
            at = np.flatnonzero(inside(offsets, block, len(hashes)))
            if not len(at):
                continue
            hashes, row = hashes[at], _row_of(offsets, at)
            place = at - offsets[row]
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
            group = np.cumsum(new) - 1
            flagged = np.bincount(group, place[order] % block == 0) > 0
            one = np.sort(order[new])
            flag = np.zeros(len(at), bool)
            flag[order[new]] = flagged
            again = np.sort(order[(np.bincount(group) > 1)[group]])
            ids, marks = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
            bucket = ((hashes[one] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            for batch in packed.pack(hashes[one], bucket, row[one], place[one], flag[one], ids, marks, ANCHOR_BYTES):
                yield packed.filled(batch)
            if len(again):
                yield packed.filled(packed.places(row[again], place[again], ids, marks, buckets))

    return texts.mapInArrow(probe, packed.BOTH)


def split(offered: DataFrame, work: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """All places of each document: those found before, and those that ``work`` finds in each bucket's rows.

    Both kinds of rows come from one pass over the texts. The rows of a bucket go to one
    task; what it finds, packed for the tasks that gather it, goes on with the rest.
    """

    def group(table: pa.Table) -> pa.Table:
        done = table.filter(pc.is_null(table["bucket"])).select([c.split()[0] for c in packed.SPOTS.split(", ")])
        sent = table.filter(pc.is_valid(table["bucket"]))
        return pa.concat_tables([done, pa.Table.from_batches([work(sent)])]) if sent.num_rows else done

    found = offered.withColumn("key", F.coalesce("bucket", "dest")).groupBy("key").applyInArrow(group, packed.SPOTS)
    return found.groupBy("dest").applyInArrow(packed.gather, "id2 long, mark2 long, places array<int>")


def find_anchors(sent: pa.Table, tasks: int) -> pa.RecordBatch:
    """Probes of a bucket that occur twice or more, a reference block among them."""
    hashes, doc, place, flag, ids, marks = packed.unpack(sent, ANCHOR_BYTES)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    group = np.cumsum(new) - 1
    good = (np.bincount(group) > 1) & (np.bincount(group, flag[order]) > 0)
    hit = np.sort(order[good[group]])
    return packed.places(doc[hit], place[hit], ids, marks, tasks)


def with_places(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The texts with their places. The keys are never null, so that both joins of a query share one exchange of the texts."""
    own = (F.coalesce("doc_id", F.lit(0)) == F.col("id2")) & (F.col("mark") == F.col("mark2"))
    return texts.join(found, own, how).select(*texts.columns, "places")


def marked(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """doc_id, text, more columns, and a hash of the text, which tells apart different texts with one id.

    Rows without an id have marks that no others have, so they never meet the places of others.
    """
    mark = F.when(F.col("doc_id").isNull(), F.lit(1 << 40)).otherwise(F.coalesce(F.hash("text"), F.lit(0)).cast("long"))
    return texts_of(df, id_col, text_col, *keep).withColumn("mark", mark)


def candidates(texts: DataFrame, hits: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """Every window around an anchor, extended to all its words: packed hashes, and windows settled here.

    Of equal windows in a task, those of other documents than the earliest are repeats
    already. All those of the earliest one are sent, as they stand or fall together by
    what other tasks hold.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = part.column("text").to_pylist()
            values, offsets = hashed_words(rows)
            second, _ = hashed_words(rows, 1)
            near = np.zeros(len(values) + 1, np.int64)
            for row, places in enumerate(part.column("places").to_numpy(zero_copy_only=False)):
                at = offsets[row] + np.asarray(places, np.int64)
                np.add.at(near, np.maximum(at - (window - block), offsets[row]), 1)
                np.add.at(near, np.minimum(at + 1, len(values)), -1)
            probes = max(0, len(values) - window + 1)
            at = np.flatnonzero((np.cumsum(near[:probes]) > 0) & inside(offsets, window, probes))
            if not len(at):
                continue
            hashes, row = window_hashes(values, window)[at], _row_of(offsets, at)
            bucket = (window_hashes(second, window)[at] % np.uint64(buckets)).astype(np.int64)
            ids, marks = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
            place = at - offsets[row]
            first, later = _earliest(hashes, bucket, ids[row])
            for batch in packed.pack(hashes[first], bucket[first], row[first], place[first], np.zeros(len(first), bool), ids, marks, 8):
                yield packed.filled(batch)
            if len(later):
                yield packed.filled(packed.places(row[later], place[later], ids, marks, buckets))

    return with_places(texts, hits, "inner").mapInArrow(extend, packed.BOTH)


def _earliest(hashes: np.ndarray, bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all windows of the earliest document for each hash, all windows of later documents)."""
    order = np.lexsort((ids, bucket, hashes))
    h, b, i = hashes[order], bucket[order], ids[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.sort(order[i == least]), np.sort(order[i > least])


def find_repeats(sent: pa.Table, tasks: int) -> pa.RecordBatch:
    """Windows of a bucket that stand in an earlier document too."""
    hashes, doc, place, _, ids, marks = packed.unpack(sent, 8)
    _, later = _earliest(hashes, np.zeros(len(hashes), np.int64), ids[doc])
    return packed.places(doc[later], place[later], ids, marks, tasks)


def find_windows(df: DataFrame, id_col: str, text_col: str, window: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(texts with a mark, the starts of windows that also stand in an earlier document)."""
    block, buckets = window // 2, partitions(df)
    texts = marked(df, id_col, text_col, *keep)
    known = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hits = split(anchors(known, block, buckets), lambda sent: find_anchors(sent, buckets))
    return texts, split(candidates(texts, hits, window, block, buckets), lambda sent: find_repeats(sent, buckets))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), tidy: bool = True) -> DataFrame:
    """doc_id, text (kept words joined by a space; null stays null), n_words, n_removed, ``spans`` of removed words, and the columns of ``keep``.

    Without ``tidy`` a text that loses nothing stays as it is. A word goes if it lies in ``window`` consecutive words whose sequence also begins in a
    document with a smaller id; judged on the input. Words are runs of other characters
    than the six ASCII spaces, compared as they are. Documents of less than ``window``
    words, empty and null texts lose nothing, nor do rows without an id, which are not
    looked up either. Rows with one id are one document's: they don't remove from each
    other. Windows are compared by 64-bit hashes within buckets of a second hash.
    """
    texts, repeats = find_windows(df, id_col, text_col, window, keep)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    more = [f"more_{i}" for i in range(len(keep))]
    kept_columns = "".join(f", {m} {fields[c]}" for m, c in zip(more, keep, strict=True))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                words = words_of([text])[0]
                gone = cover(np.array(places, np.int64), window, len(words)) if places else np.zeros(len(words), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist()
                kept, at = [], 0
                for a, b in edges:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((text if text is None or not edges and not tidy else b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), int(gone.sum()), [{"start": a, "stop": b} for a, b in edges]))
            text, n, removed, spans = zip(*rows, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *(pa.array(c, k) for c, k in zip((text, n, removed, spans), kinds, strict=True)), *(part.column(m) for m in more)], names=["doc_id", "mark", "text", "n_words", "n_removed", "spans", *more])

    removed = with_places(texts, repeats, "left").mapInArrow(remove, f"doc_id long, mark long, text string, n_words long, n_removed long, spans array<struct<start:int,stop:int>>{kept_columns}")
    return removed.select("doc_id", "text", "n_words", "n_removed", "spans", *(F.col(m).alias(c) for m, c in zip(more, keep, strict=True)))


def digests(removed: DataFrame) -> DataFrame:
    """Counts and the hexadecimal SHA-256 of the kept words joined by a space."""
    return removed.selectExpr("doc_id", "n_words", "n_removed", "sha2(coalesce(text, ''), 256) AS kept_sha256")
