"""Removal of byte strings that also begin earlier in the corpus, by blockwise suffix sorting.

Only suffixes that can have a twin are sorted. Each window of 100 bytes names one of its
32-byte strings, the one with the least hash, as its anchor; equal windows have equal
anchors at equal distances. Windows whose anchor occurs once are settled. The others are
put in buckets by their anchor, with just the bytes around them, and each task sorts
its suffixes block by block: by their first bytes, and by the ranks of a difference cover
where these tie (see suffix_blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycospan.llm import packed, suffix_blocks
from glycospan.llm.common import mixed, partitions, slices, window_hashes
from glycospan.llm.substring_dedup import TOGETHER, marked, split, with_places

WINDOW, ANCHOR = 100, 32
#: Window starts that are worked on at a time.
BLOCK = 1 << 20
#: Suffixes that are sorted at a time, unless one anchor has more.
SORTED = 1 << 19
ANCHOR_BYTES = 4
# The columns of packed rows, as runs of windows use them: bytes, ids, marks, lengths of runs, hashes of anchors, starts, distances to the anchor.
_NAMES = ["bucket", "hashes", "ids", "marks", "counts", "gaps", "wide", "flags"]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def anchored(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (hash, place of the anchor, first window, last window).

    Of equal least hashes in a window the first one is the anchor. Windows that reach
    over the end of a text are in no run.
    """
    reach, low = window - anchor + 1, np.uint64((2 << 20) - 1)
    n = len(data) - window + 1
    found = [[], [], [], []]
    if n <= 0:
        return tuple(np.zeros(0, np.uint64 if i == 0 else np.int64) for i in range(4))
    cut = np.zeros(n + 1, bool)  # no run goes on here
    cut[offsets[offsets <= n]] = True
    bad = np.zeros(n + 1, np.int64)
    ends = offsets[1:-1]
    np.add.at(bad, np.clip(ends - window + 1, 0, n), 1)
    np.add.at(bad, np.clip(ends, 0, n), -1)
    whole = np.cumsum(bad[:n]) == 0
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK)
        hashes = window_hashes(data[begin : end + window - 1].astype(np.uint64), anchor)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: end - begin], least[reach - span : reach - span + end - begin])
        at = (least & low).astype(np.int64)
        own = whole[begin:end]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))) | cut[begin:end]
        first = np.flatnonzero(new)
        last = np.append(first[1:], end - begin) - 1
        keep = own[first]
        first, last = first[keep], last[keep]
        for column, values in zip(found, (hashes[at[first]], at[first] + begin, first + begin, last + begin), strict=True):
            column.append(values)
    return tuple(map(np.concatenate, found))


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))


def find_anchors(texts: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """Anchors for other tasks (packed), and those that occur twice here already. Of equal ones only one is sent."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=TOGETHER):
            found, done = [], 0
            for small in slices([part]):
                data, offsets = joined(small.column("text").to_pylist())
                hashes, at, _, _ = anchored(data, offsets, window, anchor)
                row = np.searchsorted(offsets, at, side="right") - 1
                found.append((hashes, row + done, at - offsets[row]))
                done += small.num_rows
            hashes, row, place = map(np.concatenate, zip(*found, strict=True))
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
            one = np.sort(order[new])
            again = np.sort(order[(np.diff(np.append(np.flatnonzero(new), len(order))) > 1)[np.cumsum(new) - 1]])
            ids, marks = _keys(part)
            bucket = ((hashes[one] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            for batch in packed.pack(hashes[one], bucket, row[one], place[one], np.zeros(len(one), bool), ids, marks, ANCHOR_BYTES):
                yield packed.filled(batch)
            if len(again):
                yield packed.filled(packed.places(row[again], place[again], ids, marks, buckets))

    return texts.mapInArrow(probe, packed.BOTH)


def repeated_anchors(sent: pa.Table, tasks: int) -> pa.RecordBatch:
    """Anchors of a bucket that occur twice or more."""
    hashes, doc, place, _, ids, marks = packed.unpack(sent, ANCHOR_BYTES)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    group = np.cumsum(new) - 1
    hit = np.sort(order[(np.bincount(group) > 1)[group]])
    return packed.places(doc[hit], place[hit], ids, marks, tasks)


def _spans(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, stops: np.ndarray, tasks: int) -> pa.RecordBatch:
    """Places with the starts and stops of removed bytes in turn."""
    order = np.lexsort((starts, marks, ids))
    ids, marks = ids[order], marks[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    flat = np.stack((starts[order], stops[order]), axis=1).reshape(-1)
    return packed.places(np.repeat(np.cumsum(new) - 1, 2), flat, ids[new], marks[new], tasks)


def _earliest(contexts: list, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of the runs with equal contexts, which runs are later than an equal one)."""
    number = {}
    group = np.fromiter((number.setdefault(c, len(number)) for c in contexts), np.int64, len(contexts))
    order = np.lexsort((starts, ids, group))
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    first = order[new][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = (ids[order] != ids[first]) | (starts[order] != starts[first])  # the same row twice isn't
    return np.sort(order[new]), later


def contexts(texts: DataFrame, hits: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """Runs of windows with a repeated anchor and their bytes, packed; of equal runs the earliest is sent and the rest removed."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=TOGETHER):
            columns, bodies, done = [], [], 0
            for small in slices([part]):
                data, offsets = joined(small.column("text").to_pylist())
                hashes, at, first, last = anchored(data, offsets, window, anchor)
                places = small.column("places")
                flat = pc.list_flatten(places).to_numpy(zero_copy_only=False).astype(np.int64)
                wanted = np.zeros(len(data) + 1, bool)
                wanted[flat + np.repeat(offsets[:-1], pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))] = True
                use = wanted[at]
                hashes, at, first, last = hashes[use], at[use], first[use], last[use]
                row = np.searchsorted(offsets, first, side="right") - 1
                columns.append((hashes, row + done, first - offsets[row], at - first, last - first + 1))
                whole = data.tobytes()
                bodies += [whole[a:b] for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)]
                done += small.num_rows
            hashes, row, start, delta, count = map(np.concatenate, zip(*columns, strict=True))
            if not len(hashes):
                continue
            ids, marks = (x[row] for x in _keys(part))
            one, later = _earliest(list(zip(bodies, delta.tolist(), strict=True)), ids, start)
            if later.any():
                yield packed.filled(_spans(ids[later], marks[later], start[later], (start + count + window - 1)[later], buckets))
            bucket = (mixed(hashes[one]) % np.uint64(buckets)).astype(np.int64)
            order = one[np.argsort(bucket, kind="stable")]
            sizes = np.bincount(bucket, minlength=0)
            rows, at = [[] for _ in _NAMES], 0
            for b in np.flatnonzero(sizes).tolist():
                own = order[at : at + sizes[b]]
                at += sizes[b]
                row_values = (
                    b,
                    b"".join(bodies[i] for i in own.tolist()),
                    ids[own].tobytes(),
                    marks[own].astype(np.int32).tobytes(),
                    count[own].astype(np.uint8).tobytes(),
                    hashes[own].tobytes(),
                    start[own].astype(np.uint32).tobytes(),
                    delta[own].astype(np.uint8).tobytes(),
                )
                for column, value in zip(rows, row_values, strict=True):
                    column.append(value)
            yield packed.filled(pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=_NAMES))

    return with_places(texts, hits, "inner").mapInArrow(cut, packed.BOTH)


def sorted_repeats(sent: pa.Table, window: int, tasks: int) -> pa.RecordBatch:
    """Spans of a bucket's windows that begin earlier too, by sorting its suffixes block by block."""
    kinds = {"ids": np.int64, "marks": np.int32, "counts": np.uint8, "gaps": np.uint64, "wide": np.uint32, "flags": np.uint8}
    ids, marks, counts, hashes, starts, deltas = (np.frombuffer(b"".join(sent[c].to_pylist()), k) for c, k in kinds.items())
    starts, counts = starts.astype(np.int64), counts.astype(np.int64)
    body = b"".join(sent["hashes"].to_pylist())
    ends = np.cumsum(counts + window - 1)
    bodies = [body[a:b] for a, b in zip((ends - counts - window + 1).tolist(), ends.tolist(), strict=True)]
    one, later = _earliest(list(zip(bodies, deltas.tolist(), strict=True)), ids, starts)
    gone = [(ids[later], marks[later], starts[later], (starts + counts + window - 1)[later])]
    one = one[np.argsort(hashes[one], kind="stable")]
    limits = _blocks(hashes[one], counts[one])
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        own = one[a:b]
        if b - a < 2:
            continue
        text = np.frombuffer(b"".join(bodies[i] for i in own.tolist()), np.uint8)
        n = counts[own]
        base = np.cumsum(n + window - 1) - n - window + 1
        run = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        number = suffix_blocks.classes(text, base[run] + inner, window)
        doc, place = ids[own][run], starts[own][run] + inner
        order = np.lexsort((place, doc, number))
        new = np.ones(len(order), bool)
        new[1:] = number[order][1:] != number[order][:-1]
        first = order[new][np.cumsum(new) - 1]
        repeat = np.zeros(len(order), bool)
        repeat[order] = (doc[order] != doc[first]) | (place[order] != place[first])
        edge = np.ones(len(run), bool)
        edge[1:] = (run[1:] != run[:-1]) | (repeat[1:] != repeat[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(run)) - 1
        begin, end = begin[repeat[begin]], end[repeat[begin]]
        at = own[run[begin]]
        gone.append((ids[at], marks[at], place[begin], place[end] + window))
    return _spans(*(np.concatenate(c) for c in zip(*gone, strict=True)), tasks)


def _blocks(hashes: np.ndarray, counts: np.ndarray) -> list[int]:
    """Cuts between anchors that leave about SORTED suffixes in a block."""
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(counts)))
    limits, filled = [0], 0
    for at in new[1:].tolist():
        if total[at] - filled >= SORTED:
            limits.append(at)
            filled = total[at]
    return [*limits, len(hashes)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, ``kept`` (binary), n_bytes, n_removed and ``spans`` (start, stop) of removed bytes.

    Texts are UTF-8 bytes. A byte goes if it lies in ``window`` bytes of its text that also
    begin earlier: in a text with a smaller id, or further left in a text with the same
    id; judged on the input. Shorter, empty and null texts lose nothing (a null text has
    no bytes). Rows without an id lose nothing and aren't looked up. The same row twice
    loses the same bytes, and neither copy counts as earlier than the other.
    """
    buckets = partitions(df)
    texts = marked(df, id_col, text_col)
    known = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hits = split(find_anchors(known, window, anchor, buckets), lambda sent: repeated_anchors(sent, buckets))
    gone = split(contexts(texts, hits, window, anchor, buckets), lambda sent: sorted_repeats(sent, window, buckets))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_numpy(zero_copy_only=False), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = _merged(places) if places is not None and len(places) else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((b"".join(kept), len(data), sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans]))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
            )

    return with_places(texts, gone, "left").mapInArrow(remove, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>")


def _merged(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in any of the spans, given as starts and stops in turn."""
    pairs = np.asarray(places, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(pairs)) - 1
    return list(zip(pairs[new, 0].tolist(), reach[last].tolist(), strict=True))


def digests(removed: DataFrame) -> DataFrame:
    """Counts and the hexadecimal SHA-256 of the kept bytes."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
