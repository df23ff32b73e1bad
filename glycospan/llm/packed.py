"""Hashes of places in documents, packed many to a row, so that a shuffle moves few bytes for each place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from glycospan.llm.common import mixed

#: bucket; hashes cut to some bytes; documents (id, mark, number of places); gaps between places; flags.
SCHEMA = "bucket int, hashes binary, ids binary, marks binary, counts binary, gaps binary, wide binary, flags binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Places for one task to gather: documents (id, mark, number of places) and the places, in words or bytes.
SPOTS = "dest int, spot_ids binary, spot_marks binary, spot_counts binary, spots binary"
_SPOTS = [c.split()[0] for c in SPOTS.split(", ")]
BOTH = f"{SCHEMA}, {SPOTS}"
_KINDS = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in BOTH.split(", ")])


def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all columns of BOTH, those that it lacks null."""
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in _KINDS], schema=_KINDS)


def pack(hashes: np.ndarray, bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, flag: np.ndarray, ids: np.ndarray, marks: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows for a bucket each. ``doc`` indexes ids and marks; (doc, place) is in ascending order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    columns: list[list] = [[] for _ in _NAMES]
    small = np.ascontiguousarray(hashes[order]).view(np.uint8).reshape(-1, 8)[:, :width]
    doc, place, flag = doc[order], place[order], flag[order]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a == b:
            continue
        own = doc[a:b]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        gaps = np.diff(place[a:b], prepend=0)
        gaps[starts] = place[a:b][starts]
        row = (
            int(bucket[a]),
            small[a:b].tobytes(),
            ids[own[starts]].tobytes(),
            marks[own[starts]].astype(np.int32).tobytes(),
            np.diff(np.append(starts, b - a)).astype(np.uint32).tobytes(),
            np.minimum(gaps, 255).astype(np.uint8).tobytes(),
            gaps[gaps >= 255].astype(np.uint32).tobytes(),
            np.packbits(flag[a:b]).tobytes(),
        )
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_NAMES)


def unpack(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """(hashes, doc, place, flag, ids, marks) of all rows; ``doc`` indexes ids and marks."""
    rows = table.select(_NAMES[1:]).to_pylist()
    hashes = np.zeros((sum(len(r["hashes"]) for r in rows) // width, 8), np.uint8)
    hashes[:, :width] = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, width)
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int64)
    marks = np.frombuffer(b"".join(r["marks"] for r in rows), np.int32).astype(np.int64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint32).astype(np.int64)
    gaps = np.frombuffer(b"".join(r["gaps"] for r in rows), np.uint8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(b"".join(r["wide"] for r in rows), np.uint32)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    place = total - np.repeat(total[first] - gaps[first], counts)
    flag = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(r["gaps"])) for r in rows]).astype(bool)
    return hashes.reshape(-1).view(np.uint64), doc, place, flag, ids, marks


def places(doc: np.ndarray, place: np.ndarray, ids: np.ndarray, marks: np.ndarray, tasks: int) -> pa.RecordBatch:
    """Rows of SPOTS, one for each of the ``tasks`` that gather a document's places; doc is in ascending order."""
    dest = (mixed(ids.astype(np.uint64) ^ mixed(marks.astype(np.uint64))) % np.uint64(tasks)).astype(np.int64)[doc] if len(doc) else doc
    order = np.argsort(dest, kind="stable")
    dest, doc, place = dest[order], doc[order], place[order].astype(np.int32)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(dest)) + 1, [len(dest)])) if len(dest) else np.zeros(1, np.int64)
    rows: list[list] = [[] for _ in _SPOTS]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = doc[a:b]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        values = (int(dest[a]), ids[own[starts]].tobytes(), marks[own[starts]].astype(np.int32).tobytes(), np.diff(np.append(starts, b - a)).astype(np.uint32).tobytes(), place[a:b].tobytes())
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=_SPOTS)


def gather(table: pa.Table) -> pa.Table:
    """One row (id2, mark2, places) for each document of a task's SPOTS rows."""
    ids, marks, counts, spots = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in zip(_SPOTS[1:], (np.int64, np.int32, np.uint32, np.int32), strict=True))
    piece = np.lexsort((marks, ids))
    new = np.ones(len(piece), bool)
    new[1:] = (ids[piece][1:] != ids[piece][:-1]) | (marks[piece][1:] != marks[piece][:-1])
    counts = counts.astype(np.int64)
    begin = np.cumsum(counts) - counts
    sizes = counts[piece]
    out = np.cumsum(sizes) - sizes
    flat = spots[np.repeat(begin[piece] - out, sizes) + np.arange(int(sizes.sum()))]
    ends = np.append(out[new], len(flat)).astype(np.int32)
    return pa.table([pa.array(ids[piece][new]), pa.array(marks[piece][new].astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id2", "mark2", "places"])
