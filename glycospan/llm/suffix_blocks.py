"""Sorting the suffixes of a text block by their first bytes, with difference-cover ranks for long ties."""

from __future__ import annotations

import numpy as np

#: Any two residues have a distance to a common member of the cover: a perfect difference set.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes that are compared directly before the ranks decide.
HEAD = 32


def _shifts() -> np.ndarray:
    """shift[i, j]: the least d with i + d and j + d both in the cover, modulo the period."""
    table = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        hit = np.array([(r + d) % PERIOD in COVER for r in range(PERIOD)])
        table[np.ix_(hit, hit)] = d
    if (table < 0).any():
        raise ValueError("not a difference cover")
    return table


SHIFT = _shifts()


def words(text: np.ndarray) -> np.ndarray:
    """At each byte the next eight as a number whose order is that of the bytes."""
    out = np.zeros(len(text) - 7, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | text[i : i + len(out)]
    return out


class CoverRanks:
    """Order of the suffixes at cover positions by their first ``depth`` bytes, and how far neighbours agree."""

    def __init__(self, eight: np.ndarray, places: np.ndarray, depth: int):
        columns = [eight[places + 8 * i] for i in range(-(-depth // 8))]
        order = np.lexsort(columns[::-1])
        self.rank = np.full(len(eight), -1, np.int32)
        self.rank[places[order]] = np.arange(len(order))
        agree = np.zeros(len(order), np.uint8)  # with the one before
        going = np.arange(1, len(order))
        for column in columns:
            a = column[order]
            x = a[going] ^ a[going - 1]
            same = np.sum([x < np.uint64(1) << np.uint64(64 - 8 * k) for k in range(1, 8)], axis=0).astype(np.uint8)
            agree[going] += np.where(x == 0, 8, same).astype(np.uint8)
            going = going[x == 0]
        self.levels = [agree]
        while 1 << len(self.levels) < len(agree):  # ranks are up to len(agree) - 1 apart
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def common(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes of ranks ``low`` < ``high`` have in common, up to the depth."""
        power = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), np.uint8)
        for p in np.unique(power).tolist():
            at = np.flatnonzero(power == p)
            level = self.levels[p]
            out[at] = np.minimum(level[low[at] + 1], level[high[at] + 1 - (1 << p)])
        return out


def classes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A number for each start, equal for starts whose next ``depth`` bytes are equal.

    The suffixes are put in buckets by their first 32 bytes. Within a bucket a pivot is
    compared with all others by the ranks of two cover positions at the same distance,
    which splits the bucket in three until all its suffixes are told apart or equal.
    Starts that are alone in their bucket get numbers of their own.
    """
    padded = np.concatenate((text, np.zeros(depth + PERIOD + 16, np.uint8)))
    eight = words(padded)
    head = [eight[starts + 8 * i] for i in range(HEAD // 8)]
    order = np.lexsort(head[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in head:
        sorted_column = column[order]
        new[1:] |= sorted_column[1:] != sorted_column[:-1]
    bucket = np.empty(len(order), np.int64)
    bucket[order] = np.cumsum(new) - 1
    out = bucket.copy()
    following = len(order)
    active = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    if not len(active):
        return out
    near = np.zeros(len(padded) + 1, np.int64)
    np.add.at(near, starts[active], 1)
    np.add.at(near, starts[active] + PERIOD, -1)
    residue = np.arange(len(padded)) % PERIOD
    ranks = CoverRanks(eight, np.flatnonzero((np.cumsum(near[:-1]) > 0) & np.isin(residue, COVER)), depth)
    group = np.unique(bucket[active], return_inverse=True)[1]
    while len(active):
        by_group = np.argsort(group, kind="stable")
        active, group = active[by_group], group[by_group]
        sizes = np.bincount(group)
        firsts = np.cumsum(sizes) - sizes
        pivot = np.repeat(active[firsts + sizes // 2], sizes)
        a, b = starts[active], starts[pivot]
        shift = SHIFT[a % PERIOD, b % PERIOD]
        ra, rb = ranks.rank[a + shift], ranks.rank[b + shift]
        common = np.full(len(a), depth, np.int64)
        differ = np.flatnonzero(ra != rb)
        common[differ] = ranks.common(np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ])
        equal = common + shift >= depth
        out[active[equal]] = following + group[equal]
        following += len(sizes)
        side = 2 * group + (ra > rb)
        active, side = active[~equal], side[~equal]
        alone = np.bincount(side)[side] == 1 if len(side) else np.zeros(0, bool)
        out[active[alone]] = following + np.arange(int(alone.sum()))
        following += int(alone.sum())
        active = active[~alone]
        group = np.unique(side[~alone], return_inverse=True)[1]
    return out
