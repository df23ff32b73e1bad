"""Jaccard join of documents' word shingles by multi-match prefixes that are ranked twice.

Shingles have one order for all documents, rare ones first. Two sets that share at least m
shingles share at least j of the first ``n - m + j`` of each, for every j. A document's
prefix is ``n - ceil(t n)`` shingles and k more, so similar documents share k of their
prefixes' shingles at least. The first order is an estimate; the index gives the true number
of entries of each shingle, and by these the prefixes are ordered again: each document leaves
out its k - 1 longest lists, and similar documents still share one of the others. Lists with
the same documents become one. A pair of documents must share as many shingles as both
prefixes allow to ask for before it is verified. Pairs that are already known to be connected
are not looked at again, so a large group of near copies costs few comparisons for each
member and not one for each pair, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glycospan.llm.common import checkpointed, is_empty, mixed, partitions, slices, texts_of, window_hashes, word_codes, word_hashes
from glycospan.llm.components import components

SHINGLE = 3
#: Similarity in hundredths.
SIMILAR = 90
#: Shingles that a prefix is lengthened by.
MATCHES = 8
#: Frequent shingles whose counts are broadcast: a fixed bound of 1.6 MB. Others count as rare.
FREQUENT = 100_000
#: Bytes of text in which a shingle that is counted as frequent must occur twice.
TOGETHER = 12 << 20
#: Pairs of a hub that its text is sent once for.
TOGETHER_NODES = 256
#: Pairs of entries per index entry that are looked at without rounds of hubs before.
LIGHT = 4
#: Lists of more entries have hubs in a round; shorter ones make few pairs for each entry.
LONG = 4
#: Hubs of a list, and hubs that a node is compared with, in a round.
HUBS = 2
#: Share of the work that a round must leave at most for another one to follow.
STALLED = 0.75
#: Bits of the filter of keys whose rows are sent: 4 MB at any size.
KEY_BITS = 1 << 25
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; fewer words than ``width`` are one shingle."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    codes, distinct, offsets = word_codes(words)
    values = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    hashes, out = window_hashes(values, width), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(hashes[a : b - width + 1]))
        else:
            out.append(mixed(window_hashes(values[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a set; documents with equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 5)).view(np.int64))


def prefix(hashes: np.ndarray, counts: np.ndarray, similar: int, matches: int) -> np.ndarray:
    """The shingles of the prefix. ``counts`` are estimated document counts."""
    n = len(hashes)
    least = -(-similar * n // 100)
    return hashes[np.argsort(counts, kind="stable")[: n - least + min(matches, least)]]  # the hashes are in order already


class Counts:
    """Estimated document counts of shingles: those of the frequent ones, and 1 for others."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray):
        self.shingles, self.times = shingles, times
        self.maybe = np.zeros(1 << 22, bool)  # by leading bits: most shingles need no search
        self.maybe[(shingles >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), np.int64)
        look = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        if len(look):
            at = np.minimum(np.searchsorted(self.shingles, hashes[look]), len(self.shingles) - 1)
            hit = self.shingles[at] == hashes[look]
            out[look[hit]] = self.times[at[hit]]
        return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def described(texts: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, n, node) of a document; kind 1: (shingle in node, documents in n) of a task's repeated shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=TOGETHER):
            known, distinct = set(), []
            for small in slices([part]):
                sets = shingle_sets(small.column("text").to_pylist(), width)
                nodes = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int32)), small.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())],
                    names=["kind", "doc_id", "n", "node"],
                )
                for node, hashes in zip(nodes, sets, strict=True):
                    if node not in known:  # copies count once here
                        known.add(node)
                        distinct.append(hashes)
            values, times = np.unique(np.concatenate(distinct), return_counts=True)
            often = times > 1
            if often.any():
                size = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(size, np.int32)), pa.nulls(size, pa.int64()), pa.array(times[often].astype(np.int64)), _signed(values[often])],
                    names=["kind", "doc_id", "n", "node"],
                )

    return texts.mapInArrow(describe, "kind int, doc_id long, n long, node long")


def prefixes(texts: DataFrame, frequent: Counts, width: int, similar: int, matches: int) -> DataFrame:
    """(token, node, n): the index entries of the documents with an id."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            done, found = set(), []
            for hashes in shingle_sets(part.column("text").to_pylist(), width):
                node = digest(hashes)
                if len(hashes) and node not in done:
                    done.add(node)
                    found.append((prefix(hashes, sent.value(hashes), similar, matches), node, len(hashes)))
            if found:
                reach = [len(t) for t, _, _ in found]
                node, size = (np.repeat(np.array([f[k] for f in found], np.int64), reach) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate([t for t, _, _ in found])), pa.array(node), pa.array(size)], names=["token", "node", "n"])

    return texts.where(F.col("doc_id").isNotNull()).mapInArrow(entries, "token long, node long, n long")


def shared_tokens(entries: DataFrame, similar: int, matches: int) -> DataFrame:
    """(node, n, tokens): the prefix tokens of a node that others have too, those of short lists first.

    Nodes with fewer of these than any similar pair shares are left out.
    """
    # one exchange of the entries, in which lists of any length may spill
    token = Window.partitionBy("token")
    lists = entries.withColumns({"low": F.min("node").over(token), "high": F.max("node").over(token), "size": F.count(F.lit(1)).over(token)})
    own = lists.where("low <> high").select("token", "node", "n", "size").distinct().groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("size", "token"))).alias("own"))
    return own.selectExpr("node", "n", "own.token AS tokens").where(f"size(tokens) >= {_matches('n', similar, matches)}")


def merged_lists(packed: DataFrame, similar: int, matches: int) -> DataFrame:
    """(list, node, n, rest, times): the entries of the lists that pairs come up by.

    Each node leaves out its longest lists, one fewer than any similar pair shares. Lists of
    the same nodes are one; ``times`` is their number, and ``rest`` how many of the node's
    tokens stand from the first of them on.
    """
    every = packed.select("node", "n", F.size("tokens").alias("all"), F.posexplode("tokens").alias("i", "token"))
    leading = every.selectExpr("token", "node", "n", "all - i AS rest").where(f"rest >= {_matches('n', similar, matches)}")
    token = Window.partitionBy("token")
    named = leading.withColumns({"size": F.count(F.lit(1)).over(token), "nodes": F.bit_xor(F.xxhash64("node")).over(token)}).where("size > 1")
    return named.groupBy(F.xxhash64("nodes", "size").alias("list"), "node", "n").agg(F.max("rest").alias("rest"), F.count(F.lit(1)).alias("times"))


def _similar(one: np.ndarray, two: np.ndarray, similar: int) -> bool:
    """Whether two sorted sets share ``similar`` hundredths of their union."""
    small, large = sorted((one, two), key=len)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= similar * (len(one) + len(two) - shared)


def _with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key occurs in ``keys``, and few others: a bitmap of hashed keys keeps the rest out of a shuffle."""
    bit = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    bits = keys.select(bit.alias("bit")).distinct().select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("spot"))
    maps = bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("map"))  # 4 KB a bucket
    found = df.withColumns({"bucket": F.bitmap_bucket_number(bit), "spot": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "bucket")
    return found.where("shiftright(CAST(conv(hex(substring(map, CAST(spot div 8 AS int) + 1, 1)), 16, 10) AS int), CAST(spot % 8 AS int)) & 1 = 1").select(*df.columns)


def verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Each pair goes to its node with more pairs, the hub. A hub's text is sent once for each
    ``TOGETHER_NODES`` of its pairs, ahead of the texts of the other nodes, which are then
    compared as they come. Texts are moved and not sets: they are smaller, and compress.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("degree"))
    one, two = (degrees.select(F.col("end").alias(c), F.col("degree").alias(f"degree_{c}")) for c in "ab")
    led = pairs.join(one, "a").join(two, "b").withColumn("lead", F.expr("degree_a >= degree_b"))
    led = led.selectExpr("IF(lead, a, b) AS hub", "IF(lead, b, a) AS node", f"IF(lead, degree_a, degree_b) div {TOGETHER_NODES} + 1 AS parts")
    members = led.selectExpr("hub", "pmod(xxhash64(node), parts) AS part", "1 AS follows", "node")
    leads = members.select("hub", "part").distinct().selectExpr("hub", "part", "0 AS follows", "hub AS node")
    routes = members.unionByName(leads).join(firsts, "node")
    routes = checkpointed(routes)  # read for the filter and for the join
    sent = _with_keys(texts, routes, "doc_id").join(routes, "doc_id").select("hub", "part", "follows", "node", "text")
    sent = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "follows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for rows in slices(batches):
            sets = shingle_sets(rows.column("text").to_pylist(), width)
            found = []
            for hub, follows, node, hashes in zip(*(rows.column(c).to_pylist() for c in ("hub", "follows", "node")), sets, strict=True):
                if digest(hashes) != node:  # another text with the same id
                    continue
                if not follows:
                    current, own = hub, hashes
                elif hub == current and _similar(own, hashes, similar):
                    found.append((min(hub, node), max(hub, node)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return sent.mapInArrow(compare, "a long, b long").distinct()


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similar: int = SIMILAR, matches: int = MATCHES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are runs of other characters than the six ASCII spaces, with A-Z in lower case.
    Documents link when 100 times the intersection of their sets of ``width``-word shingles
    is at least ``similar`` times the union. component_id is the smallest doc_id that links
    reach. Texts that are null or have no words have empty sets and link with nothing; so do
    rows without an id, whose component is null. Repeated rows link like any copies.
    Shingles and sets are compared by 64-bit hashes.

    Steps: (1) sizes, set digests and frequent shingles; (2) index entries of the prefixes,
    of which only tokens of two or more nodes stay; (3) their lists, without the longest of
    each node; (4) while lists are long, rounds in which each node is compared with a few hubs,
    nodes that come first in the lists by a hash of the round, that it isn't connected with;
    (5) all remaining pairs of different components that share enough prefix tokens, a part of
    them at a time; (6) components.
    """
    texts = texts_of(df, id_col, text_col)
    seen = checkpointed(described(texts, width))
    docs = seen.where("kind = 0").select("doc_id", "n", "node")
    often = seen.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(frequent)
    listed = sorted((r.node % (1 << 64), r.n) for r in often.toLocalIterator())
    counts = Counts(np.array([x for x, _ in listed], np.uint64), np.array([n for _, n in listed], np.int64))

    packed = checkpointed(shared_tokens(prefixes(texts, counts, width, similar, matches), similar, matches))
    index = checkpointed(merged_lists(packed, similar, matches))
    if is_empty(index):
        return _result(docs, None)
    firsts = docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    firsts = checkpointed(firsts.join(index.select("node").distinct(), "node", "left_semi"))
    lists = index.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LONG)
    long = checkpointed(index.join(lists.select("list"), "list"))

    def counted(pairs: DataFrame) -> DataFrame:
        return checkpointed(_counted(pairs, packed, similar, matches))

    def verify(pairs: DataFrame) -> DataFrame:
        return checkpointed(verified(pairs, firsts, texts, width, similar))

    links, tried, roots, turn, before = None, None, firsts.select("node", F.col("node").alias("root")), 0, None
    entries_left, nodes = index.count(), firsts.count()
    while True:
        labelled = long.join(roots, "node")
        work = remaining_work(labelled)
        if work <= LIGHT * entries_left or before is not None and work > STALLED * before:
            break
        pairs = hub_pairs(labelled, turn, HUBS, similar, matches)
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verify(counted(pairs))
        if not is_empty(found):
            links = found if links is None else links.unionByName(found)
            roots = _roots(firsts, links)
        turn, before = turn + 1, work

    left, most = other_pairs(index.join(roots, "node"), similar, matches), 1
    left = counted(checkpointed(left if tried is None else left.join(tried, ["a", "b"], "left_anti")))
    while True:
        # many pairs: few of each node first, as those that then are connected need no look
        some = left if left.count() <= nodes else _some_each(left, most)
        most *= 8
        found = verify(some)
        if not is_empty(found):
            links = found if links is None else links.unionByName(found)
        if some is left:
            return _result(docs, links)
        roots = _roots(firsts, links) if links is not None else roots
        left = checkpointed(_apart(left.join(some, ["a", "b"], "left_anti"), roots))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of different components."""
    first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").where("root_a <> root_b").select("a", "b")


def _some_each(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` pairs that each node asks for, by a hash that no order of rows changes."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("a", "b"), "a", "b"))
    return checkpointed(ends.withColumn("place", place).where(F.col("place") <= most).select("a", "b").distinct())


def _roots(firsts: DataFrame, links: DataFrame) -> DataFrame:
    tied = components(links)
    return checkpointed(firsts.select("node").join(tied, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def hub_pairs(labelled: DataFrame, turn: int, count: int, similar: int, matches: int) -> DataFrame:
    """For each node of the lists some hubs of other components: (a, b).

    The hubs of a list are the nodes that come first in ``count`` orders of the turn. Of the
    hubs of its lists a node takes the ``count`` that it meets most often.
    """
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("order"), F.col("node").alias("hub"), F.col("root").alias("root1"), F.col("n").alias("n1"), F.col("rest").alias("rest1"))) for k in range(count)]
    hubs = labelled.groupBy("list").agg(F.array(*orders).alias("hubs")).select("list", F.explode("hubs").alias("h"))
    hubs = hubs.select("list", "h.hub", "h.root1", "h.n1", "h.rest1").distinct()
    met = _first(labelled.join(hubs, "list").where("root <> root1"), similar, matches)
    times = met.groupBy("node", "hub").agg(F.sum("times").alias("times"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), F.xxhash64("hub", F.lit(turn)), "hub"))
    best = times.withColumn("place", place).where(F.col("place") <= count)
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _counted(pairs: DataFrame, packed: DataFrame, similar: int, matches: int) -> DataFrame:
    """The pairs (a, b) that share as many prefix tokens as both prefixes allow to ask for."""
    near = _with_keys(packed, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    one, two = (near.select(F.col("node").alias(c), *(F.col(x).alias(x + k) for x in ("n", "tokens"))) for c, k in (("a", ""), ("b", "1")))
    met = pairs.join(one, "a").join(two, "b")
    return met.where(f"size(array_intersect(tokens, tokens1)) >= {_asked(similar, matches)}").select("a", "b")


def _least(similar: int) -> str:
    """The least intersection of similar sets of sizes n and n1."""
    return f"(({similar} * (n + n1) + {99 + similar}) div {100 + similar})"


def _matches(n: str, similar: int, matches: int) -> str:
    """What a prefix is lengthened by: ``matches``, or all that a small set has left."""
    return f"least({matches}, ({similar} * {n} + 99) div 100)"


def _asked(similar: int, matches: int) -> str:
    """Tokens that the prefixes of similar sets of sizes n and n1 share at least.

    Sets that share m hold in common j of the first n - m + j and n1 - m + j; j is the most
    for which both prefixes are so long.
    """
    spare = (f"{_matches(n, similar, matches)} - ({similar} * {n} + 99) div 100" for n in ("n", "n1"))
    return f"(least({', '.join(spare)}) + {_least(similar)})"


def _first(met: DataFrame, similar: int, matches: int) -> DataFrame:
    """Entries of nodes of similar size whose token may be the first that they share: as many as they must share are left from there on."""
    return met.where(f"100 * least(n, n1) >= {similar} * greatest(n, n1) AND least(rest, rest1) >= {_asked(similar, matches)}")


def _minority(labelled: DataFrame) -> DataFrame:
    """The index entries outside their list's largest component, with that component and the list's number of entries."""
    sizes = labelled.groupBy("list", "root").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("list").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return labelled.join(major.select("list", F.col("m.root").alias("major"), "size"), "list").where("root <> major")


def remaining_work(labelled: DataFrame) -> int:
    """Pairs of index entries that other_pairs would look at."""
    return _minority(labelled).agg(F.sum("size")).first()[0] or 0


def other_pairs(labelled: DataFrame, similar: int, matches: int) -> DataFrame:
    """All pairs of nodes of different components that may share enough tokens: (a, b).

    In each list, entries outside the largest component meet the entries of other components,
    each pair once. A pair comes up by the first token that it shares, in the order of the
    lists; it stands early in both sets.
    """
    some = _minority(labelled).select("list", "major", *(F.col(c).alias(f"{c}1") for c in ("node", "root", "n", "rest")))
    met = _first(some.join(labelled, "list").where("root1 <> root AND (root = major OR node1 < node)"), similar, matches)
    return met.select(F.least("node", "node1").alias("a"), F.greatest("node", "node1").alias("b")).distinct()


def _result(docs: DataFrame, links: DataFrame | None) -> DataFrame:
    """Components of documents from links of nodes; documents of one node are one."""
    smallest = docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    if links is not None:
        named = smallest.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
        smallest = named.join(by_root, "root").select(F.col("node").alias("node2"), "component_id")
    else:
        smallest = smallest.select(F.col("node").alias("node2"), F.col("least").alias("component_id"))
    joined = docs.join(smallest, docs.node == smallest.node2, "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each component, with all its columns; rows without an id stay.

    Of rows with one id the one with the smallest text stays (null last; any of equal ones).
    No name of ``df``'s columns can clash. An empty table gives an empty one.
    """
    linked = link_documents(df, id_col, text_col, **options).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    # the row's own columns stay inside a struct, so that no name of theirs can clash
    rows = df.select(own.alias("own_id"), F.when(own.isNull(), F.monotonically_increasing_id()).alias("number"), F.struct(text.isNull(), text).alias("place"), F.struct("*").alias("row"))
    kept = rows.join(linked, F.col("own_id") == F.col("kept_id"), "left").where("kept_id IS NOT NULL OR own_id IS NULL")
    return kept.groupBy("own_id", "number").agg(F.min_by("row", "place").alias("row")).select("row.*")
