from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glycospan.llm import jaccard_join, packed, substring_dedup, suffix_blocks, suffix_dedup
from glycospan.llm.components import components

SPACED = r"[^\x20\x09-\x0D]+"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_rows(df):
    return Counter(map(tuple, df.collect()))


# --- suffixes ----------------------------------------------------------------


def bytes_removed(corpus, window=100):
    """The rule itself: a window goes if the same bytes begin at a smaller (id, start)."""
    first = {}
    for doc, text, *_ in corpus:
        data = (text or "").encode()
        for at in range(len(data) - window + 1 if doc is not None else 0):
            key = data[at : at + window]
            first[key] = min(first.get(key, (doc, at)), (doc, at))
    out = Counter()
    for doc, text, *_ in corpus:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - window + 1 if doc is not None else 0):
            if first[data[at : at + window]] < (doc, at):
                gone[at : at + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc, len(data), int(gone.sum()), spans, sha(bytes(np.frombuffer(data, np.uint8)[~gone]))] += 1
    return out


def test_suffix_dedup_is_the_rule(documents, corpus):
    found = as_rows(suffix_dedup.digests(suffix_dedup.remove_repeats(documents)))
    assert found == bytes_removed(corpus)
    assert any(n for _, _, n, _, _ in found)


def test_suffix_dedup_of_nothing_and_of_clashing_columns(nothing, clashing):
    assert suffix_dedup.digests(suffix_dedup.remove_repeats(nothing)).collect() == []
    found = suffix_dedup.remove_repeats(clashing, "key", "body").collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(7, 0), (8, 0)]


def test_overlapping_repeats_inside_one_text(spark):
    text = "ab" * 400 + "tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert as_rows(suffix_dedup.digests(suffix_dedup.remove_repeats(df))) == bytes_removed([(1, text)])


@pytest.mark.parametrize("alphabet, depth", [(b"ab", 100), (b"abc", 40), (b"a", 64)])
def test_suffix_classes_are_equal_strings(alphabet, depth):
    rng = np.random.default_rng(len(alphabet))
    base = bytes(rng.choice(list(alphabet), 300).astype(np.uint8))
    text = b"".join(base[rng.integers(200) :][: rng.integers(20, 200)] for _ in range(40))
    data = np.frombuffer(text, np.uint8)
    starts = np.sort(rng.choice(len(data) - depth, min(900, len(data) - depth), replace=False))
    number = suffix_blocks.classes(data, starts, depth)
    named = defaultdict(set)
    for at, n in zip(starts.tolist(), number.tolist(), strict=True):
        named[text[at : at + depth]].add(n)
    assert all(len(x) == 1 for x in named.values())
    assert len(named) == len(set(number.tolist()))


@pytest.mark.parametrize("texts, length", [(5, 160), (6, 120), (9, 140), (25, 120)])
def test_suffix_classes_of_rule_lines_with_different_tails(texts, length):
    bodies = [b"=" * length + ("A" if i % 2 else " ").encode() + f"{i} text and some more of it{i}".encode() for i in range(texts)]
    text, ends = b"".join(bodies), np.cumsum([len(b) for b in bodies])
    starts = np.concatenate([np.arange(end - len(b), end - 99) for b, end in zip(bodies, ends.tolist(), strict=True)])
    number = suffix_blocks.classes(np.frombuffer(text, np.uint8), starts, 100)
    named = defaultdict(set)
    for at, n in zip(starts.tolist(), number.tolist(), strict=True):
        named[text[at : at + 100]].add(n)
    assert all(len(x) == 1 for x in named.values())
    assert len(named) == len(set(number.tolist()))


def test_difference_cover_has_all_distances():
    cover = suffix_blocks.COVER
    assert {(a - b) % suffix_blocks.PERIOD for a in cover for b in cover} == set(range(suffix_blocks.PERIOD))


# --- word windows ------------------------------------------------------------


def words_removed(corpus, window=50):
    first = {}
    for doc, text, *_ in corpus:
        words = re.findall(SPACED, text or "")
        for at in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for doc, text, *_ in corpus:
        words, gone = re.findall(SPACED, text or ""), set()
        for at in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[at : at + window])] < doc:
                gone |= set(range(at, at + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc, len(words), len(gone), sha(kept.encode())] += 1
    return out


def test_substring_dedup_is_the_rule(documents, corpus):
    found = as_rows(substring_dedup.digests(substring_dedup.remove_repeats(documents)))
    assert found == words_removed(corpus)
    assert any(n for _, _, n, _ in found)


def test_windows_that_a_copy_elsewhere_repeats_go_at_all_their_places(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(0, 16, 2):
        own = [" ".join(f"d{i + k}w{w}" for w in range(30)) for k in range(4)]
        rows += [(i, f"same{i} " * 300), (i + 1, f"same{i} " * 300)]
        rows += [(100 + i, f"{own[0]} {passage}{i}"), (101 + i, f"{own[1]} {passage}{i} {own[2]} {passage}{i} {own[3]}")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows are put in one task again
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        found = as_rows(substring_dedup.digests(substring_dedup.remove_repeats(df)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == words_removed(rows)
    assert {n for d, _, n, _ in found if d < 100 and d % 2} == {300}


def test_substring_dedup_of_nothing_and_of_clashing_columns(nothing, clashing):
    assert substring_dedup.digests(substring_dedup.remove_repeats(nothing)).collect() == []
    found = substring_dedup.remove_repeats(clashing, "key", "body", window=4, keep=("mark", "n")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed, r.mark, r.n) for r in found) == [(7, "a b c d", 0, "x", 2), (8, "", 4, "x", 2)]


def test_packed_places_come_back():
    rng = np.random.default_rng(1)
    n = 500
    doc = np.sort(rng.integers(0, 9, n))
    place = np.concatenate([np.sort(rng.choice(5000, (doc == d).sum(), replace=False)) for d in range(9)])
    hashes, flag = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.random(n) < 0.5
    ids, marks, bucket = rng.integers(0, 1 << 60, 9), rng.integers(-(1 << 31), 1 << 31, 9), rng.integers(0, 3, n)
    import pyarrow as pa

    seen = set()
    for batch in packed.pack(hashes, bucket, doc, place, flag, ids, marks, 8):
        for row in range(batch.num_rows):
            h, d, p, f, i, m = packed.unpack(pa.Table.from_batches([batch.slice(row, 1)]), 8)
            seen |= set(zip(h.tolist(), i[d].tolist(), m[d].tolist(), p.tolist(), f.tolist(), strict=True))
    assert seen == set(zip(hashes.tolist(), ids[doc].tolist(), marks[doc].tolist(), place.tolist(), flag.tolist(), strict=True))


def test_gathered_places_are_complete():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    ids, marks = np.array([5, 9, 5]), np.array([1, -7, 2])
    batches, wanted = [], defaultdict(list)
    for _ in range(4):
        doc = np.sort(rng.integers(0, 3, 50))
        place = rng.integers(0, 1000, 50)
        batches.append(packed.places(doc, place, ids, marks, 2))
        for d, p in zip(doc.tolist(), place.tolist(), strict=True):
            wanted[int(ids[d]), int(marks[d])].append(p)
    found = {}
    everything = pa.Table.from_batches(batches)
    for dest in (0, 1):
        for row in packed.gather(everything.filter(pa.compute.equal(everything["dest"], dest))).to_pylist():
            found[row["id2"], row["mark2"]] = sorted(row["places"])
    assert found == {k: sorted(v) for k, v in wanted.items()}


# --- Jaccard join ------------------------------------------------------------


def linked(corpus, width, similar):
    sets = []
    for doc, text, *_ in corpus:
        words = re.findall(SPACED, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        found = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets.append((doc, found or ({tuple(words)} if words else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (doc, a) in enumerate(sets):
        for j in range(i):
            other, b = sets[j]
            if a and b and doc is not None and other is not None and 100 * len(a & b) >= similar * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(s), None if doc is None else least[find(i)] if s else doc) for i, (doc, s) in enumerate(sets))


@pytest.mark.parametrize("width, similar, frequent", [(3, 90, 1000), (5, 80, 0), (2, 50, 20)])
def test_jaccard_join_is_the_rule(documents, corpus, width, similar, frequent):
    found = as_rows(jaccard_join.link_documents(documents, width=width, similar=similar, frequent=frequent))
    assert found == linked(corpus, width, similar)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each differs from the next in two words, the ends have little in common
        words = [*words[2:], f"n{i}", f"m{i}"]
        rows.append((100 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = as_rows(jaccard_join.link_documents(df))
    assert found == linked(rows, 3, 90)
    assert {c for _, _, c in found} == {61}


def test_jaccard_join_of_nothing_and_of_clashing_columns(nothing, clashing):
    assert jaccard_join.link_documents(nothing).collect() == []
    assert as_rows(jaccard_join.link_documents(clashing, "key", "body")) == Counter([(7, 2, 7), (8, 2, 7)])


def test_texts_with_a_common_phrase_make_no_pairs(spark, monkeypatch):
    pairs, made = [], jaccard_join.other_pairs

    def counted(*args):
        out = made(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "other_pairs", counted)
    phrase = " ".join(f"common{i}" for i in range(9))  # seven shingles, which no count tells to be frequent
    texts = [" ".join(f"w{d}x{i}" for i in range(60)) + " " + phrase for d in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = as_rows(jaccard_join.link_documents(df, frequent=1))
    assert found == Counter((d, 67, d) for d in range(24)) and sum(pairs) == 0


def test_rounds_of_hubs_lose_no_link(documents, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIGHT", 0)
    monkeypatch.setattr(jaccard_join, "LONG", 1)
    assert as_rows(jaccard_join.link_documents(documents, width=2, similar=50)) == linked(corpus, 2, 50)


@pytest.mark.parametrize("together", [256, 3])
def test_near_copies_at_the_limit_are_held_against_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(jaccard_join, "TOGETHER_NODES", together)
    rng, base, rows = np.random.default_rng(5), [f"w{i}" for i in range(120)], []
    for k in range(250):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))).tolist():
            words[at] = f"x{rng.integers(40)}"
        rows.append((k, " ".join(words)))
    found = as_rows(jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == linked(rows, 3, 90) and len({r[2] for r in found}) > 3


def test_keep_one_takes_any_names_and_the_smallest_text_of_an_id(spark):
    schema = "doc_id long, text string, row_of_null int, kept_id int, own_id int, number int, place int, row int"
    rows = [(1, "b c", *[1] * 6), (1, "a c", *[2] * 6), (1, None, *[3] * 6), (None, "a c", *[4] * 6), (None, "a c", *[4] * 6), (2, "A c", *[5] * 6)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "row_of_null", "kept_id", "own_id", "number", "place", "row"]
    assert as_rows(kept) == Counter([rows[1], rows[3], rows[4]])


def test_keep_one_keeps_the_smallest_id(documents, corpus):
    kept = jaccard_join.keep_one(documents)
    ids = [r.doc_id for r in kept.collect()]
    wanted = {c for d, _, c in linked(corpus, 3, 90) if d is not None}
    assert kept.columns == documents.columns
    assert Counter(ids) == Counter([*wanted, None])


def test_components_of_random_links(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))]
    root = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}
