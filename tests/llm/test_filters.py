from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospan.llm import decontamination, linear, quality_classifier, quality_rules, toxicity

SPACED = r"[^\x20\x09-\x0D]+"


# --- quality rules -----------------------------------------------------------


def counted(text):
    words, seen = re.findall(SPACED, text or ""), {}
    for at in range(len(words) - 7):
        seen.setdefault(tuple(words[at : at + 8]), []).append(at)
    repeated = {i for places in seen.values() if len(places) > 1 for at in places for i in range(at, at + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts_are_the_rule(documents, corpus):
    found = Counter(tuple(r)[:7] for r in quality_rules.judge(documents).collect())
    assert found == Counter((doc, *counted(text)) for doc, text, *_ in corpus)


def test_thresholds_follow_language_and_source(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(words, 60))
        if i % 2:  # one source writes with symbols everywhere, the other never does
            text = " ".join(w + "$" if rng.random() < 0.3 else w for w in text.split(" "))
        rows.append((i, text, "en", "shop" if i % 2 else "prose"))
    litter = " ".join(w + "$$$" for w in rng.choice(words, 60))
    some = " ".join(w + "$" if k % 3 == 0 else w for k, w in enumerate(rng.choice(words, 60)))
    rows += [(1000, some, "en", "shop"), (1001, some, "en", "prose"), (1002, litter, "en", "shop"), (1003, some, "en", "rare source")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: (r.kept, r.reasons) for r in quality_rules.judge(df).collect()}
    assert kept[1000] == (True, [])
    assert kept[1001] == (False, ["symbols"])
    assert kept[1002] == (False, ["symbols"])
    assert kept[1003][0]  # judged by its language, as its own cell is small
    assert sum(not k for k, _ in kept.values()) <= 4


def test_sketch_quantiles_are_close_and_merge(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.integers(0, 200, 4000), rng.integers(0, 10**9, 4000)])
    df = spark.createDataFrame([(int(v), int(i % 3)) for i, v in enumerate(values)], "value long, part int").withColumn("metric", F.lit("m"))
    merged = quality_rules.merged(quality_rules.sketches(df, ["part"]), [])
    assert Counter(map(tuple, merged.select("bucket", "n").collect())) == Counter(map(tuple, quality_rules.sketches(df, []).select("bucket", "n").collect()))
    row = quality_rules.quantiles(merged, [], {"q": 0.1, "r": 0.5, "s": 0.99}).first()
    for got, q in ((row.q, 0.1), (row.r, 0.5), (row.s, 0.99)):
        exact = int(np.sort(values)[int(np.ceil(len(values) * q)) - 1])
        assert got <= exact <= got * (1 + 1 / 64) + 1


def test_rejected_rows_go_and_columns_stay(documents):
    kept = quality_rules.drop_rejected(documents)
    assert kept.columns == documents.columns
    judged = {(r.doc_id, r.n_words) for r in quality_rules.judge(documents).where("kept").collect()}
    assert {(r.doc_id, len(re.findall(SPACED, r.text))) for r in kept.collect()} == judged


def test_quality_rules_on_nothing_and_clashing_columns(nothing, clashing):
    assert quality_rules.judge(nothing).collect() == []
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(clashing, "key", "body", "mark", "node").collect()) == [(7, False), (8, False)]


# --- decontamination ---------------------------------------------------------

ITEMS = [(1, "alpha beta Gamma delta, epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, "Short; ITEM!"), (10, None), (11, " ... "), (12, "été à la plage"), (None, "w1 w2 w3")]
TEXTS = [
    (1, "so ALPHA beta gamma delta epsilon zeta eta theta iota kappa and more"),
    (2, "nothing here"),
    (3, "a short-item, a Short item; twice: short item short item"),
    (4, None),
    (5, ""),
    (6, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu alpha"),
    (7, "Été à la plage été à la plage"),
    (8, "x " * 5000 + "short item"),
    (None, "short item"),
    (3, "a short-item, a Short item; twice: short item short item"),
]


def hits(texts, items, width=10):
    def words(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, text in items:
        ws = words(text)
        size = min(width, len(ws))
        for at in range(len(ws) - size + 1 if ws and item is not None else 0):
            windows.setdefault(tuple(ws[at : at + size]), set()).add(item)
    out = Counter()
    for doc, text in texts:
        ws, hit, found = words(text), set(), set()
        for window, own in windows.items():
            for at in range(len(ws) - len(window) + 1):
                if tuple(ws[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc, len(ws), len(hit), len(found), digest, bool(hit)] += 1
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_decontamination_is_the_rule(spark, part_bytes):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find_hits(docs, bench, part_bytes=part_bytes)
    assert Counter(map(tuple, decontamination.summary(found).collect())) == hits(TEXTS, ITEMS)


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("items", F.lit("own"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5]
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs.where("doc_id < 8"), bench).collect()}
    assert cut[1] == "so  and more" and cut[2] == "nothing here" and cut[4] is None
    assert cut[3] == "a , a ; twice: " and cut[7] == "Été à la plage "  # only A-Z are folded


def test_decontamination_of_nothing(spark, nothing, clashing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_hits(nothing, bench).collect() == []
    none = bench.where("false")
    assert {r.n_hit for r in decontamination.find_hits(clashing, none, "key", "body").collect()} == {0}


# --- classifiers -------------------------------------------------------------


def labelled(spark, bad_word, n=500):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text, bad = list(rng.choice(words, 40)), i % 3 == 0
        if bad:
            text = bad_word(text, rng)
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (n + 1, ""), (None, "w1 w2"), (0, rows[0][1])], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda words, rng: [w.upper() + "!!" for w in words])
    scored = quality_classifier.score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(rows) > 80
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    everything = scored.collect()
    assert len(everything) == docs.count() and all(0 <= r.score <= 1 for r in everything)
    same = [r.score for r in everything if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda words, rng: [*words[:10], "you", "nitwit" + str(rng.integers(9)), *words[10:]])
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97


def test_held_out_rows_are_never_learned_from(spark):
    docs, labels = labelled(spark, lambda words, rng: [w.upper() for w in words])
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality_classifier.score_quality(docs.where("doc_id < 50"), x).collect()) for x in (labels, turned))
    assert a == b


def test_classifiers_without_labels_or_rows(spark, nothing, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score_quality(nothing, labels).collect() == []
    assert {r.score for r in toxicity.score_toxicity(clashing, labels, "key", "body").collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60) > 0).astype(int)
    rows, buckets = np.repeat(np.arange(60), 4), np.tile(np.arange(4), 60)
    cost = np.full(60, 0.7)
    w, bias = linear.dual_coordinate_descent(rows, buckets, x.reshape(-1), y, cost, tolerance=1e-6)

    def objective(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - np.where(y, 1, -1) * (x @ v[:4] + v[4]))).sum()

    best = np.append(w[:4], bias)
    assert all(objective(best) <= objective(best + 0.01 * rng.normal(size=5)) + 1e-9 for _ in range(300))


def test_rejecting_works_with_columns_of_any_name(spark, documents):
    odd = documents.withColumns({c: F.lit(i) for i, c in enumerate(("kept_id", "KEPT_mark", "kept_lang", "kept_source", "kept__doc_id"))})
    kept = quality_rules.drop_rejected(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality_rules.drop_rejected(documents).count()


def test_training_takes_the_smallest_text_of_an_id(spark):
    df = spark.createDataFrame([(1, None), (1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None)], "doc_id long, quality int")
    rows = linear.training_rows(df, labels, "quality", F.lit(True), "doc_id", "text", "doc_id", 10)
    assert rows == [("a", 0), ("", 1)]


@pytest.mark.parametrize("size", [2, 4, 7, 60, 150])
def test_one_selection_for_every_number_of_rows(size):
    def features(texts):
        return linear.distinct(*(np.array(x, np.int64) for x in zip(*((i, ord(c)) for i, t in enumerate(texts) for c in t), strict=True)))

    rows = [("xa", 1) for _ in range(size)] + [("xb", 0) for _ in range(size)]
    model = linear.fit(rows, features)
    # of ratios, x is in all texts; a and b count once they are in five fitted texts of a class
    held = -(-size // 5)
    assert set(np.flatnonzero(model.weights)) == ({ord("a"), ord("b")} if size - held >= 5 else set())
    one, two = model.scores(["xa", "xb"])
    assert one > two if size - held >= 5 else one == two == pytest.approx(0.5)
