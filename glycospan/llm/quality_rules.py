"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source.

A sketch counts documents by value, where a value keeps its seven leading binary digits, so
that a quantile is right to one part in 64. Sketches are merged by adding counts: the same
whatever the partitioning, summed before the shuffle, and bounded in size (at most 64
buckets for each power of two) however many documents a cell has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.llm.common import checkpointed, cover, inside, mixed, slices, texts_of, window_hashes, word_codes, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: A cell with fewer documents takes the thresholds of its language, and then those of the corpus.
MIN_DOCS = 100
#: How many times the distance from the median to the 90th (10th) percentile a value may lie above (below) the median.
REACH = 3
#: Metric: (value in thousandths as SQL, sides that are watched, least distance from the median that counts as odd).
#: The distances keep a cell whose documents are all alike from rejecting ordinary ones.
METRICS = {
    "symbols": ("1000 * n_symbols div n_words", "high", 150),
    "dup_lines": ("1000 * n_dup_lines div n_lines", "high", 350),
    "repeats": ("1000 * n_repeat_words div n_words", "high", 280),
    "word_length": ("1000 * word_chars div n_words", "both", 4000),
    "capitals": ("1000 * n_upper div greatest(word_chars, 1)", "high", 400),
    "variety": ("1000 * n_distinct div n_words", "low", 400),
}


def repeated_words(words: list[list[bytes]], width: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of ``width`` words that occur twice or more in it."""
    codes, _, offsets = word_codes(words)
    out = np.zeros(len(words), np.int64)
    text = np.repeat(np.arange(len(words)), np.diff(offsets))
    hashes = window_hashes(mixed(codes.astype(np.uint64)), width)
    starts = np.flatnonzero(inside(offsets, width, len(hashes)))
    keys = mixed(hashes[starts] ^ mixed(text[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    maybe = np.zeros(len(keys), bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    found: dict[tuple, int] = {}
    hits = starts[maybe]
    exact = [(text[s], codes[s : s + width].tobytes()) for s in hits.tolist()]  # the hash only proposes
    for key in exact:
        found[key] = found.get(key, 0) + 1
    hits = np.array([s for s, key in zip(hits.tolist(), exact, strict=True) if found[key] > 1], np.int64)
    return out if not len(hits) else np.bincount(text[cover(hits, width, len(codes))], minlength=len(words))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the counts that the rules use; a null text has no words."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            words = words_of(texts)
            repeats, rows = repeated_words(words), []
            for t, w, r in zip(texts, words, repeats.tolist(), strict=True):
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                rows.append(
                    (
                        len(w),
                        len(t) - sum(map(t.count, SPACES)),
                        sum(map(t.count, SYMBOLS)),
                        len(lines),
                        len(lines) - len(set(lines)),
                        r,
                        sum(map(str.isupper, t)) if t != t.lower() else 0,
                        len(set(w)),
                    )
                )
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), *(part.column(i) for i in range(2, part.num_columns))],
                names=["doc_id", *counts, *part.schema.names[2:]],
            )

    kept = "".join(f", more_{i} {fields[c]}" for i, c in enumerate(keep))
    return texts_of(df, id_col, text_col, *keep).mapInArrow(measure, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + kept)


def bucket(value: Column) -> Column:
    """The number of a whole value's bucket, in order of the values: all below 128, then 64 for each power of two."""
    power = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    return power.cast("long") * 64 + F.call_function("shiftright", value, power)


def lowest(number: Column) -> Column:
    """The smallest value of a bucket."""
    power = F.greatest(F.floor(number / 64) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - power * 64).cast("long"), power)


def sketches(values: DataFrame, by: list[str]) -> DataFrame:
    """Sketch rows (by..., metric, bucket, n) of a table with columns by..., metric, value."""
    return values.groupBy(*by, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Coarser sketches from finer ones, by adding counts."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """by..., metric, docs, and a column per wanted quantile: the smallest value of its bucket."""
    cell = Window.partitionBy(*by, "metric")
    running = sketch.withColumn("docs", F.sum("n").over(cell)).withColumn("upto", F.sum("n").over(cell.orderBy("bucket")))
    return running.groupBy(*by, "metric", "docs").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), lowest(F.col("bucket")))).alias(name) for name, q in at.items()))


def thresholds(measured: DataFrame, min_docs: int = MIN_DOCS, reach: float = REACH) -> DataFrame:
    """lang, source, metric, low, high: for each cell of the corpus the span of values to keep.

    The span reaches from the median ``reach`` times the distance to the 10th and the 90th
    percentile, and at least the metric's own distance. Documents without words don't count.
    """
    metric = [F.struct(F.lit(name).alias("metric"), F.expr(f"CAST({sql} AS long)").alias("value")) for name, (sql, _, _) in METRICS.items()]
    values = measured.where("n_words > 0").select("lang", "source", F.explode(F.array(*metric)).alias("m")).select("lang", "source", "m.*")
    at = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    cells = checkpointed(sketches(values, ["lang", "source"]))
    own = quantiles(cells, ["lang", "source"], at)
    by_lang = quantiles(merged(cells, ["lang"]), ["lang"], at).select("lang", "metric", F.struct("docs", *at).alias("l"))
    by_all = quantiles(merged(cells, []), [], at).select("metric", F.struct("docs", *at).alias("a"))
    joined = own.withColumn("s", F.struct("docs", *at)).join(by_lang.withColumnRenamed("lang", "lang2"), [F.col("lang").eqNullSafe(F.col("lang2")), own["metric"] == by_lang["metric"]]).drop(by_lang["metric"])
    joined = joined.join(F.broadcast(by_all), "metric")  # one row per metric
    best = F.when(F.col("s.docs") >= min_docs, F.col("s")).when(F.col("l.docs") >= min_docs, F.col("l")).otherwise(F.col("a"))
    gap = F.create_map(*(F.lit(x) for name, (_, _, least) in METRICS.items() for x in (name, least)))[F.col("metric")]
    sides = F.create_map(*(F.lit(x) for name, (_, side, _) in METRICS.items() for x in (name, side)))[F.col("metric")]
    joined = joined.select("lang", "source", "metric", best.alias("q"))
    low = F.col("q.q50") - F.greatest(reach * (F.col("q.q50") - F.col("q.q10")), gap)
    high = F.col("q.q50") + F.greatest(reach * (F.col("q.q90") - F.col("q.q50")), gap)
    return joined.select("lang", "source", "metric", F.when(sides != "high", low).alias("low"), F.when(sides != "low", high).alias("high"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, reach: float = REACH) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``kept`` and ``reasons``.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated 8-word windows.
    ``kept``: not so, and no metric outside the thresholds of the document's language and
    source (null is a language and a source of its own). ``reasons`` names the rules that
    failed. One row per row, also for null or repeated ids; a null text has no words and
    fails. The thresholds are joined by language and source: one row per cell.
    """
    return _judged(df, id_col, text_col, lang_col, source_col, min_docs, reach).drop("mark", "lang", "source")


def drop_rejected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, reach: float = REACH) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, whatever their names.

    Rows with null or repeated ids are judged each by its own text, language and source; a
    null text goes, as it has no words. An empty table gives an empty one.
    """
    kept = _judged(df, id_col, text_col, lang_col, source_col, min_docs, reach).where("kept").select("doc_id", "mark", "lang", "source").distinct()
    prefix = "kept"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    kept = kept.toDF(*(f"{prefix}_{c}" for c in kept.columns))
    own = (F.col(f"`{id_col}`").cast("long"), _mark(text_col), F.col(f"`{lang_col}`"), F.col(f"`{source_col}`"))
    match = [a.eqNullSafe(F.col(b)) for a, b in zip(own, kept.columns, strict=True)]
    return df.join(kept, match, "left_semi")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, min_docs: int, reach: float) -> DataFrame:
    clean = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip((id_col, text_col, lang_col, source_col), ("doc_id", "text", "lang", "source"), strict=True)), _mark(text_col).alias("mark"))
    measured = measures(clean, keep=("lang", "source", "mark")).withColumnsRenamed({"more_0": "lang", "more_1": "source", "more_2": "mark"})
    measured = checkpointed(measured)
    spans = thresholds(measured, min_docs, reach)
    spans = spans.groupBy(F.col("lang").alias("lang2"), F.col("source").alias("source2")).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("spans"))
    judged = measured.join(spans, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")), "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    odd = []
    for name, (sql, _, _) in METRICS.items():
        value, span = F.expr(f"CAST({sql} AS long)"), F.col("spans")[name]
        odd.append(F.when(F.coalesce((value < span["low"]) | (value > span["high"]), F.lit(False)), F.lit(name)))
    reasons = F.when(base, F.array(F.lit("base"))).otherwise(F.filter(F.array(*odd), lambda x: x.isNotNull()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), reasons.alias("reasons"), "mark", "lang", "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("reasons") == 0).alias("kept"), "reasons", "mark", "lang", "source"
    )
