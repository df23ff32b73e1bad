"""The pipeline against a brute-force version of its stages, and the driver-side rules of the subpackage."""

from __future__ import annotations

import os
import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from glycospan.llm import byte_bpe
from tests.llm.test_dedup import linked
from tests.llm.test_filters import counted, hits

SPACED = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, corpus):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(doc, text, lang, source, len(text or "")) for doc, text, lang, source in corpus]
    item = " ".join(corpus[1][1].split()[:14])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [(1, item)]


def test_pipeline_is_its_stages(spark, folder):
    path, rows, items = folder
    docs = [r for r in rows if not counted(r[1])[5]]
    good = {r.doc_id for r in corpus_pipeline.good_documents(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert good <= {r[0] for r in docs}  # the base rules are brute force; the adaptive ones have tests of their own
    docs = [r for r in docs if r[0] in good]
    roots = {d: c for d, _, c in linked(docs, 5, 80)}
    seen, one = set(), []
    for r in docs:
        if r[0] is None or roots[r[0]] == r[0] and r[0] not in seen:
            one.append(r)
            seen.add(r[0])
    first, left = {}, []
    for doc, text, *_ in one:
        words = re.findall(SPACED, text)
        for at in range(len(words) - 49 if doc is not None else 0):
            key = tuple(words[at : at + 50])
            first[key] = min(first.get(key, doc), doc)
    for doc, text, lang, source, _ in one:
        words, gone = re.findall(SPACED, text), set()
        for at in range(len(words) - 49 if doc is not None else 0):
            if first[tuple(words[at : at + 50])] < doc:
                gone |= set(range(at, at + 50))
        if not gone or len(gone) < len(words):
            left.append((doc, " ".join(w for i, w in enumerate(words) if i not in gone) if gone else text, lang, source))
    clean = [r for r in left if not next(iter(hits([r[:2]], items)))[5]]
    own = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    wanted = Counter((doc, lang, source, own.encode(text)) for doc, text, lang, source in clean)
    found = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, r.lang, r.source, bytes(r.ids)) for r in found.collect()) == wanted
    assert len(clean) < len(left) < len(one) + 1 and len(one) < len(docs) < len(rows)


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, path).columns) == corpus_pipeline.COLUMNS


def test_pipeline_of_no_documents(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(top, "glycospan")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as file:
                    assert "glycospan.llm" not in file.read()

