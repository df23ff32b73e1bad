from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from glycospan.llm import language_id
from glycospan.llm.language_id import Languages

SCHEMA = "doc_id long, text string, lang string, source string"


def phrases(text: bytes, reference: bytes, segment: int) -> int:
    """The parse by definition: the longest piece that the reference holds, or one unknown byte, again and again."""
    count = 0
    for at in range(0, len(text), segment):
        part = text[at : at + segment]
        while part:
            n = 0
            while n < len(part) and part[: n + 1] in reference:
                n += 1
            part = part[max(n, 1) :]
            count += 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    letters = b"abc "
    references = tuple(bytes(rng.choice(letters[: rng.randint(2, 4)]) for _ in range(n)) for n in (1, 40, 300))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 400)]
    for segment in (1, 7, 64, 1000):
        got = language_id.phrases(texts, Languages(("x", "y", "z"), references), segment)
        assert got.tolist() == [[phrases(t, r, segment) for r in references] for t in texts]


def test_the_automaton_holds_every_piece_and_nothing_else():
    rng = random.Random(3)
    codes = np.zeros(256, np.int64)
    codes[[97, 98, 99]] = [1, 2, 3]
    for _ in range(30):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
        table = language_id.automaton(text, codes, 4)
        assert len(table) <= 2 * len(text) + 1 and not table[:, 0].any()
        for _ in range(60):
            piece, state = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))), 1
            for c in codes[np.frombuffer(piece, np.uint8)]:
                state = table[state, c]
            assert (state != 0) == (piece in text)


def test_texts_are_normalised():
    assert language_id.normalised("  Über 12 Bäume,\n die—grün.") == "über bäume die—grün".encode()
    assert language_id.normalised(None) == b"" and language_id.normalised("12 % 3") == b""


def word(rng, vowels, consonants):
    return "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    kinds = {"aa": ("ae", "lmnr"), "bb": ("iou", "kptz"), "cc": ("éà", "lmst")}
    words = {k: [word(rng, *v) for _ in range(150)] for k, v in kinds.items()}
    rows = []
    for i in range(400):
        lang = rng.choice("aa aa bb cc".split())
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60))), lang, "s"))
    copied = rows[0][1]
    rows += [(400 + i, copied, rows[0][2], "s") for i in range(120)]  # one text is held by many
    rows += [(600, None, "aa", "s"), (601, "", "aa", "s"), (602, "12 + 4 !!", "bb", "s"), (603, "²½ _", None, "s"), (604, rows[1][1], None, "s"), (None, rows[2][1], rows[2][2], "s")]
    rows += [(605, " ".join(rng.choice(words["bb"]) for _ in range(30_000)), "bb", "s"), rows[3]]
    return rows


def test_held_out_documents_are_told_apart(spark, corpus):
    got = language_id.identify_languages(spark.createDataFrame(corpus, SCHEMA).repartition(4)).collect()
    assert len(got) == len(corpus)
    found = {r.doc_id: r for r in got}
    for doc, text, lang, _ in corpus:
        r = found[doc]
        assert r.held_out == (doc is None or zlib.crc32(str(doc).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if text and any(c.isalpha() for c in text) and lang:
            assert r.lang_pred == lang
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (600, 601, 602, 603))
    assert found[604].lang_pred == corpus[1][2]


def test_held_out_labels_are_not_learned(spark, corpus):
    rows = [(d, t, "zz" if d is not None and zlib.crc32(str(d).encode()) % 4 == 2 else y, s) for d, t, y, s in corpus]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = language_id.learn(df, ~language_id.held_out())
    assert learned.names == ("aa", "bb", "cc")
    same = language_id.learn(spark.createDataFrame(rows[::-1], SCHEMA).repartition(9), ~language_id.held_out())
    assert same == learned  # whatever the layout
    bounded = language_id.learn(df, ~language_id.held_out(), documents=2, piece=20, languages=2)
    assert len(bounded.names) == 2 and max(map(len, bounded.texts)) <= 2 * 2 * 20 + 1


def test_nothing_to_learn_from_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words", None, "s"), (2, None, None, "s")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language_id.identify_languages(df).collect()] == [("und", 0.0)] * 2
    assert language_id.identify_languages(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(7, "alpha beta", "xx", "y", 3), (8, "gamma delta", "yy", "y", 4), (9, "alpha", "xx", "y", 5)], "key long, body string, tongue string, lang string, mark int")
    got = language_id.identify_languages(odd, "key", "body", "tongue").collect()
    assert {r.doc_id for r in got} == {7, 8, 9} and all(r.lang_pred in ("xx", "yy", "und") for r in got)


def test_ties_go_to_the_first_name():
    learned = Languages(("m", "n"), (b"abc abc", b"abc abc"))
    names, scores = language_id.judge(["abc", "zzz"], learned)
    assert names == ["m", "m"] and scores.tolist() == [0.5, 0.5]
