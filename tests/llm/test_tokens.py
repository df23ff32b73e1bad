from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from glycospan.llm import byte_bpe, token_counts

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "ing", "er", " ", "  ", "\n", "\t", "é", "漢", "字", "😀", "<s>", "</s>", "<|endoftext|>", "▁", "a", "12", "ß", "\x00", "'s", "'re", "     ", " " * 17, "...", "٣²", "\x1c", "\xa0"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def own():
    return byte_bpe.vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_ids_are_the_librarys_and_decode_back(own, library, odd_texts):
    for text in odd_texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_edits_give_the_ids_of_the_whole_text(own, library):
    rng = random.Random(8)
    for _ in range(60):
        document = byte_bpe.Document(own, "".join(rng.choice(PARTS) for _ in range(20)))
        for _ in range(4):
            a = rng.randint(0, len(document.text))
            document.edit(a, min(len(document.text), a + rng.randint(0, 5)), rng.choice(PARTS))
            assert document.ids() == library.encode_ordinary(document.text)
        assert document.append(" more text").ids() == library.encode_ordinary(document.text)


def test_an_edit_works_out_few_prefixes_again(own):
    piece = byte_bpe.Prefixes(own, b"internationalisation" * 60)
    redone = piece.edit(100, 101, b"x")
    assert redone < 200
    assert piece.ids() == byte_bpe.Prefixes(own, piece.data).ids()


def test_encode_documents(documents, corpus, library):
    found = byte_bpe.digests(byte_bpe.encode_documents(documents, RANKS, public_tokenizers.PATTERN)).collect()
    wanted = []
    for doc, text, *_ in corpus:
        ids = library.encode_ordinary(text or "")
        wanted.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_encoding_nothing_and_clashing_columns(nothing, clashing):
    assert byte_bpe.encode_documents(nothing, RANKS, public_tokenizers.PATTERN).collect() == []
    found = byte_bpe.encode_documents(clashing, RANKS, public_tokenizers.PATTERN, "key", "body", keep=("mark", "node")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.mark, str(r.node)) for r in found) == [(7, 4, "x", "y"), (8, 4, "x", "None")]


def test_transducer_counts_like_the_library(pieces, odd_texts):
    counter = token_counts.counter(PIECES)
    for text in odd_texts:
        assert counter.total([counter.chunk(text.replace("▁", " "))]) == len(pieces.encode(text))


def test_chunk_maps_compose_to_the_count_of_the_text(pieces, odd_texts):
    counter = token_counts.counter(PIECES)
    for size in (1, 2, 5, 13):
        for text in odd_texts[:120]:
            plain = text.replace("▁", " ")
            maps = [counter.chunk(plain[i : i + size]) for i in range(0, len(plain), size)]
            assert counter.total(maps) == len(pieces.encode(text))
            if len(maps) > 2:  # in any grouping
                joined = counter.compose(counter.compose(maps[0], maps[1]), maps[2])
                assert counter.total([joined, *maps[3:]]) == len(pieces.encode(text))


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_count_tokens(documents, corpus, pieces, chunk):
    found = token_counts.over_limit(token_counts.count_tokens(documents, PIECES, chunk=chunk)).collect()
    wanted = [(doc, len((text or "").encode()), n := len(pieces.encode(text or "")), n > 4096) for doc, text, *_ in corpus]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_counting_nothing_and_clashing_columns(nothing, clashing):
    assert token_counts.count_tokens(nothing, PIECES).collect() == []
    assert sorted(map(tuple, token_counts.count_tokens(clashing, PIECES, "key", "body").collect())) == [(7, 7, 4), (8, 7, 4)]
