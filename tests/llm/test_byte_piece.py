import hashlib
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import SF, clash
from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import byte_piece as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = B.read_ranks(open(PATH).read())
OURS = B.Coder(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(OURS.encode_all([text])[0], "<u4").tolist()


def test_documents_and_edges(docs):
    df = B.decode(B.encode(clash(docs, "packed", "decoded", "ids"), PATH, public_tokenizers.PATTERN),
                  PATH, public_tokenizers.PATTERN)
    rows = df.collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(df.columns)
    for r in rows:
        assert np.frombuffer(r.packed, "<u4").tolist() == THEIRS.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = B.op12_byte_piece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = THEIRS.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_nulls(spark, no_docs):
    assert B.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(None,)], "packed binary")
    assert bytes(B.decode(nothing, PATH, public_tokenizers.PATTERN).first().decoded) == b""


def test_every_character():
    for c in (*range(0x3400), *range(0x3400, sys.maxunicode + 1, 7)):
        if not 0xD800 <= c < 0xE000:
            text = "a{0} {0}1 {0} {0}{0}  {0}\n{0}".format(chr(c))
            assert ids(text) == THEIRS.encode_ordinary(text), hex(c)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "⁇", "▁", " ", "  ", "\n\n", "'s", "'ll", "12",
                                           "don't", "\x1c", "\x85", " ", "﻿", "<unk>"]), st.text(max_size=8)),
                max_size=12))
def test_any_text(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    got = OURS.encode_all([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(got) == text.encode()


def test_long_pieces_in_windows(monkeypatch):
    """Windows give the ids of the whole, also where nothing ever settles."""
    monkeypatch.setattr(B, "WINDOW_BYTES", 4096)
    rng = np.random.default_rng(3)
    words = ["a" * 40000, "ab" * 9000, "é" * 15000, "the" * 9000, "ß" * 4097, "=" * 4096, "=" * 30011,
             "".join(rng.choice(list("theandrioß"), 50000)), "".join(rng.choice(["ation", "ing", "un", "é"], 20000)),
             "".join(map(chr, rng.integers(0x4E00, 0x9000, 20000)))]
    for w in words:
        assert ids(w) == THEIRS.encode_ordinary(w), w[:20]


def test_a_very_long_piece_in_bounded_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    word = "ab" * 4_000_000
    packed = OURS.encode_all([word])[0]
    assert OURS.decode(packed) == word.encode()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 400 * 1024


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "CACHE_TOKENS", 10)
    coder = B.Coder(RANKS, public_tokenizers.PATTERN)
    for k in range(5):
        text = " ".join(f"w{i}x{k}" for i in range(50))
        assert np.frombuffer(coder.encode_all([text])[0], "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert len(coder.known) < 200


@pytest.mark.parametrize("ranks", [{b"a": 0}, {bytes([b]): b // 2 for b in range(256)}])
def test_vocabularies_that_cannot_be_written(ranks):
    with pytest.raises(ValueError):
        B.write_model(ranks)
