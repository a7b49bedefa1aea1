import hashlib
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from conftest_llm import clash
from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
BACK = bpe.Decoder(open(PATH, encoding="utf-8").read())
THEIRS = tokenizers.Tokenizer.from_file(PATH)


def want(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    return ids, THEIRS.decode(ids, skip_special_tokens=False)


def test_documents_and_edges(docs):
    df = clash(docs, "ids", "decoded", "packed")
    for r in bpe.decode(bpe.encode(df.drop("n_chars"), PATH), PATH).collect():
        assert (r.ids, r.decoded) == want(r.text or "")
    for r in bpe.digests(docs.select("doc_id", "text"), PATH).collect():
        assert r.n_tokens * 4 == len(r.packed)
    row = bpe.digests(docs.where("doc_id = 9004"), PATH).first()
    ids, text = want(docs.where("doc_id = 9004").first().text)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(no_docs):
    assert bpe.encode(no_docs, PATH).count() == 0 and bpe.tokens(no_docs, PATH).count() == 0


def test_every_character():
    chars = [chr(c) for c in (*range(0x3100), *range(0x3100, sys.maxunicode + 1, 9)) if not 0xD800 <= c < 0xE000]
    forms = "a{0} {0}1 {0} {0}{0}  {0}\n{0}"
    texts = ["".join(forms.format(c) for c in chars[i:i + 400]) for i in range(0, len(chars), 400)]
    for text, ids, e in zip(texts, OURS.encode_all(texts), THEIRS.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids, ascii(text[:80])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endof", " ", "  ", "\n\n", "'s", "'ll", "12", "don't",
                                           "\x1c", "\x85", " ", " ", "﻿"]), st.text(max_size=8)),
                max_size=12))
def test_any_text(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids, back = want(text)
    assert OURS.encode(text).tolist() == ids
    assert BACK.decode(ids) == back


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decode_any_ids(ids):
    assert BACK.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["a" * 20000, "ab" * 9000, "é" * 5000, "the" * 4000])
def test_very_long_piece(word):
    assert OURS.encode(word).tolist() == want(word)[0]


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    t = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    for k in range(5):
        text = " ".join(f"w{i}x{k}" for i in range(50))
        assert t.encode(text).tolist() == want(text)[0]
    assert len(t.place) < 200


def test_rows_and_single_trees_agree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 8, 17, 64):
        rows = OURS.of_byte[rng.choice(np.frombuffer(b" theandriongTs1\xc3\xa9", np.uint8), (60, n))]
        tokens, counts = bpe.merge_rows(rows, OURS.table)
        assert np.split(tokens, np.cumsum(counts)[:-1])[7].tolist() == bpe.merge_piece(rows[7].tolist(), OURS.pairs)
        assert tokens.tolist() == [t for r in rows for t in bpe.merge_piece(r.tolist(), OURS.pairs)]


def test_a_very_long_piece_in_bounded_memory():
    piece = np.random.default_rng(3).integers(97, 118, 300_000).astype(np.uint8)
    ids = OURS.of_byte[piece]
    tracemalloc.start()
    got = bpe.merge_array(memoryview(ids), OURS.pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(piece)
    assert OURS.encode(piece.tobytes().decode()).tolist() == got.tolist()
    assert bpe.merge_piece(ids[:20_000].tolist(), OURS.pairs) == THEIRS.encode(
        piece[:20_000].tobytes().decode(), add_special_tokens=False).ids
