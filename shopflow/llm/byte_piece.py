"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A vocabulary of byte strings and ranks becomes a sentencepiece BPE model without any
training: every byte stands for one printable character, a token is the piece of its
bytes' characters, and its score is its rank negated, so the best-scoring merge of the
library is the lowest rank, leftmost among equals. Normalisation is the identity, and
blanks are characters like any other. Texts are split into pre-tokens, each is encoded on
its own, and decoding maps the pieces back to bytes.

A null text is encoded as an empty one, and every row on its own: repeated rows stay
repeated, an empty table gives an empty result, other columns stay as they are (one named
like a result is replaced). Text that has no UTF-8 form can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.llm.bpe import byte_characters
from shopflow.llm.common import map_rows, read_table

CACHE_TOKENS = 300_000  # pre-tokens remembered in a Python worker
CACHE_BYTES = 64 << 20  # and the bytes of them and their ids
SLICE_BYTES = 2 << 20  # text worked on together
WINDOW_BYTES = 1 << 18  # longer pre-tokens are encoded in windows
SETTLED = 64  # tokens before a window's end that may differ without it


def read_ranks(contents: str) -> dict[bytes, int]:
    """The byte strings and ranks of a vocabulary file: base64, a blank, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(str.split, contents.splitlines()) if a}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def write_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece 0 is the unknown one, piece k + 1 the k-th by rank.

    Field numbers and kinds are those of the library's published message format."""
    if len(set(ranks.values())) < len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must differ, and each byte must be a token")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("a score of single precision holds ranks below 2^24 only")
    chars = byte_characters()
    normal, unknown = 1, 2
    pieces = [_piece("⁇", 0.0, unknown)]
    pieces += [_piece("".join(map(chars.__getitem__, t)), -float(ranks[t]), normal) for t in sorted(ranks, key=ranks.get)]
    bpe = _message(2, _number(3, 2))
    identity = _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + bpe + identity


class Coder:
    """Encoder and decoder of a vocabulary, with the pre-tokens met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=write_model(ranks))
        self.ranks = ranks
        self.id_of_piece = np.array([-1, *sorted(ranks.values())], np.int64)
        self.chars = dict(enumerate(byte_characters()))
        byte_of = {c: b for b, c in self.chars.items()}
        self.bytes_of: list[bytes | None] = [None] * (1 + max(ranks.values()))
        for piece in range(1, self.model.get_piece_size()):
            text = self.model.id_to_piece(piece)
            self.bytes_of[self.id_of_piece[piece]] = bytes(map(byte_of.__getitem__, text))
        # The library this follows takes blanks as Unicode's White_Space.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        mapped = [r.decode("latin-1").translate(self.chars) for r in raw]
        return [self.id_of_piece[p] for p in self.model.encode(mapped, out_type=int, num_threads=1)]

    def _long(self, raw: bytes) -> np.ndarray:
        """The ids of a long pre-token, window by window. Tokens that are each their own
        encoding, of which every two neighbours are theirs too, are the encoding of the
        whole: so only the two tokens at a seam are looked at, and where they would merge
        otherwise, the cut moves back, at last to a wider window."""
        out, at, width = [], 0, WINDOW_BYTES
        while at < len(raw):
            ids = self._pieces([raw[at:at + width]])[0]
            if at + width >= len(raw):
                out.append(ids)
                break
            back = SETTLED
            while back < len(ids):
                keep = ids[:len(ids) - back]
                end = at + sum(len(self.bytes_of[i]) for i in keep)
                ahead = self._pieces([raw[end:end + 4 * WINDOW_BYTES // 64]])[0]
                seam = self.bytes_of[keep[-1]] + self.bytes_of[ahead[0]]
                if len(ahead) > SETTLED and ahead[0] == ids[len(keep)] and \
                        self._pieces([seam])[0].tolist() == [keep[-1], ahead[0]]:
                    out.append(keep)
                    at, width = end, WINDOW_BYTES
                    break
                back *= 2
            else:
                width *= 2
        return np.concatenate(out)

    def _learn(self, words: list[str]) -> None:
        short, raw = [], []
        for w in words:
            b = w.encode()
            whole = self.ranks.get(b)
            if whole is not None:  # a pre-token that is a token is that token
                self._keep(w, np.array([whole]))
            elif len(b) > WINDOW_BYTES:
                self._keep(w, self._long(b))
            else:
                short.append(w)
                raw.append(b)
        for w, ids in zip(short, self._pieces(raw) if raw else ()):
            self._keep(w, ids)

    def _keep(self, word: str, ids: np.ndarray) -> None:
        self.known[word] = packed = ids.astype("<u4").tobytes()
        self.held += len(packed) + len(word)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.known) > CACHE_TOKENS or self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        if new := [w for w in set().union(*split) if w not in self.known]:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; one that no token has is an error."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[int, Coder] = {}


def _coder(contents: str, pattern: str) -> Coder:
    """One coder a Python worker, whatever number of tasks it runs."""
    key = hash((contents, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Coder(read_ranks(contents), pattern)
    return _LOADED[key]


def _slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``SLICE_BYTES`` in a column (or of one row)."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(col)], np.int64)
    group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else group
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _vocabulary(spark: SparkSession, path: str):
    """The file (a vocabulary, under a MB or so whatever the corpus), read by the driver."""
    with open(path, encoding="ascii") as f:
        return spark.sparkContext.broadcast(f.read())


def _replacing(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "packed") -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text, packed as little-endian unsigned
    32-bit integers. ``path`` names a file of ranks, ``pattern`` the pre-tokens."""
    held, names = _vocabulary(docs.sparkSession, path), docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterable[dict]:
        coder = _coder(held.value, pattern)
        for b in _slices(batch, at):
            yield dict(zip(names, b.columns)) | {out: coder.encode_all([t or "" for t in b.column(at).to_pylist()])}

    return map_rows(docs, run, _replacing(docs, out, T.BinaryType()))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "packed", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that packed ids stand for (null: none)."""
    held, names = _vocabulary(df.sparkSession, path), df.columns
    at = names.index(ids_col)

    def run(batch: pa.RecordBatch) -> Iterable[dict]:
        coder = _coder(held.value, pattern)
        for b in _slices(batch, at):
            yield dict(zip(names, b.columns)) | {out: [coder.decode(p or b"") for p in b.column(at).to_pylist()]}

    return map_rows(df, run, _replacing(df, out, T.BinaryType()))


def op12_byte_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the ranks of the multilingual vocabulary, and decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, path, pattern).drop("text"), path, pattern)
    return both.select("doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
                       F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
