"""Byte-level BPE encoding and decoding with a public tokenizer file.

Texts are split at the file's special tokens, then by its pre-tokenizer's pattern. In each piece, a segment tree over the ranks of adjacent pairs holds the next merge at its
root: the lowest rank, leftmost among equals. A merge changes one symbol, takes one out
of the chain, and updates at most three leaves, each in logarithmic time, until no pair
can be merged; so a piece of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.llm.common import map_rows, read_table

# Fixed pattern of the byte-level pre-tokenizer.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NO_PAIR = 1 << 62
NO_RANK = (1 << 31) - 1
CACHE_PIECES = 300_000  # merged pieces remembered in a Python worker
CACHE_TOKENS = 4_000_000  # and their tokens
TREE_BYTES = 64  # longer pieces have a tree of their own
TREE_ROWS = 16_384  # trees grown together
SLICE_BYTES = 2 << 20  # text whose new pieces are merged together


def byte_characters() -> list[str]:
    """The character that stands for each byte in the file: printable Latin-1 characters
    for themselves, the other bytes in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def merge_piece(ids: Iterable[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols left when every merge is done. ``pairs``: (left, right) -> (rank, merged id)."""
    return merge_array(ids, pairs).tolist()


def merge_array(ids: Iterable[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> array:
    """:func:`merge_piece` in arrays of numbers: some 24 bytes of memory for each symbol."""
    ids = array("i", ids)
    n = len(ids)
    if n < 2:
        return ids
    leaves = 1 << max(1, (n - 2).bit_length())
    rank = array("i", [NO_RANK]) * leaves  # of the pair that starts at a place
    best = array("i", [0]) * leaves  # inner nodes of the tree: the place of the leftmost lowest rank below
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

    def found(i: int) -> int:
        j = after[i]
        p = pairs.get((ids[i], ids[j])) if j < n else None
        return NO_RANK if p is None else p[0]

    def update(i: int, value: int) -> None:
        rank[i] = value
        k, a, b = leaves + i >> 1, i & -2, i | 1
        while True:
            win = a if rank[a] <= rank[b] else b
            if best[k] == win != i:  # neither before nor now the place that changed
                break
            best[k] = win
            k >>= 1
            if not k:
                break
            a, b = best[2 * k], best[2 * k + 1]

    for i in range(n - 1):
        rank[i] = found(i)
    for k in range(leaves - 1, 0, -1):
        a, b = (best[2 * k], best[2 * k + 1]) if 2 * k < leaves else (2 * k - leaves, 2 * k - leaves + 1)
        best[k] = a if rank[a] <= rank[b] else b
    while rank[best[1]] < NO_RANK:
        i = best[1]
        j = after[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if j < n - 1:
            update(j, NO_RANK)
        update(i, found(i))
        if before[i] >= 0:
            update(before[i], found(before[i]))
    out, i = array("i"), 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Pairs:
    """The merges as an open-addressing hash table, for lookups of many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_PAIR, np.int64)
        self.merged = np.zeros(1 + max((r for r, _ in pairs.values()), default=0), np.int32)
        for (a, b), (rank, merged) in pairs.items():
            key = a << 24 | b
            slot = key * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - self.bits
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << self.bits)
            self.keys[slot], self.rank[slot], self.merged[rank] = key, rank, merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NO_PAIR`` where it can't be merged."""
        key = left.astype(np.int64) << 24 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, self.rank[slot], NO_PAIR)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):  # slots taken by other pairs: look at the next
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


def merge_rows(ids: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts): the symbols left of each row of ``ids`` when every merge is done,
    one after the other, and their number by row. One segment tree a row."""
    m, n = ids.shape
    if n < 2:
        return ids.ravel(), np.full(m, n)
    ids = ids.copy()
    leaves = 1 << max(0, (n - 2).bit_length())
    low = np.full((m, leaves), NO_PAIR, np.int64)
    place = np.arange(n - 1)
    rank = pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, n - 1)
    low[:, :n - 1] = np.where(rank == NO_PAIR, NO_PAIR, rank * TREE_BYTES + place)
    tree = [low]
    while tree[-1].shape[1] > 1:
        tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))
    after = np.tile(np.arange(1, n + 1), (m, 1))
    before = np.tile(np.arange(-1, n), (m, 1))  # of the end too
    alive = np.ones((m, n), bool)
    row = np.flatnonzero(tree[-1][:, 0] < NO_PAIR)
    while len(row):
        root = tree[-1][row, 0]
        i, new = root % TREE_BYTES, pairs.merged[root // TREE_BYTES]
        j = after[row, i]
        k = after[row, j]
        ids[row, i], after[row, i], alive[row, j] = new, k, False
        before[row, k] = i
        low[row[j < n - 1], j[j < n - 1]] = NO_PAIR
        for a, b in ((i, k), (before[row, i], i)):  # the pairs of the new symbol with its neighbours
            ok = (a >= 0) & (b < n) & (a < n - 1)
            r, x, y = row[ok], a[ok], b[ok]
            rank = pairs.ranks(ids[r, x], ids[r, y])
            low[r, x] = np.where(rank == NO_PAIR, NO_PAIR, rank * TREE_BYTES + x)
        end = k == n  # nothing to its right any more
        low[row[end], i[end]] = NO_PAIR
        for q in (i, np.minimum(j, n - 2), np.maximum(before[row, i], 0)):
            for level in range(1, len(tree)):
                q = q >> 1
                below = tree[level - 1]
                tree[level][row, q] = np.minimum(below[row, 2 * q], below[row, 2 * q + 1])
        row = row[tree[-1][row, 0] < NO_PAIR]
    return ids[alive], alive.sum(1)


class Tokenizer:
    """A tokenizer of the file's contents, with the pieces it has seen."""

    def __init__(self, contents: str):
        spec = json.loads(contents)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], spec["normalizer"], pre["add_prefix_space"]) != ("BPE", "ByteLevel", None, False):
            raise ValueError("only byte-level BPE without normalizer and prefix blank is supported")
        vocab, chars = model["vocab"], byte_characters()
        self.of_byte = np.array([vocab[c] for c in chars], np.int32)
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.table = Pairs(self.pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._forget()

    def _forget(self) -> None:
        """Start with the special tokens only, which are pieces of one token."""
        self.place = {s: i for i, s in enumerate(self.special)}
        self.tokens = np.array([*self.special.values()], np.int32)
        self.first, self.count = np.arange(len(self.place)), np.ones(len(self.place), np.int64)

    def _pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        return [p for part in self.split(text) for p in ([part] if part in self.special else self.find(part))]

    def _learn(self, new: list[str]) -> None:
        raw = sorted(((w.encode(), w) for w in new), key=lambda x: len(x[0]))
        tokens, counts, i = [self.tokens], [self.count], 0
        while i < len(raw):
            n, j = len(raw[i][0]), i + 1
            if n > TREE_BYTES:
                ids = merge_array(memoryview(self.of_byte[np.frombuffer(raw[i][0], np.uint8)]), self.pairs)
                tokens.append(np.frombuffer(ids, np.int32))
                counts.append(np.array([len(ids)]))
            else:
                while j < len(raw) and len(raw[j][0]) == n and j < i + TREE_ROWS:
                    j += 1
                rows = np.frombuffer(b"".join(r for r, _ in raw[i:j]), np.uint8).reshape(j - i, n)
                t, c = merge_rows(self.of_byte[rows], self.table)
                tokens.append(t)
                counts.append(c)
            i = j
        at = len(self.place)
        self.place |= {w: at + k for k, (_, w) in enumerate(raw)}
        self.tokens, self.count = np.concatenate(tokens), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        split = [self._pieces(t) for t in texts]
        if len(self.place) > CACHE_PIECES or len(self.tokens) > CACHE_TOKENS:
            self._forget()
        if new := [w for w in set().union(*split) if w not in self.place]:
            self._learn(new)
        out = []
        for words in split:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            n = self.count[at]
            end = np.cumsum(n)
            where = np.repeat(self.first[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)
            out.append(self.tokens[where].astype("<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


class Decoder:
    """The bytes of each id of the file's contents."""

    def __init__(self, contents: str):
        spec = json.loads(contents)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(ids.values()))
        for token, i in ids.items():
            self.bytes_of[i] = (bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token)
                                else token.encode())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[type, tuple] = {}


def _loaded(kind: type, contents: str):
    """One tokenizer and one decoder a Python worker, whatever number of tasks it runs."""
    held, of = _LOADED.get(kind, (None, None))
    if of != hash(contents):
        held = kind(contents)
        _LOADED[kind] = held, hash(contents)
    return held


def _slices(b: pa.RecordBatch, col: pa.Array) -> Iterable[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE_BYTES`` in ``col`` (or of one row)."""
    end = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        base = end[at - 1] if at else 0
        n = max(1, int(np.searchsorted(end, base + SLICE_BYTES, "right")) - at)
        yield b.slice(at, n)
        at += n


def _contents(spark: SparkSession, path: str):
    """The file (a vocabulary, a few MB whatever the corpus) read by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids",
           packed: bool = False) -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text (null: of an empty text) as an
    array, or ``packed`` as little-endian unsigned 32-bit integers in a binary.

    Every row is encoded on its own; other columns stay as they are (one named ``out``
    is replaced), repeated rows stay repeated, an empty table gives an empty result."""
    held, names = _contents(docs.sparkSession, path), docs.columns

    def run(batch: pa.RecordBatch) -> Iterable[dict]:
        t = _loaded(Tokenizer, held.value)
        for b in _slices(batch, batch.column(names.index(text_col))):
            ids = t.encode_all([x or "" for x in b.column(names.index(text_col)).to_pylist()])
            cols = {n: b.column(i) for i, n in enumerate(names)}
            if packed:
                yield cols | {out: [x.tobytes() for x in ids]}
                continue
            ends = np.cumsum([0, *map(len, ids)])
            if ends[-1] >= 1 << 31:
                yield cols | {out: ids}
                continue
            flat = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
            yield cols | {out: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))}

    return map_rows(docs, run, _with(docs, out, T.BinaryType() if packed else T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of ``ids_col``, an array or packed binary (null: empty)."""
    held, names = _contents(df.sparkSession, path), df.columns

    def run(batch: pa.RecordBatch) -> Iterable[dict]:
        t = _loaded(Decoder, held.value)
        kind = batch.column(names.index(ids_col)).type
        binary = pa.types.is_binary(kind) or pa.types.is_large_binary(kind)
        for b in _slices(batch, batch.column(names.index(ids_col))) if binary else [batch]:
            texts = [t.decode(np.frombuffer(x or b"", "<u4").tolist() if binary else x or ())
                     for x in b.column(names.index(ids_col)).to_pylist()]
            yield {n: b.column(i) for i, n in enumerate(names)} | {out: texts}

    return map_rows(df, run, _with(df, out, T.StringType()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (without its text) with the ids packed, n_tokens, ids_sha256 and
    decoded_sha256, by encoding and decoding each text. Both are done in one pass, so that
    a task needs one Python worker."""
    held, names = _contents(docs.sparkSession, path), docs.columns
    kept = [n for n in names if n != "text"]

    def run(batch: pa.RecordBatch) -> Iterable[dict]:
        t, d = _loaded(Tokenizer, held.value), _loaded(Decoder, held.value)
        for b in _slices(batch, batch.column(names.index("text"))):
            ids = t.encode_all([x or "" for x in b.column(names.index("text")).to_pylist()])
            sha = [hashlib.sha256(d.decode(x.tolist()).encode()).hexdigest() for x in ids]
            yield {n: b.column(names.index(n)) for n in kept} | {
                "packed": [x.tobytes() for x in ids], "decoded_sha256": sha}

    schema = T.StructType([docs.schema[n] for n in kept] + [
        T.StructField("packed", T.BinaryType()), T.StructField("decoded_sha256", T.StringType())])
    return map_rows(docs, run, schema).withColumns({
        "n_tokens": (F.octet_length("packed") / 4).cast("long"), "ids_sha256": F.sha2("packed", 256)})


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, packed): ``packed`` are
    the ids as little-endian unsigned 32-bit integers."""
    return digests(docs.select("doc_id", "lang", "source", "text"), path).select(
        "doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "packed")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the 50k byte-level vocabulary, and decoded again."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("packed")
