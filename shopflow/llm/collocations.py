"""Phrases of two to four words that stay together, by direct-address tiles of word pairs.

Texts become chunks: runs of words of one language, as numbers of a vocabulary that each
chunk brings along. The chunks' vocabularies are summed to the words of the corpus, frequent
words get ids by falling frequency, and the ids go back to the chunks by a join, so no task
holds the vocabulary of the corpus.

Pairs of neighbouring ids fall into tiles of 1,024 by 1,024. Ids being ranks, the pairs
crowd into the tiles of low ranks: a tile with many pairs in a task is counted by
``bincount`` in a dense array that stays open over the task, the rest as sorted coordinates.
Counts are summed by Spark, key by key, so a hot tile or pair is spread over the tasks that
met it. Frequent pairs are ranked in turn, and pairs of overlapping ones (words 1-2 and 2-3)
are the phrases of three words, counted in the same way; once more for four.

The ``HEAD`` most frequent phrases of a length are ranked and sent to the tasks, a table of
fixed size; frequent phrases beyond are marked in a bitmap of ``FILTER`` bits, and what they
lead to is counted by its word ids. A false mark costs a count that is dropped in the end,
so results are exact whatever the two bounds.

Null texts are empty, a null language is ``und``. Repeated rows count each time. Words run
up to any length, texts too (they are cut into chunks at the ends of pieces only). Ties are
ranked by the phrase. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import drop_shuffles, read_table, stage_table
from shopflow.operators.ranking import global_row_number
from shopflow.session import ship_package

SPLIT = b".,;:!?\n\x0b\x0c\r"  # fixed: what ends a piece
END = b"\xff"  # stands for it: a byte that UTF-8 text never has
TO_WORDS = bytes.maketrans(SPLIT + b"\t" + bytes(range(65, 91)), END * len(SPLIT) + b" " + bytes(range(97, 123)))
CHUNK_BYTES = 4 << 20
HELD_BYTES = 16 << 20  # text waiting for its chunk in a task
TILE = 1024
DENSE = TILE * TILE // 16  # pairs of a tile in a buffer from which it is counted densely
TILES = 8  # dense arrays open in a task
LOW_TILES = 64  # tiles a side that may be dense
BUFFER = 1 << 21  # pairs held before they are counted
HEAD = 1 << 20
FILTER = 67_108_859  # a prime below 2^26
ROWS = 1 << 16  # rows of a batch sent to Spark


def pack(seq: np.ndarray) -> bytes:
    kind = "<u2" if not len(seq) or seq.max() < 1 << 16 else "<u4"
    return kind[-1].encode() + zlib.compress(seq.astype(kind).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), "<u" + raw[:1].decode()).astype(np.int64)


def chunk(words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(vocabulary by falling count, counts, sequence): places in the vocabulary from 1, 0
    where a piece ends."""
    place = {w: i for i, w in enumerate(dict.fromkeys([END, *words]))}
    seq = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    counts = np.bincount(seq, minlength=len(place))
    counts[0] = 0
    order = 1 + np.argsort(-counts[1:], kind="stable")
    to = np.zeros(len(place), np.int64)
    to[order] = np.arange(1, len(place))
    names = list(place)
    return [names[i] for i in order], counts[order], to[seq]


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(chunk, lang, n, words, counts, seq): the texts as chunks of one language each."""
    ship_package(docs.sparkSession)

    def cut(texts: list[bytes]) -> Iterator[list[bytes]]:
        data, at = END.join(texts).translate(TO_WORDS), 0
        while at < len(data):
            end = len(data)
            if end - at > CHUNK_BYTES:
                end = data.rfind(END, at, at + CHUNK_BYTES)
                end = end if end >= 0 else data.find(END, at + CHUNK_BYTES)
                end = end if end >= 0 else len(data)
            yield data[at:end].replace(END, b" " + END + b" ").split()
            at = end + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            size.pop(lang)
            for tokens in cut(held.pop(lang)):
                words, counts, seq = chunk(tokens)
                if len(words):
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([number], pa.int64()), "lang": pa.array([lang]),
                        "n": pa.array([int(counts.sum())], pa.int64()),
                        "words": pa.array([words], pa.list_(pa.string())),
                        "counts": pa.array([counts], pa.list_(pa.int64())),
                        "seq": pa.array([pack(seq)], pa.binary())})
                    number += 1

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK_BYTES:
                    yield from flush(lang)
                elif sum(size.values()) >= HELD_BYTES:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return docs.select(F.coalesce(lang_col, F.lit("und")), text_col).mapInArrow(
        run, "chunk long, lang string, n long, words array<string>, counts array<long>, seq binary")


def word_ids(parts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words found ``least`` times: ids from 1 by falling f."""
    words = (parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
             .groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
             .where(F.col("f") >= least))
    return global_row_number(words, [F.desc("f"), F.asc("lang"), F.asc("word")], "id")


def numbered(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(seq, ids) of the chunks: ``ids`` hold place << 32 | id for their frequent words."""
    vocabulary = parts.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    ids = (vocabulary.join(words.select("lang", "word", "id"), ["lang", "word"])
           .groupBy("chunk").agg(F.collect_list(F.shiftleft(F.col("place") + F.lit(1).cast("long"), 32)
                                                .bitwiseOR(F.col("id"))).alias("ids")))
    return parts.select("chunk", "seq").join(ids, "chunk").select("seq", "ids")


@dataclass
class Head:
    """The ranked phrases of a length: sorted keys (id of the part without the last word
    << 32 | id of that without the first) with their ids from 1, and the words of each id."""

    keys: np.ndarray
    ids: np.ndarray
    words: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key, 0 for others."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64)
        some, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        return np.where(self.keys[at] == some, self.ids[at], 0)[back]


def filter_place(hi, lo):
    """The bit of a phrase, for numbers as for columns (all below 2^63)."""
    return (hi % 2147483647 * 1640531527 + lo % 2147483629 * 1013904223) % FILTER


def phrase_keys(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words 1 and 2, and words 3 and 4 (0 where there is none), in a long each."""
    w = [*words, *[np.zeros_like(words[0])] * (4 - len(words))]
    return w[0] << 32 | w[1], w[2] << 32 | w[3]


class TileCounter:
    """Counts of pairs of ids: dense arrays for crowded tiles, sorted coordinates for others."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0
        self.dense: dict[int, np.ndarray] = {}

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # tile of a, tile of b, cell: ids are below 2^31
        self.held.append((a // TILE) << 41 | (b // TILE) << 20 | (a % TILE) << 10 | b % TILE)
        self.size += len(a)
        if self.size >= BUFFER:
            yield from self.count()

    def count(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys = np.concatenate([np.zeros(0, np.int64), *self.held])
        self.held, self.size = [], 0
        left, right = keys >> 41, keys >> 20 & (1 << 21) - 1
        low = (left < LOW_TILES) & (right < LOW_TILES)
        tile = np.where(low, left * LOW_TILES + right, LOW_TILES * LOW_TILES).astype(np.int16)
        del left, right, low
        crowd = np.bincount(tile, minlength=LOW_TILES * LOW_TILES + 1)[:-1]
        rest = np.ones(len(keys), bool)
        for t in np.flatnonzero(crowd >= DENSE):
            mine = tile == t
            rest &= ~mine
            if t not in self.dense and len(self.dense) >= TILES:
                yield from self.close()
            cells = np.bincount(keys[mine] & TILE * TILE - 1, minlength=TILE * TILE)
            self.dense[t] = self.dense[t] + cells if t in self.dense else cells
        keys = keys[rest]
        del tile, rest
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.diff(first, append=len(keys))
        yield ((keys >> 41) * TILE + (keys >> 10 & TILE - 1),
               (keys >> 20 & (1 << 21) - 1) * TILE + (keys & TILE - 1), counts)

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield t // LOW_TILES * TILE + at // TILE, t % LOW_TILES * TILE + at % TILE, cells[at]
        self.dense = {}


def live_units(ids: np.ndarray, size: int, heads: dict[int, Head], marks: dict[int, np.ndarray | None]):
    """For the phrases of ``size`` words at each place: (id or 0, whether it may be frequent)."""
    unit, live = ids, ids > 0
    for k in range(2, size + 1):
        both = (unit[:-1] > 0) & (unit[1:] > 0)
        found = np.zeros(len(both), np.int64)
        found[both] = heads[k].find(unit[:-1][both] << 32 | unit[1:][both])
        known = found > 0
        if marks[k] is not None:
            at = np.flatnonzero(live[:-1] & live[1:] & ~known)
            bit = filter_place(*phrase_keys([ids[at + j] for j in range(k)]))
            known[at] = marks[k][bit >> 3] >> (bit & 7) & 1 > 0
        unit, live = found, known
    return unit, live


def count_phrases(seqs: DataFrame, size: int, least: int, heads: dict[int, Head],
                  marks: dict[int, np.ndarray | None]) -> DataFrame:
    """(hi, lo, f) of the phrases of ``size`` words found ``least`` times, those of
    ``size - 1`` words being given by ``heads`` and ``marks``."""
    held = seqs.sparkSession.sparkContext.broadcast((heads, marks))

    def batches_of(hi, lo, f) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(hi), ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[i:i + ROWS].astype(np.int64)) for x in (hi, lo, f)], ["hi", "lo", "f"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, marks = held.value
        counter = TileCounter()

        def sent(counted) -> Iterator[pa.RecordBatch]:
            for a, b, f in counted:
                words = [a, b] if size == 2 else [*heads[size - 1].words[a - 1].T.astype(np.int64),
                                                  heads[size - 1].words[b - 1, -1].astype(np.int64)]
                yield from batches_of(*phrase_keys(words), f)

        for batch in batches:
            for raw, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq = unpack(raw)
                to = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
                places = places.values.to_numpy()
                to[places >> 32] = places & (1 << 32) - 1
                ids = to[seq]
                if len(ids) < size:
                    continue
                unit, live = live_units(ids, size - 1, heads, marks)
                live = live[:-1] & live[1:]
                ranked = live & (unit[:-1] > 0) & (unit[1:] > 0)
                yield from sent(counter.add(unit[:-1][ranked], unit[1:][ranked]))
                at = np.flatnonzero(live & ~ranked)
                if len(at):  # beyond the ranked phrases: by word ids
                    hi, lo = phrase_keys([ids[at + j] for j in range(size)])
                    order = np.lexsort((lo, hi))
                    hi, lo = hi[order], lo[order]
                    first = np.flatnonzero(np.append(True, (np.diff(hi) != 0) | (np.diff(lo) != 0)))
                    yield from batches_of(hi[first], lo[first], np.diff(first, append=len(hi)))
        yield from sent(counter.count())
        yield from sent(counter.close())

    rows = seqs.mapInArrow(run, "hi long, lo long, f long")
    return rows.groupBy("hi", "lo").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def rank_head(found: DataFrame, size: int, heads: dict[int, Head], limit: int) -> tuple[Head, np.ndarray | None]:
    """The ``limit`` most frequent phrases ranked, and the bitmap of the others (None if none)."""
    top = found.orderBy(F.desc("f"), "hi", "lo").limit(limit).select("hi", "lo").toArrow()
    hi, lo = (top.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo"))
    words = np.stack([hi >> 32, hi & (1 << 32) - 1, lo >> 32, lo & (1 << 32) - 1][:size], 1)
    parts = [words[:, :-1], words[:, 1:]]
    for k in range(2, size):
        parts = [np.stack([heads[k].find(p[:, j] << 32 | p[:, j + 1]) for j in range(p.shape[1] - 1)], 1) for p in parts]
    left, right = parts[0][:, 0], parts[1][:, 0]
    ok = (left > 0) & (right > 0)  # a phrase with a part beyond the ranked ones is marked instead
    keys, words = (left << 32 | right)[ok], words[ok].astype(np.int32)
    order = np.argsort(keys)
    head = Head(keys[order], (1 + order).astype(np.int64), words)
    if len(hi) < limit and ok.all():
        return head, None
    place = filter_place(F.col("hi"), F.col("lo")) + 1  # Spark's bitmaps count from 1
    blocks = found.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # of FILTER bits at most
    marks = np.zeros((FILTER // 32768 + 1) * 4096, np.uint8)
    for r in blocks:
        at = (r.b - 1) * 4096
        marks[at:at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return head, marks


def frequent(docs: DataFrame, least: int = 30, longest: int = 4, head: int = HEAD,
             lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """(words with ids and f, {size: phrases (hi, lo, f)}, words in all by language), staged.
    ``longest`` is 4 at most."""
    spark = docs.sparkSession
    parts = stage_table(chunks(docs, lang_col, text_col), "phrases-chunks")
    sizes = stage_table(parts.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
    words = stage_table(word_ids(parts, least), "phrases-words")
    if (words.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    seqs = stage_table(numbered(parts, words), "phrases-seqs")
    drop_shuffles(spark)
    heads: dict[int, Head] = {}
    marks: dict[int, np.ndarray | None] = {}
    found: dict[int, DataFrame] = {}
    for size in range(2, longest + 1):
        found[size] = stage_table(count_phrases(seqs, size, least, heads, marks), f"phrases-{size}")
        drop_shuffles(spark)
        if size < longest:
            heads[size], marks[size] = rank_head(found[size], size, heads, head)
    return words, found, sizes


def _high(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def _low(c: Column) -> Column:
    return c.bitwiseAND((1 << 32) - 1)


def _two(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


def scored(words: DataFrame, found: dict[int, DataFrame]) -> DataFrame:
    """(lang, hi, lo, a, l, r, score) of every phrase: the cut that scores lowest, the
    first of equals."""
    none = F.lit(0).cast("long")
    units = words.select(_two(F.col("id"), none).alias("hi"), none.alias("lo"), "f", "lang")
    phrases = None
    for df in found.values():
        phrases = df if phrases is None else phrases.unionByName(df)
    units = units.unionByName(phrases.withColumn("lang", F.lit(None).cast("string")))
    w1, w2, w3, w4 = _high(F.col("hi")), _low(F.col("hi")), _high(F.col("lo")), _low(F.col("lo"))

    def cut(k: int, left: tuple, right: tuple, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(k).alias("k"), left[0].alias("lh"), left[1].alias("ll"),
                                      right[0].alias("rh"), right[1].alias("rl")))

    cuts = F.array_compact(F.array(
        cut(1, (_two(w1, none), none), (_two(w2, w3), _two(w4, none)), F.lit(True)),
        cut(2, (F.col("hi"), none), (F.col("lo"), none), w3 > 0),
        cut(3, (F.col("hi"), _two(w3, none)), (_two(w4, none), none), w4 > 0)))
    each = phrases.withColumnRenamed("f", "a").select("hi", "lo", "a", F.explode(cuts).alias("c")).select("hi", "lo", "a", "c.*")
    left = units.select(F.col("hi").alias("lh"), F.col("lo").alias("ll"), F.col("f").alias("l"), "lang")
    right = units.select(F.col("hi").alias("rh"), F.col("lo").alias("rl"), F.col("f").alias("r"))
    # decimals of 20 digits hold any sum of two longs, 27 the product
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))"
                   " div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return (each.join(left, ["lh", "ll"]).join(right, ["rh", "rl"])
            .groupBy("hi", "lo", "a").agg(best, F.max("lang").alias("lang"))
            .select("lang", "hi", "lo", "a", "best.l", "best.r", "best.score"))


def inside_longer(found: dict[int, DataFrame]) -> DataFrame:
    """(hi, lo, most): the highest count of a longer phrase that the phrase lies in."""
    w = [_high(F.col("hi")), _low(F.col("hi")), _high(F.col("lo")), _low(F.col("lo"))]
    none, out = F.lit(0).cast("long"), None
    for size, df in found.items():
        spans = [w[i:i + n] for n in range(2, size) for i in range(size - n + 1)]
        if not spans:
            continue
        keys = F.array(*[F.struct(_two(s[0], s[1]).alias("hi"), (_two(s[2], none) if len(s) > 2 else none).alias("lo"))
                         for s in spans])
        part = df.select(F.explode(keys).alias("k"), "f").select("k.hi", "k.lo", "f")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("hi", "lo").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, head: int = HEAD,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    words, found, sizes = frequent(docs, least, 4, head, lang_col, text_col)
    most = F.col("most").cast("decimal(19, 0)") * 100 >= F.col("a").cast("decimal(19, 0)") * share
    kept = stage_table(scored(words, found).join(inside_longer(found), ["hi", "lo"], "left")
                       .where(F.col("most").isNull() | ~most).drop("most"), "phrases-scored")
    # The lowest score that can be among the first: at most 1,000,001 scores a language.
    by_score = kept.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("c"))
    above = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    bound = (by_score.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top)
             .groupBy("lang").agg(F.min("score").alias("bound")))
    kept = kept.join(bound, "lang").where("score >= bound").drop("bound")
    spelt = (kept.select("hi", "lo", F.posexplode(F.array(
        _high(F.col("hi")), _low(F.col("hi")), _high(F.col("lo")), _low(F.col("lo")))).alias("at", "id"))
        .join(words.select("id", "word"), "id")  # id 0 is no word
        .groupBy("hi", "lo").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("hi", "lo", F.array_join("w.word", " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.join(spelt, ["hi", "lo"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language over all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH piece AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents WHERE text IS NOT NULL)),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spot, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
cut AS (
  SELECT c.lang, c.k, c.phrase, a, j, l.f AS l, r.f AS r,
         (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS most
  FROM cand, range(2, 4) t(m), range(1, 4) u(s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN part USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
