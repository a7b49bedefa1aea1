"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions and labels every byte with
language probabilities; a document's probabilities are their mean over all its non-blank
bytes. States start anew at every word (and every ``MAX_WORD`` bytes of a longer one), so
a word's labels depend on the word alone and are computed once for all its occurrences in
a task; the text is read whole.

Training is backpropagation through time in numpy on the driver, over a sample whose
size is bounded for each language by ``DOCS_PER_LANG`` and ``WORDS_PER_DOC`` and is drawn by
hashes, so reruns agree. Every language with a labelled document is learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopflow.llm.common import map_rows, read_table

DOCS_PER_LANG = 200  # labelled documents of a language in the training sample, at most
WORDS_PER_DOC = 48  # words of each, spread over the whole text
MAX_WORD = 32  # bytes read with one state
HIDDEN = 16
EMBED = 12
EPOCHS = 5
BATCH = 256
RATE = 0.01
SEED = 11
CACHE_WORDS = 200_000  # labelled words remembered in a Python worker, of at most
CACHE_LANGS = 64  # languages; with more of them as many fewer words, here and in a batch
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction: h' = (1 - z) * n + z * h with update gate z, reset gate r and
    n = tanh(x W + r * (h U)). The input side is a row of a table for each byte."""

    def __init__(self, p: dict[str, np.ndarray], side: str):
        self.w, self.u, self.b = p["w" + side], p["u" + side], p["b" + side]

    def forward(self, emb: np.ndarray, x: np.ndarray, keep: bool = False):
        """States after each of the bytes x (n words, t bytes); and what ``backward`` needs."""
        table = emb @ self.w + self.b
        h, states, saved = np.zeros((len(x), HIDDEN), emb.dtype), [], []
        for t in range(x.shape[1]):
            a, c = table[x[:, t]], h @ self.u
            zr = _sigmoid(a[:, :2 * HIDDEN] + c[:, :2 * HIDDEN])
            z, r, cn = zr[:, :HIDDEN], zr[:, HIDDEN:], c[:, 2 * HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN:] + r * cn)
            if keep:
                saved.append((h, z, r, cn, n))
            h = (1 - z) * n + z * h
            states.append(h)
        return np.stack(states, 1), saved

    def backward(self, emb, x, saved, d_states, grads, side):
        """Add this direction's gradients, given those of its states."""
        dh = np.zeros_like(d_states[:, 0])
        d_in = np.zeros((x.shape[0], x.shape[1], 3 * HIDDEN), emb.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, cn, n = saved[t]
            dh = dh + d_states[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * cn * r * (1 - r)
            d_in[:, t] = np.concatenate([dz, dr, dn], 1)
            dc = np.concatenate([dz, dr, dn * r], 1)
            grads["u" + side] += h.T @ dc
            dh = dh * z + dc @ self.u.T
        flat, bytes_ = d_in.reshape(-1, 3 * HIDDEN), x.reshape(-1)
        grads["w" + side] += emb[bytes_].T @ flat
        grads["b" + side] += flat.sum(0)
        np.add.at(grads["emb"], bytes_, flat @ self.w.T)


def byte_probabilities(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Language probabilities of every byte of words of one length: (n, t, languages)."""
    fwd, bwd = Gru(p, "f"), Gru(p, "b")
    hf, sf = fwd.forward(p["emb"], x, keep)
    hb, sb = bwd.forward(p["emb"], x[:, ::-1], keep)
    h = np.concatenate([hf, hb[:, ::-1]], 2)
    logits = h @ p["out"] + p["bias"]
    e = np.exp(logits - logits.max(2, keepdims=True))
    return e / e.sum(2, keepdims=True), (h, sf, sb)


def train(words: list[bytes], labels: list[int], n_langs: int) -> dict[str, np.ndarray]:
    """Weights fitted by Adam to label every byte of a word with its document's language."""
    rng = np.random.default_rng(SEED)

    def init(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"emb": init(256, EMBED) * 4, "out": init(2 * HIDDEN, n_langs), "bias": np.zeros(n_langs, np.float32)}
    for side in "fb":
        p |= {"w" + side: init(EMBED, 3 * HIDDEN), "u" + side: init(HIDDEN, 3 * HIDDEN),
              "b" + side: np.zeros(3 * HIDDEN, np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    label = np.array(labels)
    for epoch in range(EPOCHS):
        batches = [own[i:i + BATCH] for n in sorted(by_length)
                   for own in [rng.permutation(by_length[n])] for i in range(0, len(own), BATCH)]
        for k in rng.permutation(len(batches)):
            at = batches[k]
            x = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), -1)
            grads = _gradients(p, x, label[at])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] = p[name] - (rate * (m[name] / (1 - 0.9 ** step))
                                     / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


def _gradients(p, x, y):
    prob, (h, sf, sb) = byte_probabilities(p, x, True)
    d = prob.copy()
    d[np.arange(len(x)), :, y] -= 1
    d /= d.shape[0] * d.shape[1]
    grads = {k: np.zeros_like(a) for k, a in p.items()}
    grads["out"] = np.einsum("nth,ntl->hl", h, d)
    grads["bias"] = d.sum((0, 1))
    dh = d @ p["out"].T
    Gru(p, "f").backward(p["emb"], x, sf, dh[:, :, :HIDDEN], grads, "f")
    Gru(p, "b").backward(p["emb"], x[:, ::-1], sb, dh[:, ::-1, HIDDEN:], grads, "b")
    return grads


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, those beyond ``MAX_WORD`` bytes in pieces."""
    words = text.split()
    if any(len(w) > MAX_WORD for w in words):
        words = [w[i:i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]
    return words


class Labeller:
    """Language probabilities of documents; remembers the words it has labelled."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.place = p, {}
        self.sums = np.zeros((0, p["out"].shape[1]), np.float32)
        self.share = min(1.0, CACHE_LANGS / self.sums.shape[1])

    def _learn(self, new: list[bytes]) -> None:
        new.sort(key=lambda w: (len(w), w))
        sums, i = [], 0
        while i < len(new):
            j, n = i, len(new[i])
            while j < len(new) and len(new[j]) == n and j < i + max(1, 2048 * self.share):
                j += 1
            x = np.frombuffer(b"".join(new[i:j]), np.uint8).reshape(j - i, n)
            sums.append(byte_probabilities(self.p, x)[0].sum(1))
            i = j
        at = len(self.place)
        self.place |= {w: at + k for k, w in enumerate(new)}
        self.sums = np.concatenate([self.sums[:at], *sums])

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """The mean label of the non-blank bytes of each text; zeros where it has none."""
        out = np.zeros((len(texts), self.sums.shape[1]))
        for lo in range(0, len(texts), 256):
            split = [words_of(t) for t in texts[lo:lo + 256]]
            if len(self.place) > CACHE_WORDS * self.share:
                self.place, self.sums = {}, self.sums[:0]
            if new := [w for w in set().union(*split) if w not in self.place]:
                self._learn(new)
            for k, words in enumerate(split):
                if words:
                    at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                    out[lo + k] = self.sums[at].sum(0, dtype=np.float64) / sum(map(len, words))
        return out


_LABELLERS: dict[bytes, Labeller] = {}


def _labeller(p: dict[str, np.ndarray]) -> Labeller:
    key = p["out"].tobytes()
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(p)
    return _LABELLERS[key]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def fit(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, weights) from the labelled documents that aren't held out. Without any
    such document there are no languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                       & F.col("text").rlike(r"\p{L}"))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return [], None
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").withColumn(
        "k", F.row_number().over(first)).where(F.col("k") <= DOCS_PER_LANG).select("doc_id")

    def pick(b: pa.RecordBatch) -> dict:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            words = words_of(text)
            rng = np.random.default_rng([SEED, doc & 0xFFFFFFFF, doc >> 32 & 0xFFFFFFFF])
            at = rng.choice(len(words), min(len(words), WORDS_PER_DOC), replace=False)
            out.append([words[i] for i in sorted(at)])
        return {"doc_id": b.column(0), "lang": b.column(1), "words": out}

    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", _lowered(F.col("text")).alias("t"))
    rows = map_rows(sample, pick, "doc_id long, lang string, words array<binary>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.words))
    pairs = [(bytes(w), langs.index(r.lang)) for r in rows for w in r.words]
    return langs, train([w for w, _ in pairs], [y for _, y in pairs], len(langs))


def predict(docs: DataFrame, langs: list[str], weights: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row. The score is the mean probability
    of the predicted language over the text's non-blank bytes. ``und`` with score 0 for a
    null text, a text without a letter, or where no language was learned. Ties go to the
    first language in code point order. Other columns are ignored."""

    def run(b: pa.RecordBatch) -> dict:
        n = b.num_rows
        if weights is None:
            return {"doc_id": b.column(0), "lang_pred": [UNKNOWN] * n, "score": np.zeros(n)}
        letters = b.column(1).to_numpy(zero_copy_only=False)
        prob = _labeller(weights).probabilities(b.column(2).to_pylist())
        best = prob.argmax(1)
        return {"doc_id": b.column(0), "lang_pred": [langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)],
                "score": np.where(letters, np.clip(prob.max(1), 0, 1), 0.0)}

    text = F.col("text")
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                                _lowered(text).alias("t")),
                    run, "doc_id long, lang_pred string, score double")


def op3_lang_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from two thirds of the labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, *fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
