import zlib

import numpy as np
import pytest
from conftest_llm import clash

from shopflow.llm import lang_gru as L


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.predict(docs, *model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang and r.lang_pred != "und"]
    right = sum(r.lang == r.lang_pred for r in out) / len(out)
    assert len(out) > 200 and right >= 0.97, right


def test_edges(spark, docs, no_docs, model):
    rows = {r.doc_id: r for r in L.predict(clash(docs, "letters", "score", "t", "held_out"), *model).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count()
    for d in (9000, 9001, 9002, 9006):
        assert (rows[d].lang_pred, rows[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.lang_pred in (*model[0], "und") for r in rows.values())
    assert rows[9003].lang_pred != "und"
    assert L.predict(no_docs, *model).count() == 0


def test_without_labels_nothing_is_learned(spark, no_docs):
    from pyspark.sql import functions as F

    langs, weights = L.fit(no_docs)
    assert langs == [] and weights is None
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [tuple(r) for r in L.predict(df, *L.fit(df)).collect()] == [(1, "und", 0.0)]


def test_every_language_is_learned(spark):
    """70 languages, each with letters of its own; the last six have the fewest documents."""
    rng = np.random.default_rng(3)
    rows = [(100 * k + d, " ".join(chr(0x4E00 + 40 * k + i) * 2 for i in rng.integers(0, 6, 60)), f"l{k:02}")
            for k in range(70) for d in range(20 if k < 64 else 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, weights = L.fit(df)
    assert langs == [f"l{k:02}" for k in range(70)] and weights["out"].shape[1] == 70
    pred = {r.doc_id: r.lang_pred for r in L.predict(df, langs, weights).collect()}
    right = [pred[d] == lang for d, _, lang in rows if lang >= "l64"]
    assert sum(right) > 0.7 * len(right), sum(right) / len(right)


def test_only_training_rows_are_seen(spark, model):
    """Changing labels and texts of held-out rows changes nothing learned; reruns agree."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = L.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn(
        "text", F.when(held, "zzz").otherwise(F.col("text"))).repartition(3)
    langs, weights = L.fit(other)
    assert langs == model[0] and all((weights[k] == model[1][k]).all() for k in weights)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {"emb": rng.normal(size=(256, L.EMBED)), "out": rng.normal(size=(2 * L.HIDDEN, 3)), "bias": rng.normal(size=3)}
    for s in "fb":
        p |= {"w" + s: rng.normal(size=(L.EMBED, 3 * L.HIDDEN)) / 3, "u" + s: rng.normal(size=(L.HIDDEN, 3 * L.HIDDEN)) / 3,
              "b" + s: rng.normal(size=3 * L.HIDDEN)}
    x, y = rng.integers(97, 123, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        q, _ = L.byte_probabilities(p, x)
        return -np.log(q[np.arange(4)[:, None], np.arange(5)[None], y[:, None]]).mean()

    grads = L._gradients(p, x, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in g.shape)
            if name == "emb":
                at = (int(x[0, 2]), at[1])
            old = p[name][at]
            p[name][at] = old + 1e-5
            up = loss()
            p[name][at] = old - 1e-5
            down = loss()
            p[name][at] = old
            assert np.isclose(g[at], (up - down) / 2e-5, atol=1e-6), name


def test_a_document_is_the_mean_of_its_bytes(model):
    langs, p = model
    text = "Été naïve, the quick ".encode() + b"x" * 70
    words = L.words_of(text)
    want = sum(L.byte_probabilities(p, np.frombuffer(w, np.uint8)[None])[0][0].sum(0) for w in words) / sum(map(len, words))
    assert np.allclose(L.Labeller(p).probabilities([b"", text])[1], want, atol=1e-5)
    assert b"".join(words) == b"".join(text.split()) and max(map(len, words)) <= L.MAX_WORD
