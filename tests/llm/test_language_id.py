"""Language identification: held-out accuracy, calibration, sparsity, and features against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from quarry.llm import language_id, queries, scratch
from tests.llm.test_operators import DOCS, clashing, odd_table


@pytest.fixture(scope="module")
def predicted(spark, sf):
    docs = scratch.read(spark, sf, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op11_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    return lang, rows


def test_held_out_accuracy(predicted):
    lang, rows = predicted
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 30 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_are_probabilities(spark, sf):
    """With a quarter of the labels wrong, the mean score of held-out documents is near the share that agrees with their labels."""
    from pyspark.sql import functions as F

    docs = scratch.read(spark, sf, "documents")
    noisy = docs.withColumn("lang", F.when(F.xxhash64("doc_id") % 4 == 0, F.lit("xx")).otherwise(F.col("lang")))
    lang = {r["doc_id"]: r["lang"] for r in noisy.select("doc_id", "lang").collect()}
    out = [r for r in language_id.predict_table(noisy).collect() if r["held_out"]]
    right = np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out])
    assert abs(np.mean([r["score"] for r in out]) - right) < 0.15 and right < 0.9


def test_labels_sources_and_held_out_documents_dont_matter(spark, sf):
    """What a prediction may not know is taken away or made wrong."""
    from pyspark.sql import functions as F

    docs = scratch.read(spark, sf, "documents")
    key = lambda d: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in language_id.predict_table(d).collect())
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("wrong")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert key(other) == key(docs)


def test_weights_are_sparse_and_the_sample_is_bounded(spark, sf):
    docs = scratch.read(spark, sf, "documents")
    model = language_id.train(docs)
    assert 0 < (model.weights != 0).mean() < 0.3 and 0.01 < model.temperature < 100
    dense, sparse = (language_id.train(docs, l1=l1) for l1 in (0.0, 0.1))
    assert (sparse.weights != 0).sum() < (model.weights != 0).sum() < (dense.weights != 0).sum()
    known, rows = language_id.sampled(docs.filter("text IS NOT NULL"), sample=40)
    assert len(known) == 4 and len(rows) <= 40 and len({r[2] for r in rows}) == 4


def test_copies_leave_no_sample_empty(spark):
    """Nearly all rows of a language are copies of one text."""
    rows = [(i, "der die das und" if i % 40 else f"eins zwei drei {i}", "de", "a", 1) for i in range(4000)] + [(9000 + i, f"the and of {i}", "en", "a", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    _, got = language_id.sampled(docs, sample=60)
    assert sum(r[2] == 0 for r in got) >= 20 and sum(r[2] == 1 for r in got) == 30


def brute_features(text):
    """Grams of the folded text, one by one, through the same hash."""
    import unicodedata

    inner = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    folded = " " + " ".join(inner.split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            h = 0
            for c in folded[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            h = ((h ^ h >> 15) * (0x85EBCA77 + 2 * n) & 0xFFFFFFFF) >> (32 - language_id.BITS)
            counts[h] = counts.get(h, 0) + 1
    return counts


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 18])
def test_features_are_the_same_in_slices(monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    for text in ("a", "Ab", " a  b ", "The quick, brown fox!", "été 12 été", "x" * 50, "日本語 text", "..a", "a.."):
        ids, counts = language_id.features(text)
        assert dict(zip(ids.tolist(), counts.tolist())) == brute_features(text), text
    assert not len(language_id.features("12 -- !")[0]) and not len(language_id.features(None)[0]) and not len(language_id.features("")[0])


def test_ftrl_follows_its_definition():
    """Two features, two classes, against a plain loop over the closed form."""
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1]), rng.integers(1, 9, 2), int(rng.integers(2))) for _ in range(30)]
    model = language_id.Model(["a", "b"], np.zeros((2, 2)), np.zeros(2), np.ones(2))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.1, 0.2
    language_id.fit(model, rows, rounds=1, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = np.zeros((3, 2)), np.zeros((3, 2))  # the last row is the bias
    lead = lambda i, y: 0.0 if abs(z[i, y]) <= (l1 if i < 2 else 0) else -(z[i, y] - np.sign(z[i, y]) * (l1 if i < 2 else 0)) / ((beta + n[i, y] ** 0.5) / alpha + l2)
    for ids, counts, y in rows:
        x = np.append(model.vector(ids, counts), 1.0)
        w = np.array([[lead(i, c) for c in range(2)] for i in range(3)])
        p = np.exp(x @ w) / np.exp(x @ w).sum()
        for i in range(3):
            for c in range(2):
                g = (p[c] - (c == y)) * x[i]
                z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha * w[i, c]
                n[i, c] += g * g
    want = np.array([[lead(i, c) for c in range(2)] for i in range(3)])
    assert np.allclose(model.weights, want[:2]) and np.allclose(model.bias, want[2])


def test_odd_rows(spark):
    odd = odd_table(spark)
    rows = language_id.predict_table(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["score"] == 0)
    assert sum(r["lang_pred"] == "und" for r in rows) == 3
    key = lambda d: sorted(map(str, language_id.predict_table(d).collect()))
    assert key(clashing(odd)) == key(odd)
    assert language_id.predict_table(odd.limit(0)).count() == 0
    none = language_id.predict_table(spark.createDataFrame([(1, "some text", None, "a", 1)], DOCS)).collect()[0]
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
