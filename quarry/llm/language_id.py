"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters and marks becomes one space, and its n-grams of 1 to 3 characters are hashed to 2**15
features, counted over the whole text. Weights are logarithmic term frequency times inverse document frequency, of length one.
Document frequencies are counted over all documents that may be learned from. The regression is trained on a bounded sample with
follow-the-regularised-leader (per-coordinate rates, elastic net: `l1` keeps weights at exactly 0, `l2` keeps them small), and a
part of the sample that it doesn't see sets the temperature at which the probabilities are right.

Bounds, all parameters: the `languages` most frequent values are learned, on at most `sample` distinct texts in all, as many from each (the
least hashes of the text), so that copies and a large language take no more than their share. The driver gets their features and one vector of
document frequencies, whatever the data.

Nulls and odd rows: a null text, and one without a letter, is `und` with score 0; so is every text if nothing can be learned. A null lang isn't
learned from; an empty one is a value like others. A null doc_id counts as not held out. Equal scores go to the language that sorts first. Repeated rows give one result row each.
Very long texts are counted in slices that overlap. Extra columns are ignored by `predict_table`. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quarry.llm import scratch, vectors
from quarry.llm.scratch import fresh, small_batches

BITS = 15
MAX_ORDER = 3
SAMPLE, LANGUAGES = 3_000, 200
#: Characters that are counted at once.
SLICE = 1 << 18
UNKNOWN = "und"
_GAP = np.full(1, 32, np.uint32)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter; is it a letter or a mark."""
    first = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    letter = first == ord("L")
    return letter, letter | (first == ord("M"))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text in ascending order, and how often each occurs; none if the text has no letter."""
    letter, inner = _kinds()
    counts = np.zeros(1 << BITS, np.int64)
    tail, any_letter = _GAP, False
    for lo in range(0, len(text or ""), SLICE):
        codes = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter = any_letter or bool(letter[codes].any())
        codes = np.concatenate([tail, np.where(inner[codes], codes, np.uint32(32)), _GAP[: lo + SLICE >= len(text)]])
        fresh_ = len(tail)
        keep = np.ones(len(codes), bool)
        keep[fresh_:] = (codes[fresh_:] != 32) | (codes[fresh_ - 1 : -1] != 32)
        codes = codes[keep]
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, MAX_ORDER + 1):
            # grams that end in this slice; those that end in the tail were counted with the one before
            h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
            start = max(0, fresh_ - n + 1) if lo else 0
            mixed = (h[start:] ^ (h[start:] >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
        tail = codes[-(MAX_ORDER - 1) :]
    if not any_letter:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


@dataclass
class Model:
    """Sparse weights (features, languages), with bias, inverse document frequencies and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[ids]
        return x / np.sqrt((x * x).sum())

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(ids, counts) @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, counts = features(text)
        if not len(ids) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(ids, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
    """Train weights and bias in place by follow-the-regularised-leader, one row at a time, in the order of `rows`.

    State per weight: the sum z of gradients less what the weight has moved, and the sum n of their squares; the weight
    that leads follows from both.
    """
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros_like(model.bias), np.zeros_like(model.bias)

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    vectors_ = [model.vector(i, c) for i, c, _ in rows]
    for _ in range(rounds):
        for (ids, _, y), x in zip(rows, vectors_):
            w, b = leader(z[ids], n[ids], l1), leader(zb, nb, 0.0)
            g = softmax(x @ w + b)
            g[y] -= 1
            for zs, ns, at, grad, now in ((z, n, ids, np.outer(x, g), w), (zb, nb, slice(None), g, b)):
                old = ns[at]
                new = old + grad * grad
                zs[at] += grad - (np.sqrt(new) - np.sqrt(old)) / alpha * now
                ns[at] = new
    model.weights, model.bias = leader(z, n, l1), leader(zb, nb, 0.0)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Set the temperature of least log loss on rows that the weights haven't seen, by golden section on its logarithm."""
    if not rows:
        return
    z, y = np.stack([model.logits(i, c) for i, c, _ in rows]), np.array([r[2] for r in rows])
    # one error more than were made, so that a sample without any doesn't ask for certainty
    wrong = 1 / (len(rows) + 1)

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))
        return -float(((1 - wrong) * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) + wrong * np.log(np.maximum(p, 1e-300)).mean(axis=1)).mean())

    lo, hi, ratio = np.log(0.01), np.log(100.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each feature over the first column's texts, and the number of texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                ids, _ = features(t)
                if len(ids):
                    df[ids] += 1
                    df[-1] += 1
        yield from vectors.pieces(df)

    texts = small_batches(texts)
    df = vectors.total(texts.mapInArrow(run, vectors.SCHEMA), vectors.splits(texts), (1 << BITS) + 1, "int64", 1 << 62)
    return df[:-1], int(df[-1])


def sampled(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, int]]]:
    """The languages, and the features of as many distinct texts of each, at most `sample` in all, in the order of their hashes."""
    most = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    known = sorted(r["lang"] for r in most)
    if not known:
        return [], []
    each = max(1, sample // len(known))
    share = {r["lang"]: min(1.0, 2 * each / r["count"]) for r in most}
    hashed = docs.select("lang", F.xxhash64("text").alias("h"), "text")
    chosen: dict[str, set[int]] = {}
    while len(chosen) < len(known):
        # copies may leave fewer distinct hashes than rows: a language that has too few is looked at again, with a larger share
        limits = docs.sparkSession.createDataFrame([(k, scratch.hash_limit(share[k])) for k in known if k not in chosen], "lang string, most long")
        some = hashed.select("lang", "h").join(F.broadcast(limits), "lang").filter("h <= most").select("lang", "h").distinct()
        least = some.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("h")), 1, each).alias("h"))
        found = {r["lang"]: r for r in least.collect()}
        for k in [k for k in known if k not in chosen]:
            if share[k] >= 1 or (k in found and found[k]["n"] >= each // 4):
                chosen[k] = set(found[k]["h"]) if k in found else set()
            share[k] = min(1.0, 16 * share[k])
    index = {k: i for i, k in enumerate(known)}
    picked = docs.sparkSession.createDataFrame([(k, h) for k, hs in chosen.items() for h in hs], "lang string, h long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[str, int]] = set()
        for b in batches:
            for lang, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (lang, h) not in held:
                    held.add((lang, h))
                    ids, counts = features(text)
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h], pa.int64()), pa.array([ids.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["lang", "h", "ids", "counts"])

    rows = small_batches(hashed).join(F.broadcast(picked), ["lang", "h"]).mapInArrow(run, "lang string, h long, ids binary, counts binary").dropDuplicates(["lang", "h"]).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"]))
    return known, [(np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(np.int64), index[r["lang"]]) for r in rows]


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, **rates: float) -> Model:
    """A model of the languages of `docs`; only text and lang count, every fifth row of the sample sets the temperature."""
    docs = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    known, rows = sampled(docs, sample, languages)
    model = Model(known, np.zeros((1 << BITS, len(known))), np.zeros(len(known)), np.ones(1 << BITS))
    if known:
        df, n = frequencies(docs.select("text"))
        model.idf = 1 + np.log((1 + n) / (1 + df))
        fit(model, [r for k, r in enumerate(rows) if k % 5], **rates)
        calibrate(model, rows[::5])
    return model


def predicted(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """docs with a struct `into` of lang_pred and score, by the text alone. A narrow map; the model goes along as a broadcast of bounded size."""
    small = Model(model.languages, model.weights.astype(np.float32), model.bias, model.idf, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(small)
    out = StructType([*docs.schema.fields, StructField(into, StructType.fromDDL("lang_pred string, score double"))])
    where, arrow = docs.columns.index("text"), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(("lang_pred", "score"), shared.value.predict(t))) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow.field(into).type)], names=arrow.names)

    return small_batches(docs).mapInArrow(run, out)


def predict_table(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per document, by a model of the documents that aren't held out."""
    model = train(docs.filter(~held_out()), sample)
    found = fresh(docs.select("doc_id", "text"), "found")
    d = predicted(docs.select("doc_id", "text"), model, found)
    return d.select("doc_id", held_out().alias("held_out"), F.col(found)["lang_pred"].alias("lang_pred"), F.round(F.col(found)["score"], 6).alias("score"))
