"""Quality classifier from weak labels.

Heuristic labellers each call a text good, bad, or pass. Expectation-maximisation over the counts of their vote
patterns, of all documents, estimates how accurate each is in either class and the posterior of every
pattern. Posteriors, as soft labels of a bounded sample, train a hashed linear scorer on word shapes,
shape pairs and words, which then scores every document.

Bounds: at most 3**7 vote patterns and the features of `sample` documents (SAMPLE) reach the driver, whatever the data; the
weights are 2**15. All documents count in the expectation-maximisation, all are scored, over whole texts.

Nulls and odd rows: a null or empty text, or one without words, scores 0 and is rejected. A score at the threshold is
kept. Repeated rows score alike, each with its row. Extra columns are ignored by `score_table` and
passed through by `apply_classifier`. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm import scratch
from quarry.llm.divergence import _CLASS, WORD_BIN
from quarry.llm.scratch import fresh, small_batches
from quarry.llm.stores import Store

SAMPLE = 4_000
BINS = 1 << 15
#: A document goes only on clear evidence; very short clean texts often score between this and a half.
THRESHOLD = 0.15
LABELLERS = ("symbols", "capitals", "echoes", "variety", "marks", "sentences", "common")


def _call(x: float, good: float, bad: float) -> str:
    """1 good, 0 bad, - pass; good and bad are limits, on whichever side."""
    if good < bad:
        return "1" if x <= good else "0" if x >= bad else "-"
    return "1" if x >= good else "0" if x <= bad else "-"


def votes(text: str) -> str:
    """One character per labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    chars = np.bincount(_CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8)
    small, large, symbols, stops = int(chars[0]), int(chars[1]), int(chars[6]), int(chars[4])
    long = n >= 20
    return (
        _call(symbols / len(text), 0.005, 0.02)
        + _call(large / max(1, small + large), 0.15, 0.4)
        + _call(sum(map(str.__eq__, words, words[1:])) / n, 0.03, 0.1)
        + (_call(len(set(words)) / n**0.8, 0.7, 0.35) if n >= 50 else "-")
        + _call((text.count("|") + text.count("!!")) / n, 0.02, 0.1)
        + (_call(n / max(1, stops), 40.0, 80.0) if long else "-")
        + (_call(sum(map(WORD_BIN.__contains__, text.lower().encode("utf-8", "surrogatepass").split())) / n, 0.12, 0.05) if long else "-")
    )


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Posterior of good per pattern, and per labeller its accuracy where it votes in (bad, good) texts.

    Votes are taken as independent given the class. Smoothing keeps each labeller better than chance in the prior, so
    that the classes can't swap.
    """
    if not patterns:
        return {}, {}
    keys = list(patterns)
    v = np.array([[{"0": 0, "1": 1, "-": 2}[c] for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    p = (good + 1.0) / (good + bad + 2.0)
    start = np.array([[8.0, 2.0, 1.0], [2.0, 8.0, 1.0]])  # (class, vote)
    for _ in range(rounds):
        share = np.stack([(1 - p) * n, p * n])
        prior = (share.sum(1) + 1) / (n.sum() + 2)
        table = np.stack([[np.bincount(v[:, k], weights=share[c], minlength=3) + start[c] for k in range(v.shape[1])] for c in (0, 1)])
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table[:, k, :][:, v[:, k]]) for k in range(v.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    hits = {name: tuple(float(table[c, k, c] / max(1e-9, table[c, k, 0] + table[c, k, 1])) for c in (0, 1)) for k, name in enumerate(LABELLERS)}
    return dict(zip(keys, p.tolist())), hits


class Shapes(Store):
    """word -> (bin of its shape, bin of the word)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if bins := self.old.get(word):
            return self.keep(word, bins, 120)
        shape = []
        for c in word:
            s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not (shape and shape[-1] == s and s in "Aa0"):
                shape.append(s)
        bins = (zlib.crc32(("s" + "".join(shape)[:12]).encode("utf-8", "surrogatepass")) % BINS, zlib.crc32(("w" + word.lower().strip(".,;:!?")).encode("utf-8", "surrogatepass")) % BINS)
        return self.keep(word, bins, 120)


_SHAPES = Shapes()


def bins_of(text: str) -> np.ndarray:
    """The hashed features of a text, with repetition: shapes, pairs of shapes, words, echoes of the word before."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    both = np.array([_SHAPES[w] for w in words], np.int64)
    shape = both[:, 0]
    pairs = (shape[:-1] * 31 + shape[1:] * 17 + 7) % BINS
    echo = np.flatnonzero(both[:-1, 1] == both[1:, 1])
    return np.concatenate([shape, pairs, both[:, 1], np.full(len(echo), 1, np.int64)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on (bins, values, soft label) by full-batch AdaGrad."""
    w, bias, total, total_bias = np.zeros(BINS), 0.0, np.full(BINS, 1e-8), 1e-8
    if not rows:
        return w, bias
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    # both classes weigh alike
    weight = np.where(y >= 0.5, 0.5 / max(1.0, (y >= 0.5).sum()), 0.5 / max(1.0, (y < 0.5).sum()))
    for _ in range(rounds):
        z = np.bincount(owner, weights=value * w[at], minlength=len(rows)) + bias
        off = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(at, weights=value * off[owner], minlength=BINS) + decay * w / BINS
        total += g * g
        total_bias += off.sum() ** 2
        w -= rate * g / np.sqrt(total)
        bias -= rate * off.sum() / np.sqrt(total_bias)
    return w, bias


def value_of(text: str, w: np.ndarray, bias: float) -> float:
    bins = bins_of(text)
    if not len(bins):
        return 0.0
    z = float(w[bins].sum()) / len(bins) ** 0.5 + bias
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


SEEN = "votes string, n long, h long, bins array<int>, times array<int>"


def look(docs: DataFrame, share: float) -> DataFrame:
    """One pass over the texts: per task the count of each vote pattern (h null), and the features of a hash sample.

    A (doc_id, text) is in the sample if its hash is among the least `share` of all 64-bit hashes, and a task hands on
    one row of it however often it repeats.
    """
    limit = scratch.hash_limit(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held: set[int] = set()
        names, kinds = ["votes", "n", "h", "bins", "times"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for b in batches:
            rows = []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = votes(t or "")
                seen[v] += 1
                if h <= limit and h not in held:
                    held.add(h)
                    rows.append((v, 1, h, *(x.astype(np.int32) for x in np.unique(bins_of(t or ""), return_counts=True))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if seen:
            none = [None] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((list(seen), list(seen.values()), none, none, none), kinds)], names=names)

    return small_batches(docs).select("text", F.xxhash64("doc_id", "text")).mapInArrow(run, SEEN)


def votes_and_sample(docs: DataFrame, sample: int = SAMPLE, rows: int | None = None) -> tuple[dict[str, int], list[tuple]]:
    """How many documents have each vote pattern (at most 3**7), and (bins, values, pattern) of at most `sample` distinct documents.

    The share of hashes is twice what `sample` needs, and the least hashes are taken. Where copies leave less
    than an eighth of `sample` distinct ones, another pass takes sixteen times the share, until the table has no more: only an empty table has
    an empty sample. `rows` is the size of the table, counted if not given.
    """
    share = min(1.0, 2 * sample / max(1, docs.count() if rows is None else rows))
    while True:
        seen = scratch.table(look(docs, share))
        found = seen.filter("h IS NOT NULL")
        least = [r["h"] for r in found.select("h").distinct().orderBy("h").limit(sample).collect()]
        if len(least) >= sample // 8 or share >= 1:
            break
        share = min(1.0, 16 * share)
    patterns = {r["votes"]: r["n"] for r in seen.filter("h IS NULL").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    got = found.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("h", "bins", "times", "votes").toPandas().sort_values("h") if least else None
    scratch.discard(seen)
    if got is None:
        return patterns, []
    both = ((np.asarray(b, np.int64), np.asarray(n, float)) for b, n in zip(got["bins"], got["times"]))
    return patterns, [(b, n / max(1.0, n.sum()) ** 0.5, p) for (b, n), p in zip(both, got["votes"])]


def train(docs: DataFrame, sample: int = SAMPLE, rows: int | None = None) -> tuple[np.ndarray, float, dict[str, tuple[float, float]]]:
    """Weights, bias and the labellers' accuracies."""
    patterns, chosen = votes_and_sample(docs, sample, rows)
    posterior, hits = estimate(patterns)
    w, bias = fit([(b, v, posterior[p]) for b, v, p in chosen if len(b)])
    return w, bias, hits


def scored(docs: DataFrame, into: str, sample: int = SAMPLE) -> DataFrame:
    """docs with the score in column `into`. A narrow map; the weights go along as 256 KB."""
    w, bias, _ = train(docs, sample)
    out = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    where, arrow = docs.columns.index("text"), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([value_of(t or "", w, bias) for t in b.column(where).to_pylist()], pa.float64())], names=arrow.names)

    return small_batches(docs).mapInArrow(run, out)


def score_table(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and the verdict, one row per document."""
    d = scored(docs.select("doc_id", "text"), "score", sample)
    return d.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))


def apply_classifier(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with all their columns."""
    score = fresh(docs, "score")
    return scored(docs, score, sample).filter(F.col(score) >= threshold).drop(score)
