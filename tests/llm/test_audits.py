"""Filter interaction and source divergence audits: the contract worked by brute force on odd tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quarry.llm import filter_audit, scratch, source_divergence, vectors
from tests.llm.test_operators import DOCS, clashing, odd_table

LABELS = "doc_id long, quality int, toxic int"


def brute_filters(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and least[text] < i]
        fails.append((source or "", {c for c, x in zip("ABCDE", bad) if x}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order):
                before = set(order[:step])
                gone = [(g, t) for x, g, t in own if c in x and not x & before]
                out[part, order, step + 1] = [sum(not x & (before | {c}) for x, *_ in own), len(gone), sum(c in x and bool(x & before) for x, *_ in own), sum(x == {c} for x, *_ in own), sum(g for g, _ in gone), sum(t for _, t in gone)]
                shapley[c] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got_filters(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filters_on_odd_rows(spark):
    odd = odd_table(spark)
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    want = brute_filters([tuple(r) for r in odd.collect()], labels)
    said = spark.createDataFrame(labels, LABELS)
    assert got_filters(odd, said) == want
    assert got_filters(clashing(odd), clashing(said)) == want
    assert filter_audit.audit(odd.limit(0), said).count() == 0
    assert got_filters(odd, said.limit(0)) == brute_filters([tuple(r) for r in odd.collect()], [])


def test_copies_over_many_tasks(spark):
    """One text in most rows, with ids that are null or repeat, over many more tasks than texts."""
    copy = "Same text " * 30
    rows = [(None if i % 50 == 0 else i // 2, copy if i % 3 else f"other {i % 7}", "en", f"s{i % 4}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        ranged = docs.repartitionByRange("text", "doc_id")
        assert ranged.rdd.getNumPartitions() > 10
        assert got_filters(docs, spark.createDataFrame([], LABELS)) == brute_filters(rows, [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_counters_of_parts_of_a_table_add_up(spark, sf):
    """Filters A to D don't look beyond a document, so their counters over two halves are those of the whole."""
    docs, labels = scratch.read(spark, sf, "documents"), scratch.read(spark, sf, "labels")
    bits = filter_audit.COPY - 1

    def count(d):
        out = Counter()
        for r in filter_audit.counters(filter_audit.masks(d), labels).collect():
            for c in ("n", "good", "toxic"):
                out[r["part"], r["mask"] & bits, c] += r[c]
        return out

    assert count(docs.filter("doc_id % 2 = 0")) + count(docs.filter("doc_id % 2 = 1")) == +count(docs)


# ---------------------------------------------------------------- 13
def brute_divergence(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    df, n, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        df[lang].update(set(found))
        n[lang, source].update(found)
        whole[lang].update(found)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(n[lang, s]) for l, s, _ in docs if l == lang}
        q = share(whole[lang])
        for s in p:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def got_divergence(docs, **how):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in source_divergence.audit(docs, **how).collect())


def odd_words(spark):
    rows = [tuple(r) for r in odd_table(spark).collect()]
    rows += [(i, f"the The straße {'Ünder' * (i % 3)} a{i % 4}b été x_y {i % 5 * 'zeta '}\x00\x7f", ["en", "fr", None][i % 3], [None, "a", "b", "c"][i % 4], 1) for i in range(60)]
    rows += [(100, "12 34 --", "en", "numbers", 1), (101, "", "none", "x", 1), (102, None, "none", "y", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def test_divergence_on_odd_rows(spark):
    docs, rows = odd_words(spark)
    want = brute_divergence(rows)
    assert got_divergence(docs) == want and any(r[2] == "term" for r in want)
    assert ("none", "x", "pair", "y", 0, 1) in want
    assert got_divergence(clashing(docs)) == want
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_a_crowded_sketch_changes_nothing(spark, monkeypatch):
    """Sixteen cells for all terms, and counts handed on after every few texts."""
    docs, rows = odd_words(spark)
    monkeypatch.setattr(source_divergence, "HELD", 1)
    assert got_divergence(docs, bits=4) == brute_divergence(rows)


def test_sketch_never_underestimates_and_rules_most_terms_out(spark, sf):
    docs = scratch.read(spark, sf, "documents").select("lang", "source", "text")
    bits = 16
    sketch = source_divergence.sketched(docs, bits)
    df = defaultdict(Counter)
    for r in docs.collect():
        df[r["lang"]].update(set(source_divergence.terms(r["text"].encode())))
    rare = passed = 0
    for lang, c in df.items():
        names = list(c)
        least = sketch[source_divergence.cells(lang, names, bits)].min(axis=0)
        assert all(x >= min(255, c[t]) for x, t in zip(least, names))
        rare += sum(c[t] < 3 for t in names)
        passed += sum(c[t] < 3 and x >= 3 for x, t in zip(least, names))
    assert rare > 1000 and passed < 0.05 * rare


@pytest.mark.parametrize("n", [0, 1, 8_999_999_999, 9_000_000_000, 10**15])
def test_shares_are_exact_for_any_count(spark, n):
    row = spark.createDataFrame([(n, n + 12_345)], "n long, whole long")
    got = row.select(source_divergence._share(row["n"], row["whole"])).collect()[0][0]
    assert got == 1 + 10**9 * (n + 1) // (n + 12_345)


def test_vectors_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 3)
    monkeypatch.setattr(vectors, "PIECE", 64)

    def run(batches):
        for _ in batches:
            pass
        yield from vectors.pieces(np.arange(100, dtype=np.int64))

    rows = spark.range(0, 40, 1, 20).mapInArrow(run, vectors.SCHEMA)
    assert vectors.total(rows, 20, 100, "int64", 1 << 62).tolist() == [20 * i for i in range(100)]
    rows = spark.range(0, 40, 1, 20).mapInArrow(run, vectors.SCHEMA)
    assert vectors.total(rows, 20, 100, "int64", 255).tolist() == [min(255, 20 * i) for i in range(100)]
