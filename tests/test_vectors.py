"""Exact neighbours by pivots, diversity by hand, and graphs against exact search."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators import graph as G
from quarry.operators import neighbours as N
from quarry.streaming.store import scratch

VECS = "g string, arm int, vec_id long, embedding array<double>"


def clustered(n, d, clusters, noise, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, d))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, groups=2, arms=3):
    return spark.createDataFrame([(f"g{i % groups}", i % arms, i, v.tolist()) for i, v in enumerate(x)], VECS)


@pytest.mark.parametrize("block,at_least", [(20, None), (2048, None), (20, 0.9)])
def test_nearest_elsewhere_is_exact(spark, block, at_least):
    x = np.concatenate([clustered(180, 6, 6, 0.1), np.repeat(clustered(2, 6, 2, 0.1, 1), 12, axis=0), -np.eye(6)[:2]])
    got = N.nearest(frame(spark, x), ["g"], "arm", block, at_least).collect()
    assert len(got) == len(x)
    for r in got:
        i = r["vec_id"]
        others = [j for j in range(len(x)) if j % 2 == i % 2 and j % 3 != i % 3]
        want = max(float(x[i] @ x[j]) for j in others)
        if at_least is not None and want < at_least:
            assert r["nearest"] is None
        else:
            assert math.isclose(r["nearest"], want, abs_tol=1e-9)


def test_blocks_that_cannot_help_do_not_meet(spark):
    share = {}
    for name, x in (("clustered", clustered(1500, 8, 12, 0.02)), ("scattered", clustered(1500, 8, 1500, 0.5))):
        rows, pivots = N.placed(N._kept(N.representatives(frame(spark, x, groups=1), ["g"], None), "reps"), block=60)
        _, pairs = N.to_meet(rows, pivots)
        share[name] = pairs.filter("a <> b").agg(F.avg(F.col("meets").cast("double"))).collect()[0][0]
    assert share["clustered"] < 0.3 and share["clustered"] < 0.6 * share["scattered"], share


def test_vectors_without_direction(spark):
    rows = [("a", 0, 1, [0.0, 0.0]), ("a", 1, 2, [1.0, 0.0]), ("a", 0, 3, [1.0, 1.0]), ("a", 0, 4, None), ("b", 0, 5, [1.0, 0.0])]
    got = {r["vec_id"]: r["nearest"] for r in N.nearest(spark.createDataFrame(rows, VECS), ["g"], "arm").collect()}
    assert got[1] is None and got[4] is None and got[5] is None
    assert math.isclose(got[2], 0.5**0.5) and math.isclose(got[3], 0.5**0.5)


def test_many_copies_are_one(spark):
    rows = [("a", i % 2, i, [1.0, 0.0]) for i in range(3000)] + [("a", 0, 9000, [0.0, 1.0]), ("a", 0, 9001, [0.0, 1.0])]
    d = spark.createDataFrame(rows, VECS)
    assert N.representatives(d, ["g"], "arm").count() == 2
    got = {r["vec_id"]: r["nearest"] for r in N.nearest(d, ["g"], "arm", block=16).collect()}
    assert len(got) == 3002 and got[0] == got[1] == 1.0 and abs(got[9000]) < 1e-12


def test_diversity_of_five_vectors_by_hand(spark):
    """Two equal vectors, one close to them, two at right angles: three have a twin."""
    c, s = 0.95, math.sqrt(1 - 0.95**2)
    x = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [c, s, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]]
    d = spark.createDataFrame([("g", 0 if i < 2 else 1, i, v) for i, v in enumerate(x)] + [("lone", 0, 9, x[0])], VECS)
    mean = {r["g"]: r for r in D.mean_cosine(d, ["g"]).collect()}
    assert mean["g"]["pairs"] == 10 and math.isclose(mean["g"]["mean"], (1 + 2 * c + s) / 10, abs_tol=1e-12)
    assert mean["lone"]["pairs"] == 0 and mean["lone"]["mean"] is None
    twins = {r["vec_id"]: r["nearest"] for r in N.nearest(d, ["g"], at_least=0.9).collect()}
    assert [k for k, v in sorted(twins.items()) if v is not None] == [0, 1, 2]
    alone = {r["vec_id"]: r["nearest"] for r in N.nearest(d, ["g"], "arm", at_least=0.9).collect()}
    assert [k for k, v in sorted(alone.items()) if v is None] == [3, 4, 9]  # the last has no other arm


def test_vendi_gain_by_hand(spark):
    """Arm 0: one direction twice, 1 effective vector. Arm 1: two at right angles, 2. Together 4 vectors, half of them the first's."""
    rows = [("g", 0, 0, [1.0, 0.0, 0.0]), ("g", 0, 1, [1.0, 0.0, 0.0]), ("g", 1, 2, [0.0, 1.0, 0.0]), ("g", 1, 3, [0.0, 0.0, 1.0])]
    got = {r["arm"]: r for r in D.vendi_gain(spark.createDataFrame(rows, VECS), ["g"], "arm").collect()}
    together = math.exp(-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)))
    for arm, own in ((0, 1.0), (1, 2.0)):
        assert got[arm]["n"] == 2 and math.isclose(got[arm]["vendi"], own) and math.isclose(got[arm]["together"], together) and math.isclose(got[arm]["gain"], together - own)


def test_union_of_arms_is_what_one_group_scores(spark):
    x = clustered(90, 5, 4, 0.3)
    d = frame(spark, x)
    whole = {r["g"]: r["vendi"] for r in D.vendi(d, ["g"]).collect()}
    for r in D.vendi_gain(d, ["g"], "arm").collect():
        assert math.isclose(r["together"], whole[r["g"]], rel_tol=1e-9)


# ---------------------------------------------------------------- graphs
def test_graph_search_finds_what_exact_search_finds(spark):
    """Clustered vectors in two graphs: recall at 10 of 0.9 or more at under a tenth of the distances."""
    x = clustered(9000, 24, 60, 0.1).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(4)
    q = d.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    path = scratch(spark, "graphs")
    G.write_graphs(d, path, shard=5000, degree=32)
    nodes = spark.read.parquet(f"{path}/nodes")
    assert nodes.count() == 9000 and nodes.select("shard").distinct().count() == 2
    exact = {(r["query_id"], r["id"]) for r in D.top_k(q, d, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in G.search(q, d, path, 10, beam=32).collect()}
    asked = G.walked(q, d, path, 32).agg(F.sum("asked")).collect()[0][0] + 64 * 90
    share = asked / (90 * 9000)
    assert len(exact & found) >= 0.9 * len(exact) and share < 0.1, (len(exact & found) / len(exact), share)


def test_graph_search_on_the_given_vectors(spark, sf):
    from quarry.fixtures import Views
    from quarry.plans.retrieval import r08_graph, vectors

    v = Views(spark, sf)
    q, d = vectors(v)
    exact = {(r["query_id"], r["id"]) for r in D.top_k(q, d, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in r08_graph(v).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_graphs_of_odd_tables(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, vec array<float>")
    path = scratch(spark, "graphs")
    G.write_graphs(d, path)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vec array<float>")
    got = G.search(q, d, path, 5).orderBy("rank").collect()
    assert [r["score"] for r in got] == [2.0] * 5 and [r["id"] for r in got] == [2, 5, 8, 11, 14]
    assert G.search(q.limit(0), d, path, 5).count() == 0
    empty = scratch(spark, "graphs")
    G.write_graphs(d.limit(0), empty)
    assert G.search(q, d.limit(0), empty, 5).count() == 0


def test_pruning_keeps_the_nearest_and_drops_the_shadowed():
    x = np.array([[0.0], [1.0], [1.1], [-1.0]], np.float32)
    assert G.prune(x, 0, np.array([1, 2, 3, 0, -1]), 4, 1.44).tolist() == [1, 3]
    assert G.prune(x, 0, np.array([1, 2, 3]), 1, 1.44).tolist() == [1]


def test_an_index_of_codes_finds_what_exact_search_finds(spark):
    """Vectors nearer to each other than their codes tell, and many copies of one: the same rows as exact search, ties by id."""
    rng = np.random.default_rng(1)
    x = (1.0 + 1e-4 * rng.standard_normal((3000, 8))).astype(np.float32)
    x[500:900] = x[np.argmax(x.sum(1))]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(4)
    q = d.filter("id % 300 = 0").withColumnRenamed("id", "query_id")
    path = scratch(spark, "codes")
    D.write_codes(d, path)
    want = {}
    for i in range(0, 3000, 300):
        s = np.zeros(3000)
        for e in range(8):
            s += x[i, e].astype(np.float64) * x[:, e]
        want[i] = [int(j) for j in np.lexsort((np.arange(3000), -s))[:10]]
    for found in (D.quantised_top_k(q, d, path, 10), D.top_k(q, d, 10)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def peak(spark):
    def run(batches):
        import resource

        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    return max(r["mb"] for r in spark.range(0, 8, 1, 4).mapInArrow(run, "mb long").collect())


def test_many_queries_take_no_more_memory(spark):
    before = peak(spark)
    d = spark.range(0, 10_000, 1, 4).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k)).alias("vec"))
    d = d.coalesce(1)
    got = D.top_k(d.withColumnRenamed("id", "query_id"), d.limit(9000), 2)
    assert got.count() == 20_000
    assert peak(spark) < max(before + 100, 600)
