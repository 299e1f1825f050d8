"""Hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking
from quarry.functions import text as T
from quarry.operators import aggregate as A
from quarry.operators import dense as D
from quarry.operators import metrics as M
from quarry.operators import neighbours as N
from quarry.operators import patches as P
from quarry.operators import retrieval as R
from quarry.operators import stats as S
from quarry.operators import validate as V
from quarry.streaming import ledger as L
from quarry.streaming.store import scratch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def test_ndcg_of_a_worked_ranking(spark):
    qrels = spark.createDataFrame([("t", "A", 3), ("t", "B", 0), ("t", "C", 2), ("t", "D", 1)], "topic_id string, chunk_id string, grade int")
    runs = spark.createDataFrame([("c", "t", "t::q", d, i + 1, 1.0) for i, d in enumerate("ABC")], "config string, topic_id string, qkey string, chunk_id string, rnk int, score double")
    m = M.query_metrics(runs, qrels).collect()[0]
    assert math.isclose(m["ndcg10_exp"], 0.9049495058460971, rel_tol=1e-12)
    assert m["p10_bin2"] == 0.2 and m["recall10_bin2"] == 1.0
    dcg = M.graded(runs, qrels).groupBy("qkey").agg(M.dcg(10).alias("d")).collect()[0]["d"]
    assert math.isclose(dcg, 8.5)


def test_metrics_without_relevant_units_are_null(spark):
    qrels = spark.createDataFrame([("t", "A", 0)], "topic_id string, chunk_id string, grade int")
    runs = spark.createDataFrame([("c", "t", "t::q", "A", 1, 1.0)], "config string, topic_id string, qkey string, chunk_id string, rnk int, score double")
    m = M.query_metrics(runs, qrels).collect()[0]
    assert m["ndcg10_exp"] is None and m["recall10_bin2"] is None and m["p10_bin2"] == 0.0


def test_rrf_order(spark):
    rows = [("q", "dense", 0, i, x) for i, x in enumerate("ABC")] + [("q", "sparse", 1, i, x) for i, x in enumerate("CAD")]
    got = R.rrf(spark.createDataFrame(rows, "q string, source string, source_no int, pos int, id string"), ["q"]).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["A", "C", "B", "D"]
    assert math.isclose(got[0]["score"], 1 / 61 + 1 / 62)


def test_rrf_repeats_close_up(spark):
    rows = [("q", "a", 0, 0, "x"), ("q", "a", 0, 1, "x"), ("q", "a", 0, 2, "y")]
    got = R.rrf(spark.createDataFrame(rows, "q string, source string, source_no int, pos int, id string"), ["q"]).orderBy("rank").collect()
    assert math.isclose(got[1]["score"], 1 / 62)


def test_paired_t(spark):
    d = spark.createDataFrame([("c", f"q{i}", "t", float(x)) for i, x in enumerate([-1, -2, -2, 0, 0])], "c string, qkey string, topic_id string, delta double")
    r = S.t_statistics(d, ["c"]).collect()[0]
    assert math.isclose(r["t"], -math.sqrt(5)) and r["df"] == 4 and math.isclose(r["p"], 0.089009342500086, rel_tol=1e-9)


def test_no_spread_gives_p_one(spark):
    d = spark.createDataFrame([("c", f"q{i}", "t", 0.5) for i in range(4)], "c string, qkey string, topic_id string, delta double")
    r = S.t_statistics(d, ["c"]).collect()[0]
    assert (r["t"], r["p"], r["d_z"]) == (0.0, 1.0, None)


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([("c", f"q{i}", "t", float(i)) for i in range(20)], "c string, qkey string, topic_id string, delta double")
    a, b = (S.bootstrap(d.repartition(n), ["c"], resamples=500).collect() for n in (1, 5))
    assert a == b and a[0]["low"] < 9.5 < a[0]["high"]


def test_support_worked_example(spark):
    rows = [("r", 0, "FS"), ("r", 1, "PS"), ("r", 2, None)]
    r = A.support_rates(spark.createDataFrame(rows, "run string, sentence int, label string"), ["run"]).collect()[0]
    assert r["precision"] == 0.75 and r["recall"] == 0.5


@pytest.mark.parametrize("rule, want", [("floor", 3), ("ceil", 2), ("lower", 2)])
def test_percentile_rules(spark, rule, want):
    d = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert A.percentiles(d, ["g"], "v", [0.5], rule).collect()[0]["value"] == want


def test_chunk_band_packs_and_folds():
    paras = ["w " * 150, "w " * 150, "w " * 200, "w " * 30]
    chunks = chunking.band("\n\n".join(p.strip() for p in paras))
    assert [chunking.count(c) for c in chunks] == [300, 230]


def test_cut_long_prefers_line_then_sentence():
    assert list(chunking.cut_long("a b\nc d e f", 3)) == ["a b", "c d e", "f"]
    assert list(chunking.cut_long("a. b c d", 3)) == ["a.", "b c d"]


def test_fixed_overlaps():
    text = " ".join(map(str, range(20)))
    got = chunking.fixed(text, size=13, overlap=3, rate=1.3)
    assert got[0].split()[0] == "0" and got[1].split()[0] == "8" and got[-1].split()[-1] == "19"


def test_locate_falls_back():
    assert chunking.locate("aa  Bb cc", "bb cc") == 4
    assert chunking.locate("aa bb", "zz") == 0


def test_quality_score_of_plain_text(spark):
    assert one(spark, T.quality_score(T.quality_rates(F.lit("plain words only here")))) == 0.15


def test_grade_parse_takes_the_last(spark):
    assert one(spark, T.parse_grade(F.lit("##final score: 1 ... ##final score: 3"))) == 3
    assert one(spark, T.parse_grade(F.lit("none"))) is None


def test_packets_prefer_what_is_cited(spark):
    from quarry.operators.evidence import packets

    said = [" ".join(f"{w}{i}" for w in ("Alpha", "beta", "gamma", "delta", "words", "that", "make", "one", "span", "of", "text", "here")) + "." for i in range(7)]
    claims = spark.createDataFrame([(1, 1, "alpha0 beta0 gamma0 delta0", ["p2"])], "g int, finding int, claim string, cited array<string>")
    docs = spark.createDataFrame([(1, "p1", "P", "\n\n".join(said[1:])), (1, "p2", "P", "\n\n".join(said[1:])), (1, "q", "Q", said[0]), (1, "r", "R", said[6])], "g int, doc string, parent string, text string")
    got = packets(claims, docs, ["g"]).orderBy("doc_rank", "span_rank").collect()
    assert [r["doc"] for r in got if r["span_rank"] == 1] == ["p2", "p1", "q"] and [r["bonus"] for r in got if r["span_rank"] == 1] == [1.0, 0.8, 0.0]
    assert max(r["span_rank"] for r in got if r["doc"] == "p2") == 5
    short = packets(claims, docs, ["g"], excerpt=10, budget=35).collect()
    assert len(short) == 3 and all(len(r["span"]) == 10 for r in short)


def test_fixed_windows_keep_the_white_space(spark):
    import random
    import re

    rng = random.Random(6)
    texts = ["", " \n", "one", "  a  b\n\nc "] + ["".join(rng.choice(["a", "bb", "é"]) + rng.choice([" ", "\n", "  \t"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    for size, step in ((10, 3), (5, 5), (3, 7), (12, 4), (1, 1)):
        got = {r["i"]: r["c"] for r in d.select("i", T.chunk_fixed(F.col("t"), size, step).alias("c")).collect()}
        for i, t in enumerate(texts):
            parts = re.findall(r"\S+\s*", t)
            last = -(-max(0, len(parts) - size) // step)
            assert got[i] == [re.sub(r"\s+$", "", "".join(parts[k * step : k * step + size])) for k in range(last + 1)] * bool(parts)
        assert got[-1] == []


def test_gcl_covers():
    at = {"a": [0, 10], "b": [3, 11], "c": [4]}
    assert R.covers(R.parse_gcl("(^ a b)"), at) == [(0, 3), (3, 10), (10, 11)]
    assert R.covers(R.parse_gcl('"b c"'), at) == [(3, 4)]
    assert R.covers(R.parse_gcl("(<< (^ a b) (# 2))"), at) == [(10, 11)]
    assert R.covers(R.parse_gcl("(>> (^ a b) c)"), at) == [(3, 10)]
    assert R.covers(R.parse_gcl("(^ a missing)"), at) == []


def test_lucene_clauses():
    assert R.parse_lucene('+a -b "c d"~2 e*') == [("+", ("term", "a")), ("-", ("term", "b")), ("", ("within", ("and", ("term", "c"), ("term", "d")), ("window", 4))), ("", ("prefix", "e"))]


def test_lucene_groups_nest():
    got = R.parse_lucene('+(a OR (+b -"c d")) AND !(e f) g^2 ) "h')
    assert got == [("+", ("or", ("term", "a"), ("or", ("clauses", ("+", ("term", "b")), ("-", ("phrase", "c", "d")))))), ("-", ("or", ("term", "e"), ("term", "f"))), ("", ("term", "g")), ("", ("term", "h"))]


def test_lucene_search_agrees_with_positions(spark):
    """Queries of all kinds against evaluation of every document's positions."""
    import random

    rng = random.Random(4)
    docs = {str(i): " ".join(rng.choices("ab ac b c d e".split(), k=rng.randint(0, 9))) for i in range(120)}
    d = spark.createDataFrame(list(docs.items()), "docid string, contents string")
    queries = ["+b -c", '"b c" d', '+(b (+c -d)) -"e b"', "a* AND NOT b", '"b d"~2', "-b", '-"b c" +d', "(b AND (c OR -d))", '+b -(c AND "d e")', ""]
    got = {}
    for r in R.lucene_search(d, {str(n): q for n, q in enumerate(queries)}, k=None).collect():
        got.setdefault(int(r["qid"]), set()).add(r["docid"])
    for n, q in enumerate(queries):
        node = ("clauses", *R.parse_lucene(q))
        want = {i for i, t in docs.items() if R.holds(node, {w: [k for k, x in enumerate(t.split()) if x == w] for w in t.split()})}
        assert got.get(n, set()) == want, q


def test_no_match_is_cut_off(spark):
    """Without k every match is returned, as many as there are."""
    d = spark.range(25_000).select(F.col("id").cast("string").alias("docid"), F.lit("of the").alias("contents"))
    index = R.build_index(d)
    assert R.boolean_search(index, {"q": '"of the"'}, k=None).count() == 25_000
    assert R.lucene_search(index, {"q": "+the of"}, k=None).count() == 25_000


def test_boolean_search_needs_all(spark):
    docs = spark.createDataFrame([("1", "red green blue"), ("2", "red x x x blue"), ("3", "green"), ("4", None)], "docid string, contents string")
    got = R.boolean_search(docs, {"q": "(^ red blue)"}).orderBy("rank").collect()
    assert [(r["docid"], r["width"]) for r in got] == [("1", 3), ("2", 5)]
    got = R.lucene_search(docs, {"q": "+red -green"}).collect()
    assert [r["docid"] for r in got] == ["2"]


def test_dense_and_approximate_search_agree(spark, sf):
    from quarry.fixtures import Views
    from quarry.plans.retrieval import vectors

    q, d = vectors(Views(spark, sf))
    exact = {(r["query_id"], r["id"]) for r in D.top_k(q, d, 10).collect()}
    path = scratch(spark, "codes")
    D.write_codes(d, path)
    near = {(r["query_id"], r["id"]) for r in D.quantised_top_k(q, d, path, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.95


@pytest.mark.parametrize("block", [7, 2048])
def test_blocks_of_a_group_meet_once(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((30, 4)), [1] * 29 + [9], axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("g" if i % 5 else None, i % 3, i, list(map(float, v))) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "g string, arm int, vec_id long, embedding array<double>")
    twins = N.nearest(d, ["g"], block=block, at_least=0.9).groupBy("g").agg(F.avg(F.col("nearest").isNotNull().cast("double")).alias("near")).collect()
    for r in D.mean_cosine(d, ["g"]).collect():
        mine = x[[i for i, row in enumerate(rows) if row[0] == r["g"]]]
        s = mine @ mine.T
        pairs = s[np.triu_indices(len(mine), 1)]
        assert r["pairs"] == len(pairs) and math.isclose(r["mean"], pairs.mean(), abs_tol=1e-9)
        np.fill_diagonal(s, -1)
        assert math.isclose(next(t["near"] for t in twins if t["g"] == r["g"]), (s.max(1) >= 0.9).mean(), abs_tol=1e-9)
    got = N.nearest(d, ["g"], "arm", block).collect()
    assert len(got) == len(rows)
    for r in got:
        want = max(float(x[r["vec_id"]] @ x[i]) for g, a, i, _ in rows if g == r["g"] and a != r["arm"])
        assert math.isclose(r["nearest"], want, abs_tol=1e-9)


def test_truncated_zero_vector_stays(spark):
    d = spark.createDataFrame([([0.0, 0.0, 1.0],)], "v array<float>").select(D.truncate(F.col("v"), 2).alias("x"))
    assert d.collect()[0]["x"] == [0.0, 0.0]


def test_vendi_of_equal_vectors_is_one(spark):
    d = spark.createDataFrame([("g", [1.0, 0.0])] * 5, "g string, embedding array<float>")
    assert math.isclose(D.vendi(d, ["g"]).collect()[0]["vendi"], 1.0, rel_tol=1e-9)


def test_ledger_rules():
    ledger = L.Ledger(most=2)
    list(ledger.stage(0, ["a", "b", "a", "c", "d"]))
    got = list(ledger.commit(1, ["a", "b", "c"]))
    assert got == [(1, "a", "committed", ""), (1, "a", "duplicate", L.PARALLEL), (1, "b", "committed", ""), (1, "c", "rejected", L.OVERFLOW), (1, "d", "rejected", L.UNSELECTED)]
    list(ledger.stage(2, ["a", "e"]))
    assert list(ledger.commit(3, ["zz"])) == [(3, "zz", "error", "not staged")]
    assert list(ledger.commit(3, ["a", "e"])) == [(3, "a", "duplicate", L.LATER), (3, "e", "committed", "")]
    assert list(ledger.release(4, ["a"])) == [(4, "a", "released", "kept since 1")]
    assert list(ledger.release(5, ["a"])) == [(5, "a", "error", "not committed")]
    list(ledger.stage(6, ["f"]))
    assert list(ledger.expire(7)) == [(7, "f", "rejected", "expired")]


def test_ledger_stream_agrees_with_batch(spark, sf, tmp_path):
    from quarry.fixtures import Views
    from quarry.plans.streams import ledger_events

    events = ledger_events(Views(spark, sf))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = L.replay_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, L.replay(events).collect()))


def test_patches_are_refused_for_cause():
    lines = ["the quick brown fox jumps", "second line"]
    done, out = P.patch_lines(lines, [("replace", 0, "x y z w v u t s r q p o", True), ("replace", 0, "the fox", True), ("insert", 1, "new", False), ("replace", 0, "the quick brown fox sleeps", True), ("delete", 9, "", True)])
    assert out == ["drops the claim", "too short", "unauthorised", "applied", "no such line"]
    assert done == ["the quick brown fox sleeps", "second line"]


def test_word_cap_rolls_back():
    done, out = P.patch_lines(["a b"], [("insert", 0, "c d e", True)], cap=4)
    assert out == ["over the word cap"] and done == ["a b"]


def test_run_reader_keeps_the_first_of_repeats(spark, tmp_path):
    from quarry.sources import trec

    (tmp_path / "k1_0.9__b_0.4.txt").write_text("q Q0 a 2 1.0 t\nq Q0 b 1 2.0 t\nq Q0 a 3 0.5 t\n")
    got = trec.load_run_folder(spark, str(tmp_path)).orderBy("rnk").collect()
    assert [(r["config"], r["chunk_id"], r["rnk"], r["score"]) for r in got] == [("k1_0.9__b_0.4", "b", 1, 2.0), ("k1_0.9__b_0.4", "a", 2, 1.0)]


def test_short_run_line_is_an_error(spark, tmp_path):
    from quarry.sources import trec

    (tmp_path / "x.txt").write_text("q Q0 a 2\n")
    with pytest.raises(Exception, match="not a run line"):
        trec.load_run_folder(spark, str(tmp_path)).collect()


def test_grades_outside_the_scale_are_errors(spark, tmp_path):
    from quarry.sources import trec

    (tmp_path / "q").write_text("t 0 a 7\n")
    with pytest.raises(Exception, match="grade"):
        trec.parse_qrels(spark.read.text(str(tmp_path / "q"))).collect()


def test_log_tolerates_one_torn_tail_only(spark, tmp_path):
    from quarry.sources import trec

    (tmp_path / "s1").write_text('{"a": 1}\n{"a": 2}\n{"a"')
    assert sorted(r["a"] for r in trec.read_log(spark, str(tmp_path), "a INT").collect()) == [1, 2]
    (tmp_path / "s2").write_text('{"a": 1}\n{"a"\n{"a": 3}')
    with pytest.raises(Exception, match="damaged record"):
        trec.read_log(spark, str(tmp_path), "a INT").collect()


def test_waivers(spark):
    assert one(spark, V.waiver(F.lit("Between 1,500 and 3,000 words"))) == "words"
    assert one(spark, V.waiver(F.lit("Between 500 and 3,000 words"))) is None


def test_rubric_half_up(spark):
    assert one(spark, F.round(F.lit(1 / 32), 4)) == 0.0313
