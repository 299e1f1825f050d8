"""Segmented logs: resumes in mid-segment, torn tails, damaged lines."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.streaming import pipes
from quarry.streaming import segments as SG

SCHEMA = "id long, text string"


def lines(a, b):
    return "".join(json.dumps({"id": i, "text": "é" * (i % 5)}) + "\n" for i in range(a, b)).encode()


@pytest.mark.parametrize("size", [SG.RANGE, 64])
def test_a_log_is_resumed_in_mid_segment(spark, tmp_path, size):
    path, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")

    def ids():
        pipes.drain(SG.follow(spark, path, SCHEMA, size), out, cp)
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    tail = lines(10, 11)
    SG.append(path, "s1", lines(0, 10) + tail[:9])
    assert ids() == list(range(10))  # the line that is being written waits
    SG.append(path, "s1", tail[9:] + lines(11, 20))
    assert ids() == list(range(20))
    assert ids() == list(range(20))
    SG.append(path, "s1", b'{"id": 99, "te')
    SG.append(path, "s2", lines(20, 25))
    assert ids() == list(range(25))  # torn, and its segment is closed
    SG.append(path, "s3", lines(25, 26)[:-1])
    SG.append(path, "s4", lines(26, 27))
    assert ids() == list(range(27))  # whole but for its end


def test_a_damaged_line_is_an_error(spark, tmp_path):
    path = str(tmp_path / "log")
    SG.append(path, "s1", lines(0, 3) + b'{"id"\n' + lines(3, 4))
    with pytest.raises(Exception, match="damaged record: s1, line 4"):
        pipes.drain(SG.follow(spark, path, SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))


def test_a_meter_goes_on_where_it_was(spark, tmp_path):
    path, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    state = lambda: SG.follow(spark, path, SCHEMA).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    for a, b in ((0, 7), (7, 30)):
        SG.append(path, "s1", lines(a, b))
        got = SG.metered(spark, state(), out, cp).collect()[0]
        assert (got["n"], got["total"]) == (b, sum(range(b)))
    got = SG.metered(spark, state(), out, cp).collect()[0]  # nothing new
    assert (got["n"], got["total"]) == (30, sum(range(30)))


def test_obligations_by_hand(spark):
    from quarry.operators.aggregate import obligations

    rows = [
        (1, 0, 0, "Report annual budget figures every region more", [" B ", "a"], "x"),
        (1, 1, 1, "REPORT the annual BUDGET figures for every region more than once", ["A", "b"], "y"),  # the same first words, the same mentions
        (1, 1, 0, "report the annual budget figures for every region here", ["c"], "z"),
        (1, 0, 7, "   ", ["c"], "blank"),
    ] + [(2, 0, 100_000 + i, f"requirement number {i:05}", [], "n") for i in range(20)] + [(2, 0, 5, "requirement comes first", [], "first")]
    d = spark.createDataFrame(rows, "grp int, audit int, pos long, requirement string, mentions array<string>, note string")
    got = obligations(d, ["grp"], "audit", "pos").orderBy("grp", "place").collect()
    assert [(r["note"], r["mentions"]) for r in got if r["grp"] == 1] == [("x", ["a", "b"]), ("z", ["c"])]
    two = [r for r in got if r["grp"] == 2]
    assert len(two) == 14 and two[0]["note"] == "first" and two[1]["pos"] == 100_000
