"""Nearest vectors of a group, exactly, without meeting of blocks that can't hold a nearer one.

Equal vectors stand as one. A group's vectors are dealt to its pivots by the least angle, and each pivot's to rings of about `block` vectors by that angle. The angle
between two blocks' vectors is at least what the triangle inequality leaves of the pivots' angle and the rings' bounds; two blocks meet only if that angle
is small enough to better some vector of either, which is known after each block has met itself. A task holds two blocks, however large the group.

Vectors are compared by cosine. A vector without direction (zero or null) has no nearest and is no one's nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.dense import normalise
from quarry.streaming.store import scratch

#: Vectors of a block, pivots of a group, and steps of a pivot's angles that rings are made of.
BLOCK, PIVOTS, STEPS = 2_048, 64, 64
#: Angles are held against bounds with so much to spare for rounding.
SPARE = 1e-9


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(reps: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """reps (_g, id, unit, ...) with pivot, angle and _b, the number of their block; and (_g, pivots) with the pivots' vectors."""
    sizes = reps.groupBy("_g").agg(F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("most"))
    order = F.row_number().over(W.partitionBy("_g").orderBy(F.xxhash64("id"), "id"))
    chosen = reps.select("_g", "unit", order.alias("r")).filter(F.col("r") <= PIVOTS).join(sizes, "_g").filter("r <= most")
    pivots = _kept(chosen.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "unit"))), lambda s: s["unit"]).alias("pivots")), "pivots")
    near = F.array_max(F.transform("pivots", lambda p, i: F.struct(_dot(p, F.col("unit")).alias("cosine"), (-i).alias("pivot"))))
    cells = reps.join(pivots, "_g").withColumn("_near", near).drop("pivots")
    cells = _kept(cells.select("*", (-F.col("_near.pivot")).alias("pivot"), _angle(F.col("_near.cosine")).alias("angle")).drop("_near"), "cells")
    cuts = cells.groupBy("_g", "pivot").agg(F.count(F.lit(1)).alias("_c"), F.percentile_approx("angle", F.array(*(F.lit(k / STEPS) for k in range(1, STEPS))), F.lit(1_000)).alias("_cuts"))
    rings, parts = F.least(F.lit(STEPS), F.ceil(F.col("_c") / block)), F.ceil(F.col("_c") / (STEPS * block))
    ring = F.floor(F.size(F.filter("_cuts", lambda x: x < F.col("angle"))) * rings / STEPS)
    number = F.shiftleft(F.col("pivot").cast("long"), 48) + F.shiftleft(ring, 40) + F.pmod(F.xxhash64("id"), parts)
    return _kept(cells.join(cuts, ["_g", "pivot"]).withColumn("_b", number).drop("_c", "_cuts"), "blocks"), pivots


def block_pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(_g, a, b, best): every two blocks of a group, and the highest cosine that vectors of both may have."""
    blocks = rows.groupBy("_g", "_b", "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    a, b = (blocks.select("_g", *(F.col(c).alias(f"{c}_{x}") for c in ("_b", "pivot", "lo", "hi"))) for x in "ab")
    between = _angle(_dot(F.get("pivots", "pivot_a"), F.get("pivots", "pivot_b")))
    pairs = a.join(b, "_g").filter("_b_a <= _b_b").join(pivots, "_g").withColumn("t", F.when(F.col("pivot_a") == F.col("pivot_b"), 0.0).otherwise(between))
    least = F.greatest(F.lit(0.0), F.expr("t - hi_a - hi_b"), F.expr("lo_a - t - hi_b"), F.expr("lo_b - t - hi_a"))
    return pairs.select("_g", F.col("_b_a").alias("a"), F.col("_b_b").alias("b"), F.cos(F.greatest(F.lit(0.0), least - SPARE)).alias("best"))


def _meet(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_g, id, _b, nearest): the highest cosine of each vector among those of the blocks that its own meets."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own, a, b = g["_b"].to_numpy(), int(g["a"].iloc[0]), int(g["b"].iloc[0])
        x = np.stack(g["unit"].to_numpy()).astype(np.float64)
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        s = x[left] @ x[right].T
        arm, many = g["_arm"].to_numpy(), g["_many"].to_numpy()
        s[(arm[left][:, None] == arm[right][None, :]) & ~many[right][None, :] & ~many[left][:, None]] = -np.inf
        if a == b:
            np.fill_diagonal(s, -np.inf)
        best = np.full(len(g), -np.inf)
        best[left] = s.max(1, initial=-np.inf)
        best[right] = np.maximum(best[right], s.max(0, initial=-np.inf))
        return g[["_g", "id", "_b"]].assign(nearest=np.where(np.isfinite(best), best, np.nan))

    of_block = pairs.select("_g", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("_b"))
    schema = f"_g string, id {rows.schema['id'].dataType.simpleString()}, _b long, nearest double"
    met = rows.select("_g", "_b", "id", "unit", "_arm", "_many").join(of_block, ["_g", "_b"]).groupBy("_g", "a", "b").applyInPandas(run, schema)
    return met.withColumn("nearest", F.nanvl("nearest", F.lit(None).cast("double")))


def representatives(vecs: DataFrame, by: list[str], arm: str | None) -> DataFrame:
    """Distinct directions of each group: _g, unit, id (the least), _arm (without an arm each row is its own), and _many if several have it."""
    who = F.col("vec_id").cast("string") if arm is None else F.coalesce(F.col(arm).cast("string"), F.lit(""))
    u = vecs.filter("embedding IS NOT NULL").select(F.to_json(F.struct(*by)).alias("_g"), normalise(F.col("embedding")).alias("unit"), who.alias("_arm"), F.col("vec_id").alias("id")).filter(F.exists("unit", lambda x: x != 0))
    several = F.count(F.lit(1)) > 1 if arm is None else F.min("_arm") != F.max("_arm")
    return u.groupBy("_g", "unit").agg(F.min("id").alias("id"), F.min("_arm").alias("_arm"), several.alias("_many"))


def to_meet(rows: DataFrame, pivots: DataFrame, at_least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What each block found in itself, and (_g, a, b, best, meets) of every two blocks: whether they have to meet."""
    pairs = _kept(block_pairs(rows, pivots), "pairs")
    own = _kept(_meet(rows, pairs.filter("a = b")), "own")
    known = F.when(F.col("_many"), F.lit(1.0)).otherwise(F.coalesce("nearest", F.lit(-1.0)))
    floor = own.join(rows.select("_g", "id", "_many"), ["_g", "id"]).groupBy("_g", "_b").agg(F.greatest(F.min(known), F.lit(-1.0 if at_least is None else at_least)).alias("floor"))
    side = lambda x: floor.select("_g", F.col("_b").alias(x), F.col("floor").alias(f"floor_{x}"))
    judged = pairs.join(side("a"), ["_g", "a"]).join(side("b"), ["_g", "b"])
    return own, judged.select("_g", "a", "b", "best", ((F.col("a") != F.col("b")) & (F.col("best") + SPARE >= F.least("floor_a", "floor_b"))).alias("meets"))


def nearest(vecs: DataFrame, by: list[str], arm: str | None = None, block: int = BLOCK, at_least: float | None = None) -> DataFrame:
    """vecs (by, arm, vec_id, embedding) without embedding, with `nearest`: the highest cosine among the group's vectors of other arms (without an arm: other rows).

    With at_least, what is lower comes out as null, and more blocks needn't meet.
    """
    reps = _kept(representatives(vecs, by, arm), "reps")
    rows, pivots = placed(reps, block)
    own, judged = to_meet(rows, pivots, at_least)
    found = own.unionByName(_meet(rows, judged.filter("meets"))).groupBy("_g", "id").agg(F.max("nearest").alias("_n"))
    best = rows.join(found, ["_g", "id"], "left").select("_g", "unit", F.when(F.col("_many"), F.lit(1.0)).otherwise(F.col("_n")).alias("nearest"))
    if at_least is not None:
        best = best.withColumn("nearest", F.when(F.col("nearest") >= at_least, F.col("nearest")))
    keys = [*by, *([arm] if arm else []), "vec_id"]
    mine = vecs.select(*keys, F.to_json(F.struct(*by)).alias("_g"), normalise(F.col("embedding")).alias("unit"))
    return mine.join(best, ["_g", "unit"], "left").select(*keys, "nearest")
