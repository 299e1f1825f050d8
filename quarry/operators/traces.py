"""Operators on trajectories: steps, tool calls, costs, ledgers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOOTER = r"\s*\n--- footer:[^\n]*---\s*$"


# Names and codes of errors by class.
TIMEOUTS = ["ReadTimeoutError", "ConnectTimeoutError", "ConnectionClosedError", "EndpointConnectionError", "ConnectionError", "IncompleteReadError"]
EXPIRED = ["ExpiredTokenException", "ExpiredToken", "InvalidClientTokenId", "UnrecognizedClientException"]
THROTTLES = ["ThrottlingException", "TooManyRequestsException", "Throttling", "RequestLimitExceeded", "ProvisionedThroughputExceededException", "SlowDown", "LimitExceededException", "ServiceQuotaExceededException"]
SERVER = ["ServiceUnavailableException", "InternalServerException", "ModelTimeoutException", "ModelNotReadyException"]
BACKOFF_BASE, BACKOFF_CAP = 1.0, 30.0


def error_class(name: Column, code: Column, status: Column) -> Column:
    """timeout, expired_token, throttle, server_error or other, from an error's class name, code and HTTP status."""
    either = lambda names: name.isin(names) | code.isin(names)
    return (
        F.when(name.isin(TIMEOUTS), "timeout")
        .when(either(EXPIRED), "expired_token")
        .when(either(THROTTLES) | (status == 429), "throttle")
        .when(either(SERVER) | status.isin(500, 502, 503, 504), "server_error")
        .otherwise("other")
    )


def backoff(attempt: Column, base: float = BACKOFF_BASE, cap: float = BACKOFF_CAP) -> Column:
    """Most seconds to wait before retry `attempt` (from 1); the wait itself is drawn evenly below it."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def parse_tool_output(raw: Column) -> Column:
    """The JSON before the footer as a variant, null if it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(raw, FOOTER, ""))


def parse_verdict(text: Column) -> Column:
    """A, B or tie from a tag, closed or not, or from a JSON object inside prose."""
    tagged = F.regexp_extract(text, r"(?i)<verdict>\s*(A|B|tie)\b", 1)
    obj = F.try_variant_get(F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), "$.winner", "string")
    v = F.lower(F.coalesce(F.nullif(tagged, F.lit("")), obj))
    return F.when(v == "tie", "tie").otherwise(F.upper(v))


def spans_of(steps: DataFrame, by: list[str]) -> DataFrame:
    """Start and end of each turn, relative to the run's start, and the run's length (at least 1)."""
    run = [b for b in by if b != "turn"]
    g = steps.groupBy(*by).agg(F.min("t0").alias("start"), F.max("t1").alias("end"))
    w = W.partitionBy(*run)
    zero = F.min("start").over(w)
    return g.select(*by, (F.col("start") - zero).alias("start"), (F.col("end") - zero).alias("end"), F.greatest(F.lit(1).cast("long"), F.max("end").over(w) - zero).alias("total"))


def lanes(intervals: DataFrame, by: list[str], tolerance: int = 1) -> DataFrame:
    """The lowest lane that is free at each interval's start; a fold per group in order of (start, end, id)."""
    schema = ", ".join([*(f"{c} {intervals.schema[c].dataType.simpleString()}" for c in by), "id long", "lane int"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ends: list[int] = []
        out = []
        for r in group.sort_values(["t0", "t1", "id"]).itertuples():
            k = next((i for i, e in enumerate(ends) if e <= r.t0 + tolerance), len(ends))
            ends[k : k + 1] = [r.t1]
            out.append((*(getattr(r, c) for c in by), r.id, k))
        return pd.DataFrame(out, columns=[*by, "id", "lane"])

    return intervals.groupBy(*by).applyInPandas(pack, schema)


def running_tokens(steps: DataFrame, by: list[str], order: str, tokens: str) -> DataFrame:
    """Cumulative tokens, null until usage is first seen."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("cumulative", F.when(F.count(tokens).over(w) > 0, F.sum(tokens).over(w)))


def duration_ms(start: Column, end: Column) -> Column:
    """Null when an end is missing or before its start."""
    d = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(d >= 0, d)


def sandwich(df: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Places that put the best at both edges: ranks 0, 2, 4... from the front, 1, 3, 5... from the back."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    i = F.row_number().over(W.partitionBy(*by).orderBy(rank)) - 1
    return df.withColumn("place", F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2)).cast("long"))


def first_credit(searches: DataFrame, by: list[str], doc: str, order: str) -> DataFrame:
    """For each document, the first search that returned it."""
    return searches.groupBy(*by, doc).agg(F.min(order).alias(order))


def budget_breach(calls: DataFrame, by: list[str], order: list[str], usd: str, cap: float, concurrency: int) -> DataFrame:
    """The first call at which spend so far plus concurrency times the worst call so far reaches the cap."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = calls.withColumn("_x", F.sum(usd).over(w) + concurrency * F.max(usd).over(w)).filter(F.col("_x") >= cap)
    return d.groupBy(*by).agg(F.min_by(F.struct(*order), F.struct(*order)).alias("_o")).select(*by, "_o.*")


def breaker(calls: DataFrame, by: list[str], order: list[str], failed: Column, least: int = 50, rate: float = 0.01) -> DataFrame:
    """The first call at which failures over calls exceed the rate, once `least` calls were made."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = calls.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_f", F.sum(failed.cast("int")).over(w))
    d = d.filter((F.col("_n") >= least) & (F.col("_f") > rate * F.col("_n")))
    return d.groupBy(*by).agg(F.min("_n").alias("calls"))
