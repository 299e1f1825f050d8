"""Patches of drafts, candidate unions and loops over facets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RETAIN, SHRINK, WORD_CAP = 0.20, 0.75, 1024


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?").lower() for w in text.split()]


def patch_lines(lines: list[str], proposals: list[tuple[str, int, str, bool]], cap: int = WORD_CAP) -> tuple[list[str], list[str]]:
    """Apply (op, line, text, authorised) in order; (lines, outcome of each).

    An unauthorised citation, a missing line, a replacement that keeps under RETAIN of the words or under SHRINK of the
    length, or one that takes the draft over the cap is refused, and leaves the draft as it was.
    """
    lines, out = list(lines), []
    for op, at, text, authorised in proposals:
        if not authorised:
            out.append("unauthorised")
            continue
        if op in ("replace", "delete") and not 0 <= at < len(lines):
            out.append("no such line")
            continue
        trial = list(lines)
        if op == "replace":
            old, new = set(_words(lines[at])), set(_words(text))
            if old and len(old & new) < RETAIN * len(old):
                out.append("drops the claim")
                continue
            if len(text) < SHRINK * len(lines[at]):
                out.append("too short")
                continue
            trial[at] = text
        elif op == "delete":
            del trial[at]
        else:
            trial.insert(max(0, min(at, len(trial))), text)
        if sum(len(x.split()) for x in trial) > cap:
            out.append("over the word cap")
            continue
        lines = trial
        out.append("applied")
    return lines, out


def apply_patches(drafts: DataFrame, proposals: DataFrame, cap: int = WORD_CAP) -> DataFrame:
    """(key, n, outcome, lines, words) per proposal from drafts (key, lines) and proposals (key, n, op, at, text, ok)."""
    p = proposals.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "op", "at", "text", "ok"))).alias("p"))

    def run(batches):
        for b in batches:
            rows = []
            for key, lines, p in zip(b["key"], b["lines"], b["p"]):
                done, outcomes = patch_lines(list(lines), [(x["op"], x["at"], x["text"], x["ok"]) for x in p], cap)
                rows += [(key, x["n"], o, len(done), sum(len(t.split()) for t in done)) for x, o in zip(p, outcomes)]
            yield pd.DataFrame(rows, columns=["key", "n", "outcome", "lines", "words"])

    return drafts.join(p, "key").mapInPandas(run, "key long, n long, outcome string, lines long, words long")


def union_violations(items: Column, words: Column, anchor_items: Column, anchor_words: Column) -> Column:
    """Why a compiled union can't stand in for its anchor: fewer than 60 % of its items or 65 % of its words."""
    return F.array_compact(F.array(F.when(items < 0.6 * anchor_items, "items"), F.when(words < 0.65 * anchor_words, "words")))


def facet_loop(rows: DataFrame, by: list[str], iteration: str, covered: str, cap: int) -> DataFrame:
    """Where each facet's loop stops: the first iteration that covers it, or the cap; evidence gathered up to there."""
    stop = rows.groupBy(*by).agg(F.min(F.when(F.col(covered), F.col(iteration))).alias("_first"), F.max(iteration).alias("_last"))
    s = stop.select(*by, F.least(F.coalesce("_first", F.col("_last")), F.lit(cap)).alias("stopped"), (F.col("_first") <= cap).alias("_c"))
    return rows.join(s, by).filter(F.col(iteration) <= F.col("stopped")).groupBy(*by, "stopped").agg(F.coalesce(F.max("_c"), F.lit(False)).alias("covered"), F.sum("evidence").alias("evidence"))
