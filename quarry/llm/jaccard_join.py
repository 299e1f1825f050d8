"""N-gram Jaccard join by MinHash banding, and near-duplicate groups from it.

Documents are sets of 5-word shingles (64-bit hashes). Equal sets form a class, of which one representative goes on, so exact
copies cost one aggregation however many there are. Band and row counts are chosen for a target recall at the threshold.
Representatives meet by band hash; a bucket is known by its size and a fingerprint of its members, and of buckets with
the same members one is kept. Only representatives in a bucket of two or more send their text, to the buckets kept. There pairs
are verified on the full sets, each pair in the first bucket that both have in common. Large buckets
are cut into blocks, and every two blocks meet in a task of their own, so no task grows with a hot bucket.
A task returns per representative the number of its links and one edge towards each of its group, never the pairs.
Groups are the connected components, by star contractions whose only state is the edges.

Words are white-space separated, in small letters. A text of 1 to 4 words is one shingle; a text without words, or null, is
alone in its class and has no links. Rows repeated with the same id and text are copies like others. Null ids
are ids like others; of a class or group the least non-null id is its name. Groups may share a name, as ids may repeat, so
`deduplicate` tells them apart by their root. Extra columns are ignored by `links`, passed through by `deduplicate`. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm.scratch import fresh, small_batches, without
from quarry.llm.stores import Store

N, THRESHOLD, RECALL = 5, 0.8, 0.997
#: Hash functions at most, and shingles in one block of a bucket.
HASHES, BLOCK = 256, 400_000
#: Entries of a dense matrix of a task's rows and what they have in common; rows times rows that are compared at once.
DENSE, RUN = 8_000_000, 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false candidates, with 1 - (1 - threshold**rows)**bands >= recall."""
    best = None
    for rows in range(1, hashes + 1):
        bands = next((b for b in range(1, hashes // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hash functions for this recall")
    return best


class WordHashes(Store):
    def __missing__(self, word: str) -> int:
        h = self.old.get(word)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self.keep(word, h, 36)


_WORDS = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_WORDS[w] for w in words], np.uint64)
    out = np.full(max(1, len(h) - n + 1), n, np.uint64)
    for k in range(min(n, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


@lru_cache
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def band_hashes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature."""
    a, b = _functions(bands * rows)
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        least = np.minimum(least, (x[k : k + 1024, None] * a + b).min(0))
    sig = least.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
    return out.view(np.int64)


def set_key(found: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of id and text), the set's key (null without words), its size and band hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys = [set_key(s) if len(s) else None for s in sets]
            hashes = [band_hashes(s, bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "key", "cls", "n", "bands"])

    return small_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, key long, cls binary, n long, bands array<long>")


def _columns(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of each entry of some lists whose value stands in two lists or more, and the number of columns."""
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    _, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[at]
    return rows[keep], (np.cumsum(shared, dtype=np.int32) - 1)[at[keep]], int(shared.sum())


class Overlaps:
    """How many columns row i has in common with other rows: a product of dense matrices where these are small, else by look-up."""

    def __init__(self, lists: list[np.ndarray]):
        rows, cols, width = _columns(lists)
        self.n, self.width = len(lists), width
        self.dense = len(lists) * width <= DENSE
        if self.dense:
            self.x = np.zeros((len(lists), width), np.float32)
            self.x[rows, cols] = 1
        else:
            order = np.argsort(cols, kind="stable")
            self.rows, self.first = rows[order], np.searchsorted(cols[order], np.arange(width + 1))  # the rows of each column
            self.cols, self.at = cols, np.searchsorted(rows, np.arange(len(lists) + 1))  # the columns of each row

    def of(self, some: np.ndarray) -> np.ndarray:
        """A matrix of the rows asked for and all rows."""
        if self.dense:
            return self.x[some] @ self.x.T
        out = np.zeros((len(some), self.n), np.float32)
        for k, i in enumerate(some.tolist()):
            mine = self.cols[self.at[i] : self.at[i + 1]]
            if len(mine):
                held = np.concatenate([self.rows[self.first[c] : self.first[c + 1]] for c in mine.tolist()])
                out[k] = np.bincount(held, minlength=self.n)
        return out


def verify(found: list[np.ndarray], buckets: list[np.ndarray], sides: np.ndarray, bucket: int, threshold: float, copies: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a task its links (number of documents) and the least row that links lead to.

    Pairs are looked at across the two sides if there are two, else all. A pair counts only where `bucket` is the least of those
    that both are in. Without `count` links are only told from none, in every bucket, and no more pairs are looked at once all rows
    are connected: a group of near copies then takes one comparison of each with a few others. Rows are compared with
    all others in runs, so that no matrix grows with the square of their number.
    """
    n = len(found)
    sizes = np.array([len(f) for f in found], np.float64)
    inside, earlier = Overlaps(found), Overlaps([b[b < bucket] for b in buckets]) if count else None
    across = bool(sides.any() and not sides.all())
    links, root = np.zeros(n, np.float64), np.arange(n)
    ask = np.flatnonzero(sides == 0) if across else np.arange(n)
    step = max(1, RUN // n)
    for k in range(0, len(ask), step):
        some = ask[k : k + step]
        if not count and (root == root[some[0]]).all():
            break
        both = inside.of(some).astype(np.float64)
        size = sizes[some, None]
        linked = both >= threshold * (size + sizes - both)
        linked &= (sides == 1) if across else np.arange(n) > some[:, None]
        if earlier and earlier.width and linked.any():
            linked &= earlier.of(some) == 0
        links[some] += linked @ copies
        links += copies[some] @ linked
        for i, row in zip(some.tolist(), linked):
            if row.any():
                met = root[row]
                least = min(int(met.min()), int(root[i]))
                if root[i] != least or (met != least).any():
                    root[np.isin(root, np.append(met, root[i]))] = least
    return links, root


def _task(key: tuple[int, int, int], rows: list[tuple], threshold: float, count: bool) -> pa.RecordBatch | None:
    """Links and edges of the representatives that meet in one task: rows (cls, copies, text, buckets, own)."""
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])  # so tasks agree on what leads a group
    bucket, a, b = key
    sides = np.array([a != b and r[4] == b for r in rows], np.int64)
    if len(rows) < 2 or (a != b and (sides.all() or not sides.any())):
        return None
    held = [np.asarray(r[3], np.int64) for r in rows]
    links, root = verify([shingles(r[2]) for r in rows], held, sides, bucket, threshold, np.array([r[1] for r in rows], np.float64), count)
    on = np.flatnonzero(links).tolist()
    return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in on], pa.binary()), pa.array(links[on].astype(np.int64)), pa.array([rows[root[i]][0] for i in on], pa.binary())], names=["cls", "links", "edge"])


def _verified(texts: DataFrame, threshold: float, count: bool) -> DataFrame:
    """Per task and linked representative: links (number of documents) and an edge to the first of its group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for *key, cls, copies, text, buckets, own in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if rows and (out := _task(at, rows, threshold, count)):
                        yield out
                    at, rows = key, []
                rows.append((cls, copies, text, buckets, own))
        if rows and (out := _task(at, rows, threshold, count)):
            yield out

    dealt = texts.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.select("bucket", "a", "b", "cls", "copies", "text", "buckets", "own").mapInArrow(run, "cls binary, links long, edge binary")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v): alternating large-star and small-star contractions, until every edge leads to a root.

    Every round is written, so that a lost executor costs no more than that round. No task holds a star: least neighbours
    are found by min(), written, and joined back, a join whose hot keys Spark can split.
    """
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), files=files)
    while not _stars(now):
        e = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = scratch.table(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), files=files)
        large = scratch.table(e.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), files=files)
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), files=files)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        then = scratch.table(small.filter("u != v").distinct(), files=files)
        for old in (now, m, large, least):
            scratch.discard(old)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v only, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("n")).distinct())
    odd = ends.groupBy("x").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("all")).filter("out > 1 OR (out = 1 AND all > 1)")
    return not odd.head(1)


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, groups): doc_id and class of each document, and per class its name, links, and its group's root and name.

    With `count` every two blocks of a bucket meet, as the number of a document's links takes all its pairs. Without it (links is then 0 or
    more, no number) the same groups take work in proportion to the documents: blocks are first connected inside, then only blocks of
    different groups meet, and a bucket that is one group by then is done.
    """
    bands, rows = choose_bands(threshold, recall)
    members = scratch.table(signatures(docs, bands, rows))
    n = members.count()
    files = scratch.files_for(docs.sparkSession, n)
    reps = scratch.table(members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), files=files)
    banded = reps.select("cls", "n", F.explode("bands").alias("h"))
    members_of = [F.bit_xor(F.xxhash64("cls", F.lit(s))).alias(f"p{s}") for s in (1, 2)]
    buckets = banded.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), *members_of).filter("size > 1")
    buckets = buckets.groupBy("size", "p1", "p2").agg(F.min("h").alias("h"), F.first("weight").alias("weight"))
    kept = scratch.table(banded.join(buckets.select("h", F.ceil(F.col("weight") / block).cast("int").alias("blocks")), "h").select("cls", "n", "h", "blocks"), files=scratch.files_for(docs.sparkSession, bands * n))
    mine = kept.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("h", "blocks"))).alias("held"))
    texts = _rep_texts(docs, reps, mine)
    per = texts.select("cls", "copies", "text", F.transform("held", lambda x: x["h"]).alias("buckets"), F.explode("held").alias("x"))
    per = per.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("x.blocks")).cast("int"))
    per = per.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1) if count else F.array("own")))
    per = per.select("cls", "copies", "text", "buckets", F.col("x.h").alias("bucket"), "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    found = scratch.table(_verified(per, threshold, count))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("edge").alias("v")), files)
    if not count and open_buckets(kept, roots).head(1):
        tasks = scratch.table(open_tasks(kept, roots, block, files))
        texts = _rep_texts(docs, reps, tasks.groupBy("cls").agg(F.array(F.lit(0)).alias("held")))
        per = texts.select("cls", "copies", "text", F.array().cast("array<long>").alias("buckets")).join(tasks, "cls")
        more = _verified(per, threshold, count).select(F.col("cls").alias("u"), F.col("edge").alias("v"))
        roots = components(scratch.table(more).union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), files)
    d = reps.select("cls", "rep", "copies").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    d = scratch.table(d.select("cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "cls").alias("root")), files=files)
    names = scratch.table(d.groupBy("root").agg(F.min("rep").alias("group_id")), files=files)
    return members, d.join(names, "root").select("cls", "rep", "links", "root", "group_id")


def _rooted(kept: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, h, n, root) of the buckets of several blocks."""
    hot = kept.filter("blocks > 1").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return hot.select("cls", "h", "n", F.coalesce("root", "cls").alias("root"))


def open_buckets(kept: DataFrame, roots: DataFrame) -> DataFrame:
    """(h): buckets of several blocks that are not yet one group."""
    return _rooted(kept, roots).groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("h")


def open_tasks(kept: DataFrame, roots: DataFrame, block: int, files: int | None = None) -> DataFrame:
    """(cls, bucket, own, a, b): the tasks left in buckets of several blocks that are not yet one group.

    A group that fills half a block or more has blocks of its own, which don't meet each other; the rest share blocks that meet all.
    """
    several = scratch.table(open_buckets(kept, roots), files=files)
    hot = scratch.table(_rooted(kept, roots).join(several, "h", "left_semi"))
    parts = hot.groupBy("h", "root").agg(F.sum("n").alias("weight"))
    parts = scratch.table(parts.select("h", "root", "weight", F.when(F.col("weight") >= block / 2, F.hex("root")).otherwise("-").alias("part")), files=files)
    blocks = scratch.table(parts.groupBy("h", "part").agg(F.ceil(F.sum("weight") / block).cast("int").alias("blocks")), files=files)
    rows = hot.join(parts.select("h", "root", "part"), ["h", "root"]).join(blocks, ["h", "part"])
    rows = rows.select("cls", "h", "part", F.concat("part", F.lit(":"), F.pmod(F.xxhash64("cls"), "blocks")).alias("own"))
    every = blocks.select("h", F.col("part").alias("met"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    every = every.select("h", "met", F.concat("met", F.lit(":"), "k").alias("other"))
    met = rows.join(every, "h").filter((F.col("part") != F.col("met")) | (F.col("part") == "-"))
    return met.select("cls", F.col("h").alias("bucket"), "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def _rep_texts(docs: DataFrame, reps: DataFrame, mine: DataFrame) -> DataFrame:
    """cls, copies, text and held of the classes in `mine` (cls, held)."""
    mine = mine.join(reps.select("cls", "rep", "copies"), "cls")
    return _own_text(docs.select("doc_id", "text").join(mine, F.col("doc_id").eqNullSafe(F.col("rep"))))


def _own_text(texts: DataFrame) -> DataFrame:
    """Of rows joined by id, those whose text has the class's set: ids may repeat with other texts. One row per class."""
    schema = texts.select("cls", "copies", "text", "held").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = [set_key(shingles(t)) == k for t, k in zip(b.column(2).to_pylist(), b.column(0).to_pylist())]
            yield b.filter(pa.array(right, pa.bool_()))

    return texts.select("cls", "copies", "text", "held").mapInArrow(run, schema)


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (its near-duplicate group), copy_of (least id with the same set), n_links."""
    members, groups = classes(docs, threshold, recall)
    own = F.coalesce(F.col("rep"), F.col("doc_id"))
    return members.join(groups, "cls", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), own.alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each group, the one of the least id, with all its columns; documents without words stay."""
    members, groups = classes(docs, threshold, recall, count=False)
    key = fresh(docs, "_key")
    named = members.join(groups, "cls")
    # of a group's rows with the least id, those of one text stay
    first = scratch.table(named.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("root").agg(F.min("key").alias("stay"), F.count(F.lit(1)).alias("rows")), files=scratch.files_for(docs.sparkSession, members.count()))
    gone = named.join(first.select("root", "stay"), "root").filter(F.col("key") != F.col("stay")).select(F.col("key").alias(key)).distinct()
    kept = without(docs.withColumn(key, F.xxhash64("doc_id", "text")), gone, key)
    if first.filter("rows > 1").head(1):  # only then may a kept row be repeated
        again = first.filter("rows > 1").select(F.col("stay").alias(key))
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.drop(key)


#: The same by a join on shingles and a recursive closure, for tables small enough for that; ids must be unique.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
l AS (SELECT a, b, same FROM e UNION ALL SELECT b, a, same FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (WHERE same) AS first_copy FROM l GROUP BY 1)
SELECT d.doc_id, min(r.root) AS class_id, least(d.doc_id, any_value(first_copy)) AS copy_of, coalesce(any_value(n_links), 0) AS n_links
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""
