"""Approximate vector search by navigable graphs: one per range of about `shard` vectors, written as a table of nodes.

A node has its links (at most DEGREE) and a product-quantised code. Graphs are built by greedy search and robust pruning: a point is
searched for in the graph so far, and of all that the search met, those stay as its links that no kept link comes much closer to; links go both ways. A query walks every
graph by the codes, keeps a beam of the best nodes, and the best of all graphs are scored exactly from their vectors, which are read by their ids.

Inner products are searched. For building, vectors get one more entry that brings all to one length, so that the nearest are those of the highest product.
Graphs hold every vector; only the codes' centroids are fitted on a sample, of TRAIN vectors at most. Null vectors have no node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.dense import QUERY_BYTES, norm

#: Vectors of a graph, links of a node, nodes that a build search keeps, how much closer a kept link must come (squared), vectors that the codes are fitted on.
SHARD, DEGREE, BUILD_LIST, SLACK, TRAIN = 16_384, 64, 100, 1.44, 4_096
#: Entries per part of a code, centroids of a part, queries that walk side by side.
PART, CENTROIDS, TOGETHER = 2, 256, 256

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def walk(links: np.ndarray, start: int, queries: int, beam: int, distance: Distance) -> tuple[np.ndarray, np.ndarray, int]:
    """(queries, beam) nodes and distances, nearest first (-1: none), and how many distances were asked for.

    distance(rows, nodes) is that of each query `rows[i]` to `nodes[i]`. links has a row of nodes each, filled up with -1.
    """
    every = np.arange(queries)
    seen = np.zeros((queries, len(links)), bool)
    ids, dist, open_ = np.full((queries, beam), -1, np.int64), np.full((queries, beam), np.inf), np.zeros((queries, beam), bool)
    ids[:, 0], open_[:, 0], seen[:, start] = start, True, True
    dist[:, 0] = distance(every, np.full(queries, start))
    asked = queries
    while True:
        best = np.where(open_, dist, np.inf)
        j = best.argmin(1)
        rows = np.flatnonzero(np.isfinite(best[every, j]))
        if not len(rows):
            order = np.argsort(dist, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), asked
        open_[rows, j[rows]] = False
        near = links[ids[rows, j[rows]]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        nodes = near[r, c]
        seen[rows[r], nodes] = True
        asked += len(nodes)
        more = np.full(near.shape, np.inf)
        more[r, c] = distance(rows[r], nodes)
        all_d = np.concatenate([dist[rows], more], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], 1), keep, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], 1), keep, 1)


def prune(x: np.ndarray, point: int, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Of the candidates the nearest, then each that isn't much nearer to a kept one than to the point; at most `degree`."""
    c = np.unique(candidates)
    c = c[(c >= 0) & (c != point)]
    d = ((x[c] - x[point]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    c, d = c[order], d[order]
    near = x[c]
    square = (near * near).sum(1)
    alive, kept = np.ones(len(c), bool), []
    while len(kept) < degree:
        rest = np.flatnonzero(alive)
        if not len(rest):
            break
        k = rest[0]
        kept.append(c[k])
        alive[k] = False
        rest = rest[1:]
        to_kept = square[rest] + square[k] - 2 * (near[rest] @ near[k])
        alive[rest[slack * to_kept <= d[rest]]] = False
    return np.array(kept, np.int64)


def build(x: np.ndarray, degree: int = DEGREE, list_size: int = BUILD_LIST, slack: float = SLACK, seed: int = 7) -> tuple[np.ndarray, int]:
    """Links (n, degree) of a navigable graph over the rows of x, and the node where searches start: the one nearest to the mean.

    Points go in by batches: they are searched for in the graph of those before, and linked to what is left of what they met.
    """
    n, rng = len(x), np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    square = (x * x).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    # lists may grow by half before they are pruned again
    links = np.full((n, degree + degree // 2), -1, np.int64)
    order = np.concatenate([[start], rng.permutation(np.delete(np.arange(n), start))]).astype(np.int64)
    done = 1
    while done < n:
        batch = order[done : done + min(TOGETHER, max(1, done))]
        q = x[batch]
        met, _, _ = walk(links, start, len(batch), list_size, lambda rows, nodes: square[nodes] - 2 * np.einsum("ij,ij->i", x[nodes], q[rows]))  # noqa: B023
        # points of one batch don't find each other in the graph
        among = square[batch] - 2 * (q @ q.T)
        among = batch[np.argsort(among, axis=1, kind="stable")[:, : list_size // 4]]
        back: dict[int, list[int]] = {}
        for k, p in enumerate(batch):
            own = prune(x, int(p), np.concatenate([met[k], among[k]]), degree, slack)
            links[p, : len(own)] = own
            links[p, len(own) :] = -1
            for o in own.tolist():
                back.setdefault(o, []).append(int(p))
        for o, points in back.items():
            have = links[o][links[o] >= 0]
            all_ = np.unique(np.concatenate([have, points]))
            all_ = all_ if len(all_) <= links.shape[1] else prune(x, o, all_, degree, slack)
            links[o, : len(all_)] = all_
            links[o, len(all_) :] = -1
        done += len(batch)
    for o in np.flatnonzero(links[:, degree] >= 0).tolist():
        own = prune(x, o, links[o], degree, slack)
        links[o] = -1
        links[o, : len(own)] = own
    return links[:, :degree], start


def centroids(sample: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(parts, CENTROIDS, PART): k-means of each part of the sample's vectors; missing entries of the last part are 0."""
    rng = np.random.default_rng(seed)
    parts = _parts(sample)
    out = np.zeros((parts.shape[1], CENTROIDS, PART), np.float32)
    for m in range(parts.shape[1]):
        p = parts[:, m]
        c = p[rng.permutation(len(p))[:CENTROIDS]]
        for _ in range(rounds):
            own = ((c * c).sum(1) - 2 * p @ c.T).argmin(1)
            n = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, weights=p[:, k], minlength=len(c)) for k in range(PART)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        out[m, : len(c)] = c
        out[m, len(c) :] = c[0]
    return out


def _parts(x: np.ndarray) -> np.ndarray:
    width = -(-x.shape[1] // PART) * PART
    return np.pad(np.asarray(x, np.float32), ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, PART)


def encode(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """One byte per part: the nearest centroid."""
    parts = _parts(x)
    return np.stack([((c * c).sum(1) - 2 * parts[:, m] @ c.T).argmin(1) for m, c in enumerate(book)], 1).astype(np.uint8)


NODES = "shard long, node int, start int, id long, code binary, links binary"


def write_graphs(docs: DataFrame, path: str, shard: int = SHARD, degree: int = DEGREE, train: int = TRAIN) -> None:
    """The index of docs (id, vec): nodes by shard under `path`/nodes, the codes' centroids under `path`/book."""
    spark = docs.sparkSession
    d = docs.filter("vec IS NOT NULL").select("id", "vec")
    head = d.agg(F.count(F.lit(1)).alias("n"), F.max(norm(F.col("vec"))).alias("most")).collect()[0]
    n, most = head["n"], head["most"] or 0.0
    hashed = d.withColumn("_h", F.xxhash64("id"))
    sample = np.array([r["vec"] for r in hashed.orderBy("_h", "id").limit(train).select("vec").collect()], np.float32)
    book = centroids(sample) if len(sample) else np.zeros((1, CENTROIDS, PART), np.float32)
    spark.createDataFrame([(m, c.tobytes()) for m, c in enumerate(book)], "part int, centroids binary").coalesce(1).write.parquet(f"{path}/book")

    def graph(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["vec"].to_numpy()).astype(np.float32)
        level = np.sqrt(np.maximum(most * most - (x.astype(np.float64) ** 2).sum(1), 0)).astype(np.float32)
        links, start = build(np.concatenate([x, level[:, None]], 1), degree)
        code = encode(x, book)
        return pd.DataFrame({"shard": key[0], "node": np.arange(len(g), dtype=np.int32), "start": np.int32(start), "id": g["id"].to_numpy(), "code": [c.tobytes() for c in code], "links": [r.astype(np.int32).tobytes() for r in links]})

    ranges = max(1, -(-n // shard))
    hashed.withColumn("shard", F.pmod("_h", F.lit(ranges))).groupBy("shard").applyInPandas(graph, NODES).write.parquet(f"{path}/nodes")


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of each graph together; a graph's rows stand one after another in one row group of a file."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for _, g in b.groupby((b["shard"] != b["shard"].shift()).cumsum(), sort=False):
            if held and held[0]["shard"].iloc[0] != g["shard"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(g)
    if held:
        yield pd.concat(held)


def search(queries: DataFrame, docs: DataFrame, path: str, k: int, beam: int = 64) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, vec) in the index of write_graphs; `beam` nodes are kept in each graph, and the best 2 * `beam` of all graphs are scored exactly.

    Query vectors are a bounded block (QUERY_BYTES); further blocks are further walks.
    """
    near = walked(queries, docs, path, max(k, beam)).filter("id IS NOT NULL")
    w = W.partitionBy("query_id").orderBy("distance", "id")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(k, 2 * beam)).select("query_id", "id")
    dot = F.aggregate(F.zip_with("q", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = near.join(queries.select("query_id", F.col("vec").alias("q")), "query_id").join(docs.select("id", "vec"), "id").select("query_id", "id", dot.alias("score"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", r.cast("long")).filter(F.col("rank") <= k)


def walked(queries: DataFrame, docs: DataFrame, path: str, beam: int) -> DataFrame:
    """(query_id, id, distance, asked): the beam of each query in each graph; a row of null id says how many distances the walk took."""
    spark = docs.sparkSession
    nodes = spark.read.parquet(f"{path}/nodes")
    book = np.stack([np.frombuffer(r["centroids"], np.float32).reshape(CENTROIDS, PART) for r in spark.read.parquet(f"{path}/book").orderBy("part").collect()])
    head = queries.limit(1).collect()
    schema = "query_id long, id long, distance double, asked long"
    if not head:
        return spark.createDataFrame([], schema)
    size = max(1, QUERY_BYTES // (8 * len(head[0]["vec"])))
    blocks = -(-queries.count() // size)
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.select("query_id", "vec").collect()
        ids, matrix = np.array([r["query_id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float32)

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for g in _shards(batches):
                g = g.sort_values("node")
                code = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), -1)
                links = np.frombuffer(b"".join(g["links"]), np.int32).reshape(len(g), -1).astype(np.int64)
                own, start, m = g["id"].to_numpy(), int(g["start"].iloc[0]), np.arange(code.shape[1])
                for lo in range(0, len(ids), TOGETHER):
                    q = matrix[lo : lo + TOGETHER]
                    table = np.einsum("qmp,mcp->qmc", _parts(q), book)
                    found, dist, asked = walk(links, start, len(q), beam, lambda rows, nodes: -table[rows[:, None], m, code[nodes]].sum(1))  # noqa: B023
                    r, c = np.nonzero(found >= 0)
                    yield pd.DataFrame({"query_id": np.append(ids[lo + r], ids[lo]), "id": pd.array(np.append(own[found[r, c]], 0), "Int64"), "distance": np.append(dist[r, c], 0.0), "asked": np.append(np.zeros(len(r), np.int64), asked)}).assign(id=lambda d: d["id"].where(d["asked"] == 0))

        got = nodes.mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    return out
