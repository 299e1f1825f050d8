"""Dense vectors: search, truncation, diversity. Blocks of vectors meet as matrices inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.corpus import spread

#: Most bytes of query vectors, and of what a task keeps for them, that go to every task at once; more queries are searched in several passes.
QUERY_BYTES = 64 << 20
#: Products that a task looks at at once, and rows of a batch that it gives back.
TILE, OUT_ROWS = 1 << 20, 50_000


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vec: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(vec), F.lit(floor))
    return F.transform(vec, lambda x: (x.cast("double") / n))


def truncate(vec: Column, dim: int) -> Column:
    """The first dim entries at unit length; a zero vector stays."""
    head = F.slice(vec, 1, dim)
    return F.when(norm(head) == 0, F.transform(head, lambda x: x.cast("double"))).otherwise(normalise(head))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _query_blocks(queries: DataFrame, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries (query_id, vec), a bounded number (QUERY_BYTES) at a time; each is a pass over the documents."""
    given = queries.filter("vec IS NOT NULL").select("query_id", "vec")
    n, dim = given.agg(F.count(F.lit(1)), F.max(F.size("vec"))).collect()[0]
    passes = -(-n * (16 * (dim or 0) + 32 * k) // QUERY_BYTES)
    for block in range(passes):
        rows = (given if passes == 1 else given.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == block)).toArrow()
        if len(rows):
            yield rows.column("query_id").to_numpy().astype(np.int64), _matrix(rows.column("vec"))


def _tiles(ids: np.ndarray, m: int) -> Iterator[slice]:
    """Queries that meet m documents at once: a matrix of TILE scores at most."""
    step = max(1, TILE // max(1, m))
    return (slice(a, min(len(ids), a + step)) for a in range(0, len(ids), step))


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; of fewer none."""
    m = scores.shape[1]
    return np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else np.full(len(scores), -np.inf)


def places(sorted_keys: np.ndarray) -> np.ndarray:
    """Each entry's place among the equal ones of a sorted array."""
    n = np.arange(len(sorted_keys))
    first = np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(n)]
    return n - np.maximum.accumulate(np.where(first, n, 0))


def top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact inner-product search: (query_id, id, score, rank) from queries (query_id, vec) and docs (id, vec).

    Query vectors are a bounded block, whatever the documents' number; further blocks are further passes. A task keeps k of its documents a query,
    and looks at TILE products at once. Products that may be among the best are summed again entry by entry, so that copies score alike wherever they stand.
    """
    out = docs.sparkSession.createDataFrame([], "query_id long, id long, score double")
    given = spread(docs.filter("vec IS NOT NULL").select("id", "vec"))
    for ids, matrix in _query_blocks(queries, k):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            columns, size = np.ascontiguousarray(matrix.T), np.linalg.norm(matrix, axis=1)
            for b in batches:
                if not b.num_rows:
                    continue
                x, own = _matrix(b.column("vec")), b.column("id").to_numpy(zero_copy_only=False)
                slack = size * np.linalg.norm(x, axis=1).max() * x.shape[1] * 1e-15  # more than the order of summation can change
                entries = np.ascontiguousarray(x.T)
                for t in _tiles(ids, len(x)):
                    s = matrix[t] @ entries
                    least = best_s[t, -1]
                    if np.isneginf(least).any():
                        least = np.maximum(least, _kth(s, k) - slack[t])
                    r, c = np.divmod(np.flatnonzero(s >= (least - slack[t])[:, None]), len(x))
                    for a in range(0, len(r), TILE // 4):
                        _merge(best_s, best_i, r[a : a + TILE // 4] + t.start, c[a : a + TILE // 4], columns, entries, own)
            q, place = np.nonzero(best_s > -np.inf)
            for a in range(0, len(q), OUT_ROWS):
                at = q[a : a + OUT_ROWS], place[a : a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(best_i[at]), pa.array(best_s[at])], names=["query_id", "id", "score"])

        out = out.unionByName(given.mapInArrow(run, "query_id long, id long, score double"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _merge(best_s: np.ndarray, best_i: np.ndarray, q: np.ndarray, c: np.ndarray, columns: np.ndarray, entries: np.ndarray, own: np.ndarray) -> None:
    """Put the products of queries q and documents c among the best of each query, highest first, then by id."""
    s = np.zeros(len(q))
    for x, y in zip(columns, entries):
        s += x[q] * y[c]
    k, met = best_s.shape[1], np.unique(q)
    q, s, i = np.append(np.repeat(met, k), q), np.append(best_s[met].ravel(), s), np.append(best_i[met].ravel(), own[c])
    order = np.lexsort((i, -s, q))
    order, place = order[keep := (p := places(q[order])) < k], p[keep]
    best_s[q[order], place], best_i[q[order], place] = s[order], i[order]


def grams(vecs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, gram): the d x d products of a group's vectors; each task sums those of its own rows, so a group's size doesn't matter."""
    keys = ", ".join(f"{c} {vecs.schema[c].dataType.simpleString()}" for c in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, tuple[int, np.ndarray]] = {}
        for b in batches:
            for key, g in b.groupby(by, dropna=False):
                x = np.stack(g["embedding"].to_numpy()).astype(np.float64)
                n, k = sums.get(key, (0, 0.0))
                sums[key] = n + len(x), k + x.T @ x
        if sums:
            yield pd.DataFrame([(*key, n, k.ravel()) for key, (n, k) in sums.items()], columns=[*by, "n", "gram"])

    def total(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, int(g["n"].sum()), np.sum(np.stack(g["gram"].to_numpy()), 0))], columns=[*by, "n", "gram"])

    schema = f"{keys}, n long, gram array<double>"
    return vecs.filter("embedding IS NOT NULL").select(*by, "embedding").mapInPandas(partial, schema).groupBy(*by).applyInPandas(total, schema)


def _effective(gram: np.ndarray, n: int) -> float:
    """exp of the entropy of the eigenvalues of gram / n, which are those of the n x n similarities over n."""
    d = int(round(len(gram) ** 0.5))
    e = np.clip(np.linalg.eigvalsh(gram.reshape(d, d) / n), 0, None)
    e = e[e > 1e-12]
    e = e / e.sum() if len(e) else e
    return float(np.exp(-(e * np.log(e)).sum()))


def vendi(vecs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, vendi): the effective number of distinct vectors of a group."""
    keys = ", ".join(f"{c} {vecs.schema[c].dataType.simpleString()}" for c in by)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[*by, "n"]].assign(vendi=[_effective(np.asarray(g), int(n)) for g, n in zip(b["gram"], b["n"])])

    return grams(vecs, by).mapInPandas(score, f"{keys}, n long, vendi double")


def vendi_gain(vecs: DataFrame, by: list[str], arm: str) -> DataFrame:
    """(by, arm, n, vendi, together, gain): the score of each arm, that of all arms of a group together, and what the others add to it.

    Products are summed once, per arm; the union's are the sums of its arms'.
    """
    kinds = {c: vecs.schema[c].dataType.simpleString() for c in (*by, arm)}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def both(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        grams = np.stack(g["gram"].to_numpy())
        n = g["n"].to_numpy()
        all_ = _effective(grams.sum(0), int(n.sum()))
        own = [_effective(x, int(k)) for x, k in zip(grams, n)]
        return pd.DataFrame([(*key, a, int(k), v, all_, all_ - v) for a, k, v in zip(g[arm], n, own)], columns=[*by, arm, "n", "vendi", "together", "gain"])

    return grams(vecs, [*by, arm]).groupBy(*by).applyInPandas(both, f"{keys}, {arm} {kinds[arm]}, n long, vendi double, together double, gain double")


def mean_cosine(vecs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, pairs, mean): mean cosine of the pairs of a group (by, embedding), from the sum of its unit vectors; null without pairs."""
    n = F.col("n")
    units = vecs.filter("embedding IS NOT NULL").select(*by, F.posexplode(normalise(F.col("embedding"))).alias("i", "x"))
    sums = units.groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("q").alias("own"))
    return total.select(*by, "n", (n * (n - 1) / 2).cast("long").alias("pairs"), F.when(n > 1, (F.col("square") - F.col("own")) / (n * (n - 1))).alias("mean"))


def write_codes(docs: DataFrame, path: str) -> None:
    """A vector index of docs (id, vec): each vector as one byte per entry and a scale, how far that is from the vector, and a digest that copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"))
            scale = np.maximum(np.abs(x).max(1, initial=0), 1e-30) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            off = np.linalg.norm(x - codes * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copy"), pa.array(scale), pa.array(off), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "copy", "scale", "off", "code"])

    given = docs.filter("vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.xxhash64("vec").alias("copy"), "vec")
    given.mapInArrow(run, "id long, copy long, scale double, off double, code binary").write.parquet(path)


def quantised_top_k(queries: DataFrame, docs: DataFrame, codes: str, k: int) -> DataFrame:
    """Search in an index of write_codes: (query_id, id, score, rank), the same as `top_k`.

    A code's score is off by no more than the query's length times the code's distance from its vector. Whatever may reach the k-th highest of the
    least scores is scored exactly. Codes take an eighth of the vectors' bytes, and of the vectors only those of the candidates are read, by their ids.
    """
    near = docs.sparkSession.createDataFrame([], "query_id long, id long, low double, high double")
    index = spread(docs.sparkSession.read.parquet(codes).select("id", "copy", "scale", "off", "code"))
    for ids, matrix in _query_blocks(queries, 4 * k):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            least, size = np.full(len(ids), -np.inf), np.linalg.norm(matrix, axis=1)
            held = np.zeros(0, [("q", np.int64), ("low", np.float64), ("high", np.float64), ("copy", np.int64), ("id", np.int64)])
            for b in batches:
                if not b.num_rows:
                    continue
                number = lambda name: b.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1) * number("scale")[:, None]
                off = number("off") + np.linalg.norm(x, axis=1) * x.shape[1] * 1e-15
                for t in _tiles(ids, len(x)):
                    s, far = matrix[t] @ x.T, size[t, None] * (off * 1.000001)[None, :]
                    if np.isneginf(least[t]).any():
                        least[t] = np.maximum(least[t], _kth(s - far, k))
                    r, c = np.divmod(np.flatnonzero(s + far >= least[t, None]), len(x))
                    found = np.empty(len(r), held.dtype)
                    found["q"], found["low"], found["high"], found["copy"], found["id"] = r + t.start, (s - far)[r, c], (s + far)[r, c], number("copy")[c], number("id")[c]
                    mine = (held["q"] >= t.start) & (held["q"] < t.stop)
                    held = np.append(held[~mine], _candidates(np.append(held[mine], found), least, k))
            for a in range(0, len(held), OUT_ROWS):
                h = held[a : a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(ids[h["q"]]), *(pa.array(np.ascontiguousarray(h[n])) for n in ("id", "low", "high"))], names=["query_id", "id", "low", "high"])

        near = near.unionByName(index.mapInArrow(run, "query_id long, id long, low double, high double"))
    own = W.partitionBy("query_id")
    kth = F.max(F.when(F.col("r") == k, F.col("low"))).over(own)
    near = near.withColumn("r", F.row_number().over(own.orderBy(F.desc("low")))).withColumn("kth", kth).filter("kth IS NULL OR high >= kth").select("query_id", "id")
    dot = F.aggregate(F.zip_with("q", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = near.join(queries.select("query_id", F.col("vec").alias("q")), "query_id").join(docs.select("id", "vec"), "id").select("query_id", "id", dot.alias("score"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", r.cast("long")).filter(F.col("rank") <= k)


def _candidates(found: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """What may be among the best k of its query; of copies the k of least ids. Raises `least` to the k-th highest of the least scores."""
    found = found[np.lexsort((found["id"], found["copy"], found["q"]))]
    same = np.append(False, (found["q"][1:] == found["q"][:-1]) & (found["copy"][1:] == found["copy"][:-1]))[: len(found)]
    found = found[places(np.cumsum(~same)) < k]
    found = found[np.lexsort((-found["low"], found["q"]))]
    last = found[places(found["q"]) == k - 1]
    least[last["q"]] = np.maximum(least[last["q"]], last["low"])
    return found[found["high"] >= least[found["q"]]]
