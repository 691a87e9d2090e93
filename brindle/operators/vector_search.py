"""Exact and inverted-file vector search.

``Ivf`` fits centroids on a bounded sample (``SAMPLE`` vectors) and indexes every row; codes are
plain vectors, 8-bit scalars, product codes or sign bits, and candidates are ranked again by exact
distance. Queries are a bounded set, held by every task; the table is scanned, not collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, inner_product, l2

#: Vectors that centroids are fitted on, at most; query vectors of a block.
SAMPLE, QUERIES = 20_000, 4_096
#: Distances that a task holds at once, rows of them at most, and numbers of vectors that it holds to compare pairs.
TILE, ROWS, PAIRED = 1 << 20, 1 << 11, 1 << 20
METRIC = {"cosine": cosine, "l2": l2, "ip": lambda a, b: -inner_product(a, b)}


def flat_search(table: DataFrame, query: list[float], k: int, metric: str = "cosine", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows, with ``distance``."""
    q = F.array(*(F.lit(float(v)) for v in query))
    scored = table.select(F.col(id_column).alias("id"), METRIC[metric](F.col(column), q).alias("distance"))
    return scored.orderBy("distance", "id").limit(k)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return -(x @ q.T)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return np.where(norm == 0, 1.0, 1 - (x @ q.T) / np.where(norm == 0, 1, norm))
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ q.T + (q**2).sum(1)[None, :], 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows; ragged ones are an error."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows ``i`` of ``x`` to the rows ``j`` of ``q``, summed coordinate by coordinate as SQL does: equal vectors are equally far."""
    out = np.empty(len(i))
    step = max(1, PAIRED // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        a, b = np.ascontiguousarray(x[i[s : s + step]].T), np.ascontiguousarray(q[j[s : s + step]].T)
        total = lambda v: np.add.reduce(v, axis=0)
        if metric == "l2":
            d = np.sqrt(total((a - b) ** 2))
        elif metric == "ip":
            d = -total(a * b)
        else:
            norm = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
            d = np.where(norm == 0, 1.0, 1 - total(a * b) / np.where(norm == 0, 1, norm))
        out[s : s + step] = d
    return out


def _slack(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """By how much ``_distances`` of a query may miss, at most: squared distances for l2."""
    rounding = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    if metric == "cosine":
        return np.full(len(q), rounding)
    longest = np.sqrt(np.nanmax((x**2).sum(1), initial=0.0))
    size = np.sqrt((q**2).sum(1))
    return rounding * ((longest + size) ** 2 if metric == "l2" else longest * size)


def _reach(d: np.ndarray, slack: np.ndarray, metric: str) -> np.ndarray:
    """The rough distance up to which rows may be as near as ``d``."""
    return np.sqrt(d**2 + 2 * slack) if metric == "l2" else d + 2 * slack


def _nearest(j: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query ``j``; equal distances by id."""
    order = np.lexsort((ids, d, j))
    order = order[np.isfinite(d[order])]
    first = np.searchsorted(j[order], j[order], "left")
    return order[np.arange(len(order)) - first < k]


def _batch(queries: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], names=["query", "id", "distance"])


_HITS = "query long, id long, distance double"


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; tasks have given at most k each."""
    w = Window.partitionBy("query").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_knn(table: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, id, distance and rank of the k nearest rows of each query (id, vector); queries in blocks of ``QUERIES``."""
    given = queries.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).where("v is not null")
    blocks = max(1, -(-given.count() // QUERIES))
    out = None
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        q = np.array([r["v"] for r in rows], np.float64)
        names = np.array([r["id"] for r in rows])
        if not len(rows):
            continue

        def scan(batches, q=q, names=names):
            best_j, best_id, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            cut = np.full(len(q), np.inf)  # the k-th distance so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                every, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
                for s in range(0, len(every), ROWS):
                    x = every[s : s + ROWS]
                    wide = max(1, TILE // len(x))
                    found = [(best_j, best_id, best_d)]
                    for c in range(0, len(q), wide):
                        some = q[c : c + wide]
                        rough, slack, bound = _distances(x, some, metric), _slack(x, some, metric), cut[c : c + wide]
                        if np.isinf(bound).any() and len(x) > k:
                            bound = np.minimum(bound, _reach(np.partition(rough, k - 1, axis=0)[k - 1], slack, metric))
                        i, j = np.nonzero(rough <= _reach(bound, slack, metric))
                        found.append((j + c, ids[s + i], _exact(x, some, i, j, metric)))
                    j, i, d = (np.concatenate(v) for v in zip(*found))
                    kept = _nearest(j, i, d, k)
                    best_j, best_id, best_d = j[kept], i[kept], d[kept]
                    full = np.flatnonzero(np.bincount(best_j, minlength=len(q)) == k)
                    cut[full] = best_d[np.searchsorted(best_j, full, "right") - 1]
            yield _batch(names[best_j], best_id, best_d)

        part = table.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).where("v is not null").mapInArrow(scan, _HITS)
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c, "l2").argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


class Ivf:
    """An inverted file: each row's list (nearest centroid) and code.

    With ``path`` the lists are written there, a folder each, and a search reads the probed ones only; without
    it each search deals the rows to lists anew. A list may be of any size: rows are dealt to files by list and
    by a hash of the id. An empty table gives an empty index.
    """

    def __init__(self, table: DataFrame, lists: int = 32, code: str = "flat", parts: int = 8, id_column: str = "vec_id", column: str = "embedding", path: str | None = None):
        given = table.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).where("v is not null")
        rows = given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        x = np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 1))
        self.code, self.centroids = code, kmeans(x, lists) if rows else x
        self.low, self.step = (x.min(0), np.maximum((x.max(0) - x.min(0)) / 255, 1e-12)) if rows else (0.0, 1.0)
        self.parts = np.array_split(np.arange(x.shape[1]), parts)
        rest = x - self.centroids[_distances(x, self.centroids, "l2").argmin(1)] if rows else x
        self.books = [kmeans(rest[:, p], 256) for p in self.parts] if code == "pq" and rows else []
        centroids = self.centroids

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _distances(_matrix(batch.column("v")), centroids, "l2").argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("id"), batch.column("v")], names=["list", "id", "v"])

        self.rows = given.mapInArrow(deal, f"list int, id long, v {given.schema['v'].dataType.simpleString()}")
        if path:
            self.rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("list").parquet(path)
            self.rows = table.sparkSession.read.schema(self.rows.schema).parquet(path)

    def approximate(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """What the codes of the rows ``x`` say of them."""
        if self.code == "sq8":
            return self.low + np.clip(np.rint((x - self.low) / self.step), 0, 255) * self.step
        rest = x - self.centroids[near]
        if self.code == "pq":
            out = np.empty_like(x)
            for p, book in zip(self.parts, self.books):
                out[:, p] = book[_distances(rest[:, p], book, "l2").argmin(1)]
            return self.centroids[near] + out
        if self.code == "bits":
            return self.centroids[near] + np.sign(rest) * np.abs(rest).mean(1, keepdims=True)
        return x

    def search(self, queries: DataFrame, k: int, probes: int = 8, metric: str = "l2", keep: int = 4, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
        """query, id, distance and rank: of the nearest lists rank ``keep`` * k of each list and batch by code, these exactly; queries in blocks of ``QUERIES``."""
        given = queries.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).where("v is not null")
        blocks, out = max(1, -(-given.count() // QUERIES)), None
        code = Ivf.__new__(Ivf)
        code.code, code.centroids, code.low, code.step, code.parts, code.books = self.code, self.centroids, self.low, self.step, self.parts, self.books
        for b in range(blocks):
            found = given.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
            if not found or not len(self.centroids):
                continue
            q, names = np.array([r["v"] for r in found], np.float64), np.array([r["id"] for r in found])
            probed = np.zeros((len(q), len(self.centroids)), bool)
            np.put_along_axis(probed, np.argsort(_distances(q, self.centroids, "l2"), axis=1)[:, :probes], True, axis=1)

            def scan(batches, q=q, names=names, probed=probed):
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, ids, near = _matrix(batch.column("v")), batch.column("id").to_numpy(), batch.column("list").to_numpy()
                    for one in np.unique(near):
                        at, asked = np.flatnonzero(near == one), np.flatnonzero(probed[:, one])
                        n, wide = min(keep * k, len(at)), max(1, TILE // len(at))
                        mine = x[at]
                        told = code.approximate(mine, near[at]) if len(asked) else mine
                        for c in range(0, len(asked), wide):
                            some = asked[c : c + wide]
                            rough, slack = _distances(told, q[some], metric), _slack(told, q[some], metric)
                            cut = np.partition(rough, n - 1, axis=0)[n - 1]
                            i, j = np.nonzero(rough <= _reach(cut, slack, metric))
                            d = _exact(mine, q[some], i, j, metric)
                            kept = _nearest(j, ids[at[i]], d, k)
                            yield _batch(names[some[j[kept]]], ids[at[i[kept]]], d[kept])

            wanted = [int(i) for i in np.flatnonzero(probed.any(0))]
            part = self.rows.where(F.col("list").isin(wanted)).mapInArrow(scan, _HITS)
            out = part if out is None else out.unionByName(part)
        return _best(queries.sparkSession.createDataFrame([], _HITS) if out is None else out, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true neighbours that were found."""
    hit = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
