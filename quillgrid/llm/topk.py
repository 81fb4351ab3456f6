"""Exact top-k inner products of integer vectors by pivot-table elimination.

Vectors lie in packed blocks, each with a table of its vectors' distances to the pivots. The triangle inequality gives
|d(q, p) - d(x, p)| <= d(q, x) for each pivot p; the largest of these lower bounds bounds the inner product from above, as
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. A query takes the candidates of a block in the order of their bounds and stops at the first bound
below the k-th best score it has; blocks of one task share that score. Scores are exact integers; ties go to the smaller vec_id.

Queries are a stated set; they are sent in waves of about `wave`, each bounded in size and a job of its own, and every wave meets all blocks.
Neither the driver nor a task holds more than one wave, and a task keeps k results a query. The distances are rounded, so bounds have a margin and never eliminate wrongly.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor does a null vec_id; vectors of different
lengths never meet; rows that repeat a vec_id are candidates each, except for the query with that id, of which the least vector asks; scores
beyond 64 bits are cut to them; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import PACKS, checkpointed, rows

PIVOTS = 32
BLOCK = 8192
WAVE = 8192


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(length, rows, integer matrix) for each length of valid vectors."""
    size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    value = np.floor(np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64) * scale)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
    end = np.cumsum(size)
    good = (size > 0) & (bad[end] == bad[end - size])
    out = []
    for n in np.unique(size[good]).tolist():
        own = np.flatnonzero(good & (size == n))
        out.append((n, own, value[(end - size)[own][:, None] + np.arange(n)]))
    return size, out


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows with q, within 64 bits."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.abs(x).max() * max(1.0, np.abs(q).max()) * x.shape[1] < 2.0**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row.tolist(), q.tolist())) for row in x]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


class Queries:
    """One wave of queries of one length, with the best results so far."""

    def __init__(self, ids: list[int], vectors: np.ndarray, pivots: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.square = (vectors * vectors).sum(1)
        self.table = distances(vectors, pivots)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        square = (x * x).sum(1)
        norm = np.sqrt(square)
        for i, own in enumerate(self.ids):
            low = np.abs(table - self.table[i]).max(1) if table.shape[1] else np.zeros(len(x))
            reach = norm + np.sqrt(self.square[i])
            low = np.maximum(0, low - 1e-9 * (reach + 1))
            bound = (self.square[i] + square - low * low) / 2
            bound += 1e-9 * np.abs(bound) + 1e-9 * (square + self.square[i]) + 1
            best = self.best[i]
            done, step = 0, 256
            order = np.argsort(-bound)
            while done < len(order):
                if len(best) == self.k and bound[order[done]] < best[-1][0]:
                    break
                take = order[done : done + step]
                if len(best) == self.k:
                    take = take[bound[take] >= best[-1][0]]
                take = take[ids[take] != own]
                score = dots(x[take], self.vectors[i])
                top = np.lexsort((ids[take], -score))[: self.k]
                best += zip(score[top].tolist(), ids[take][top].tolist())
                best.sort(key=lambda s: (-s[0], s[1]))
                del best[self.k :]
                done += step
                step *= 4


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1))) if len(pivots) else np.zeros((len(x), 0))


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that satisfies is_query (a condition on vec_id)."""
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    chosen = [r[0] for r in base.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(pivots).select("vector").collect()]
    by_size: dict[int, np.ndarray] = {}
    for v in chosen:
        by_size.setdefault(len(v), []).append(np.floor(np.array(v) * scale))
    by_size = {n: np.array(p) for n, p in by_size.items()}

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                for n, own, x in integers(part.column("vector"), scale)[1]:
                    table = distances(x, by_size.get(n, np.zeros((0, n))))
                    yield rows([(0, n, 0, struct.pack("<ii", len(own), table.shape[1]) + ids[own].tobytes() + x.tobytes() + table.tobytes())])

    blocks = checkpointed(base.mapInArrow(block, PACKS))
    asked = base.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_waves = max(1, -(-asked.count() // wave))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(w: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_waves)) == w).orderBy("vec_id").collect()
        found = blocks.mapInArrow(_search([(r[0], r[1]) for r in own], by_size, k, scale), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if n_waves == 1:
        return searched(0)
    out = None
    for w in range(n_waves):  # a job a wave: what stays of it is a checkpoint of k rows a query
        found = checkpointed(searched(w))
        out = found if out is None else out.unionAll(found)
    return out


def _search(queries: list[tuple[int, list[float]]], pivots: dict[int, np.ndarray], k: int, scale: float):
    sizes: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in queries:
        ids, vs = sizes.setdefault(len(v), ([], []))
        ids.append(i)
        vs.append(np.floor(np.array(v) * scale))
    packed = {n: (ids, np.array(vs)) for n, (ids, vs) in sizes.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {n: Queries(ids, vs, pivots.get(n, np.zeros((0, n))), k) for n, (ids, vs) in packed.items()}
        for batch in batches:
            for n, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
                if n in asked:
                    m, p = struct.unpack_from("<ii", blob)
                    ids = np.frombuffer(blob, np.int64, m, 8)
                    x = np.frombuffer(blob, np.float64, m * n, 8 + 8 * m).reshape(m, n)
                    asked[n].meet(ids, x, np.frombuffer(blob, np.float64, m * p, 8 + 8 * m * (1 + n)).reshape(m, p))
        got = [(own, i, s) for q in asked.values() for own, best in zip(q.ids, q.best) for s, i in best]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["query_id", "vec_id", "score"])

    return run
