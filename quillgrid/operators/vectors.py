"""Dense vectors: similarity, filters, fingerprints and a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from . import ledger, scan
from .search import top


class Embedder(Protocol):
    """Turns a batch of texts into vectors of one length; loaded once a worker."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _place(term: str, size: int) -> tuple[int, float]:
    h = hashlib.md5(term.encode()).hexdigest()
    return int(h[:8], 16) % size, 1.0 if h[8] < "8" else -1.0


def hashed(docs: DataFrame, key: list[str], text: Column, size: int = 64, keep: list[str] | None = None) -> DataFrame:
    """(key, vector, columns to keep): the default embedding without a model, term counts by position and sign from the term's MD5, at length one.

    A document's terms are summed in its own task; each distinct term of a batch is hashed once.
    """
    own = docs.select(*key, T.tokens(F.coalesce(text, F.lit(""))).alias("terms"), *(keep or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.slices(batches):
            n = np.asarray(batch.column("terms").value_lengths())
            codes = batch.column("terms").flatten().dictionary_encode()
            at, sign = np.array([_place(t, size) for t in codes.dictionary.to_pylist()]).reshape(-1, 2).T
            code = codes.indices.to_numpy(zero_copy_only=False)
            w = np.bincount(np.repeat(np.arange(len(n)), n) * size + at[code].astype(np.int64), sign[code], len(n) * size).reshape(len(n), size)
            norm = np.sqrt((w * w).sum(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array((w / np.where(norm > 0, norm, 1.0)[:, None]).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), lists, *(batch.column(c) for c in keep or [])], [*key, "vector", *(keep or [])])

    schema = StructType([*(docs.schema[c] for c in key), StructField("vector", ArrayType(DoubleType())), *(docs.schema[c] for c in keep or [])])
    return own.mapInArrow(run, schema)


def embedded(docs: DataFrame, key: list[str], text: Column, embedder: Embedder | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, vector, columns to keep): a unit vector of the text, by the embedder or by hashed terms."""
    if embedder is None:
        return hashed(docs, key, text, keep=keep)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield embedder(texts)

    return docs.select(*key, unit(run(text)).alias("vector"), *(keep or []))


def written(docs: DataFrame, key: list[str], text: Column, path: str, embedder: Embedder | None = None, parts: int = 16, after: Callable[[int], None] | None = None) -> DataFrame:
    """The vectors of docs at path, made in parts by hash of the key; what an earlier run wrote is kept, and rows that are gone or whose text changed go.

    Each part is a directory of its own, written whole: a run that is cut off goes on with the next one. Keys have to be unique; nothing to embed is an
    error. after(part) is called when a part is there.
    """
    spark = docs.sparkSession
    own = docs.select(*key, text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("of"), F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part"))
    counts = {r.part: (r.n, r.h) for r in own.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*key, "of").cast("decimal(38,0)")).cast("string").alias("h")).collect()}
    if not counts:
        raise ValueError("nothing to embed")
    for part, (n, h) in sorted(counts.items()):
        home = f"{path}/of={parts}/part={part}"
        if ledger.exists(spark, f"{home}/_of.json") and ledger.load(spark, f"{home}/_of.json") == {"n": n, "h": h}:
            continue
        here = own.where(F.col("part") == part)
        vectors = embedded(here, key, F.col("text"), embedder)
        vectors.write.mode("overwrite").parquet(home)
        if (found := spark.read.parquet(home).count()) != n:
            raise RuntimeError(f"{home} has {found} vectors, not {n}")
        ledger.save(spark, f"{home}/_of.json", {"n": n, "h": h})
        if after:
            after(part)
    return spark.read.option("basePath", f"{path}/of={parts}").parquet(*(f"{path}/of={parts}/part={p}" for p in sorted(counts))).drop("part")


def card_text(title: Column, family: Column, catalog: Column) -> Column:
    return F.concat_ws(" | ", title, family, F.substring(catalog, 1, 1200))


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str | list[str] = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rank): cosine of unit vectors for a few given queries; the queries are literals of the plan."""
    key = [key] if isinstance(key, str) else key
    asked = F.array(*(F.struct(F.lit(i).cast("long").alias("qid"), F.array(*map(F.lit, v)).cast("array<double>").alias("q")) for i, v in queries))
    scored = vectors.select(*key, F.col(vector).alias("v"), F.explode(asked).alias("a")).select("a.qid", *key, dot(F.col("v"), F.col("a.q")).alias("score"))
    return top(scored, k, key)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct vector, and which of them each row is."""
    plain = np.ascontiguousarray(x)
    _, first, of = np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, of.ravel()


def best_of(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, rows: int = 512, chunk: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score): the k best of v for each q, ties of scores rounded to nine digits by id.

    Products in single precision find what can be among the best, within the bound of their error; what is kept has exact scores.
    Of equal vectors the k least ids are looked at, as no others can be among the best.
    """
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    same = np.argsort(_distinct(v)[1], kind="stable")
    of = _distinct(v)[1][same]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    keep = np.sort(same[np.arange(len(of)) - np.repeat(head, np.diff(np.append(head, len(of)))) < k])
    ids, v = ids[keep], v[keep]
    small = bool(np.isfinite(q).all() and np.isfinite(v).all() and max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) < 1e15)
    q_, v_ = (q.astype(np.float32), v.astype(np.float32)) if small else (q, v)
    error = (q.shape[1] + 8) * 2.0**-22 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max(initial=0)) + 2e-9
    out = []
    for a in range(0, len(q), rows):
        own, off = q[a : a + rows], error[a : a + rows]
        least = np.full(len(own), -np.inf)
        i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(v), chunk):
            score = q_[a : a + rows] @ v_[b : b + chunk].T
            if not b and score.shape[1] > k:
                least = np.partition(score, -k, axis=1)[:, -k].astype(np.float64) - off
            floor = (least - off).astype(score.dtype)
            x, y = np.nonzero(~(score < np.nextafter(floor, floor.dtype.type(-np.inf))[:, None]))
            i, j = np.concatenate([i, x]), np.concatenate([j, y + b])
            s = np.concatenate([s, np.einsum("ij,ij->i", own[x], v[y + b])])
            order = np.lexsort((ids[j], -np.round(s, 9), i))
            i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[place == k - 1]] = s[place == k - 1]
            i, j, s = i[place < k], j[place < k], s[place < k]
        out.append((i + a, ids[j], s))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), ids[:0], np.zeros(0))


def _grid(n: int, m: int, least: int, block: int, small: int = 1024) -> tuple[int, int]:
    """Into how many blocks n queries and m vectors are dealt: blocks of `block` rows, or less, for `least` pairs of blocks if there are rows enough."""
    a, b = max(1, -(-n // block)), max(1, -(-m // block))
    while a * b < least and max(n / a, m / b) > small:
        a, b = (a + 1, b) if n / a > m / b else (a, b + 1)
    return a, b


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 65536) -> DataFrame:
    """(qid, key, score, rank): cosine of unit vectors for every row of queries(qid, q).

    Both tables are dealt into blocks by hash, each of `block` rows at most, about; each block of queries meets each block of vectors once, in a task
    that returns the k best of each query there. All products are made, so time grows with the product of the tables; what is sent is each table
    once for each block of the other, and a task holds two blocks.
    """
    rows = lambda df, i, v: df.select(F.col(i).cast("long").alias("i"), F.col(v).alias("v")).where("i is not null and v is not null")
    asked, own = rows(queries, "qid", "q"), rows(vectors, key, vector)
    n, m = _grid(asked.count(), own.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism, block)
    at = lambda parts: F.pmod(F.xxhash64("i"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = asked.select("i", "v", at(n).alias("a"), every(m).alias("b")).withColumn("pair", F.col("a") * m + F.col("b"))
    own = own.select("i", "v", every(n).alias("a"), at(m).alias("b")).withColumn("pair", F.col("a") * m + F.col("b"))

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        def plain(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            v = t["v"].combine_chunks()
            v = v if isinstance(v, pa.Array) else v.chunk(0)
            return t["i"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)

        none = np.zeros(0, np.int64)
        if not asked.num_rows or not own.num_rows:
            cols = [none, none, np.zeros(0)]
        else:
            (qids, q), (ids, v) = plain(asked), plain(own)
            first, of = _distinct(q)
            row, found, score = best_of(q[first], ids, v, k)
            start, end = np.searchsorted(row, of), np.searchsorted(row, of, "right")  # equal queries share an answer
            take = np.concatenate([np.arange(s, e) for s, e in zip(start, end)])
            cols = [np.repeat(qids, end - start), found[take], score[take]]
        return pa.table({"qid": pa.array(cols[0], pa.int64()), key: pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    dealt = lambda df: df.select("pair", "i", "v").repartition(n * m, "pair").groupBy("pair")
    return top(dealt(asked).cogroup(dealt(own)).applyInArrow(run, f"qid long, `{key}` long, score double"), k, [key])


def above_median(scores: DataFrame, by: list[str], key: str, score: str = "score", always: int = 3) -> DataFrame:
    """Rows at or above their group's median score, and the best few in any case."""
    group = Window.partitionBy(*by)
    own = scores.withColumn("median", F.percentile(score, 0.5).over(group)).withColumn("place", F.row_number().over(group.orderBy(F.desc(score), key)))
    return own.where((F.col(score) >= F.col("median")) | (F.col("place") <= always)).drop("place")


def fingerprint(vector: Column, digits: int = 3) -> Column:
    """sha256 of the rounded components."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: F.format_string("%.3f", F.round(x.cast("double"), digits) + F.lit(0.0))), ","), 256)
