"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, chosen
from .vectors import matrix, unit, usable


@dataclass
class Index:
    """centroids: cells x d; books: parts x codes x d / parts; probes: cells that a query looks into;
    keep: rows by code whose exact products set the bound of the rerank."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    keep: int


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, in no order."""
    d = (c * c).sum(1)[None] - 2 * x @ c.T
    return np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)


def codes_of(x: np.ndarray, cell: np.ndarray, index: Index) -> np.ndarray:
    parts, _, width = index.books.shape
    r = (x - index.centroids[cell]).reshape(len(x), parts, width)
    out = np.empty((len(x), parts), np.uint8)
    for j in range(parts):
        b = index.books[j]
        out[:, j] = np.argmin((b * b).sum(1)[None] - 2 * r[:, j] @ b.T, axis=1)
    return out


def approximate(q: np.ndarray, cell: int, codes: np.ndarray, index: Index) -> np.ndarray:
    """Inner products of unit queries with a cell's coded rows: that of the centroid plus a table look-up a part."""
    parts, _, width = index.books.shape
    table = np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), index.books)
    out = np.repeat((q @ index.centroids[cell])[:, None], len(codes), 1)
    for j in range(parts):
        out += table[:, j, :][:, codes[:, j]]
    return out


def decoded(cell: int, codes: np.ndarray, index: Index) -> np.ndarray:
    """What the codes of a cell's rows stand for."""
    return index.centroids[cell] + np.concatenate([index.books[j][codes[:, j]] for j in range(len(index.books))], axis=1)


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, near: np.ndarray, error: np.ndarray, k: int, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k rows of the largest inner products, own ids left out, and these products.

    near: products with the rows' codes; error: how far each row is from its code, the most by which a
    product with a unit query can differ. The rows of the `keep` best codes are compared first; every row
    that by its error can still reach their k-th is compared too, so no near row is lost to its code."""
    slack, out = 1e-9, []
    near = np.where(own[:, None] == ids[None], -9.0, near)
    keep = min(max(keep, k), len(ids))
    best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
    first = np.einsum("qd,qkd->qk", q, x[best])
    first[np.take_along_axis(near, best, 1) <= -9] = -9
    least = -np.partition(-first, k - 1, axis=1)[:, k - 1] if keep >= k else np.full(len(q), -9.0)
    may = (near > -9) & (near + error >= least[:, None] - slack)
    rows = np.flatnonzero(may.any(axis=0))
    score = np.where(may[:, rows], q @ x[rows].T, -9.0)
    if len(rows) > k:
        least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
    for i in range(len(q)):
        at = rows[(score[i] > -9) & (score[i] >= least[i] - slack)]
        value = np.einsum("d,kd->k", q[i], x[at])
        order = np.lexsort((ids[at], -value))[:k]
        out.append((at[order], value[order]))
    return out


def train(vectors: DataFrame, k: int, sample: int = 12_000, most_cells: int = 4096, parts: int = 16, goal: float = 0.95, seed: int = 5) -> Index | None:
    """An index model of as many cells as the root of the number of vectors (16 at least, most_cells at most), so that what a
    query reads grows slower than the table. Trained on about `sample` vectors, or 32 a cell if those are more, chosen by a hash
    of their id and put in order: the bound on what training reads. Probes are the least, and some more, for which rows of the sample find `goal` of their
    k nearest, by brute force over the sample. Each quarter of the asked rows, by the product with their
    k-th nearest, must reach the goal, so that rows in dense groups are not outvoted by the others."""
    n = vectors.count()
    if not n:
        return None
    cells = min(most_cells, max(16, int(n**0.5)))
    read = lambda rows: matrix(rows.orderBy("vec_id", "v").select("v").toArrow().column("v"))
    x = read(vectors.where(chosen(F.col("vec_id"), max(sample, 32 * cells) / n, 11)))
    if not len(x):
        x = read(vectors.orderBy("vec_id", "v").limit(256))
    x, rng = unit(x), np.random.default_rng(seed)
    d = x.shape[1]
    parts = next(p for p in range(min(parts, d), 0, -1) if d % p == 0)
    centroids = kmeans(x, cells, 8, rng)
    near = cells_of(x, centroids, 1)[:, 0]
    r = (x - centroids[near]).reshape(len(x), parts, d // parts)
    books = [kmeans(r[:, j], 256, 6, rng) for j in range(parts)]
    width = max(len(b) for b in books)
    index = Index(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], width - len(b), 0)]) for b in books]), len(centroids), 4 * k)
    # the audit: exact neighbours of some rows in the sample, and how deep their cells lie
    asked = rng.choice(len(x), min(len(x), 1000), replace=False)
    depth, kth = [], []
    for at in range(0, len(asked), 250):
        rows = asked[at : at + 250]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -9
        best = np.argsort(-s, axis=1)[:, :k]
        order = np.argsort((centroids * centroids).sum(1)[None] - 2 * x[rows] @ centroids.T, axis=1)
        depth.append(np.argmax(order[:, :, None] == near[best][:, None, :], axis=1))
        kth.append(np.take_along_axis(s, best[:, -1:], 1)[:, 0])
    depth = np.concatenate(depth)[np.argsort(np.concatenate(kth))]
    deepest = max(np.quantile(part, goal) for part in np.array_split(depth, 4) if len(part))
    index.probes = int(min(len(centroids), deepest + 1 + len(centroids) // 16))
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int, index: Index, part_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, the query's own id left out.

    Every vector is dealt to its cell, and each cell to parts of about part_rows rows by a hash, so that
    a cell of a third of all rows is many groups; queries go to the parts of the cells they look into,
    in blocks. Each group ranks its rows by code for each query, compares exactly all that the error of their codes
    lets be among the best, and gives k rows a query at most."""
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(index)
    scratch = Scratch(spark, "ann")
    d = index.centroids.shape[1]

    def assign(batches):
        for pdf in batches:
            x = unit(np.stack(pdf["v"].to_numpy())) if len(pdf) else np.zeros((0, d))
            m = model.value
            cell = cells_of(x, m.centroids, 1)[:, 0] if len(x) else np.zeros(0, int)
            codes = codes_of(x, cell, m) if len(x) else []
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    def probe(batches):
        for pdf in batches:
            m = model.value
            if len(pdf):
                cells = cells_of(unit(np.stack(pdf["v"].to_numpy())), m.centroids, m.probes)
                yield pd.DataFrame({"query_id": pdf["vec_id"], "q": pdf["v"], "cells": [c.astype(np.int32) for c in cells]})

    coded = scratch.table(vectors.mapInPandas(assign, "vec_id long, v array<double>, cell int, codes binary"), "coded")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("cell") / part_rows).cast("int").alias("parts"))  # a row a cell
    rows = coded.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    asked = queries.mapInPandas(probe, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(sizes), "cell").select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    schema = "query_id long, vec_id long, score double"

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        m, ids, out = model.value, left["vec_id"].to_numpy(), []
        raw = np.stack(left["v"].to_numpy())
        x, codes = unit(raw), np.stack([np.frombuffer(c, np.uint8) for c in left["codes"]])
        cell = int(left["cell"].iloc[0])
        error = np.sqrt(((x - decoded(cell, codes, m)) ** 2).sum(axis=1))
        for at in range(0, len(right), 256):
            block = right.iloc[at : at + 256]
            q, own = unit(np.stack(block["q"].to_numpy())), block["query_id"].to_numpy()
            for i, (rows, score) in enumerate(nearest(q, own, x, ids, approximate(q, cell, codes, m), error, k, m.keep)):
                out.append((np.full(len(rows), own[i]), ids[rows], score))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": np.clip(s, -1.0, 1.0)})

    found = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(group, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50, against all vectors; ties go to the smaller vec_id. Vectors that
    take no part are neither asked nor found; vectors of different lengths don't meet; rows that repeat a vec_id are rows of
    their own, and none of the query's own id is found; an empty table gives no rows."""
    every = usable(embeddings)
    lengths = sorted(r.d for r in every.select(F.size("v").alias("d")).distinct().collect())  # a few models' dimensions
    out = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, d in enumerate(lengths):
        vectors = every.where(F.size("v") == d)
        found = search(vectors, vectors.where("vec_id % 50 = 0"), k, train(vectors, k))
        out = out.unionByName(found) if i else found
    return out
