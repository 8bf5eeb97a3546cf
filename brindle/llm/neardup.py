"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard queried
by every vector with beams that widen until audits pass, cosine verified, components united."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .graph import components
from .vectors import unit, usable

#: Links that a node chooses in an upper layer (twice that in the lowest), and the least beam.
LINKS, BEAM = 8, 24
#: Rows that an audit asks at most, and the widest beam that it tries before a shard is compared row by row.
ASKED, TRIED = 2048, 4 * BEAM
#: By how much a product of unit rows in single precision can be off.
OFF = 4e-5


def choose(near: np.ndarray, value: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """(rows x links) of candidates near (rows x wide, -1 for none) with products value: nearest first, one only if it
    is nearer to the row than to all chosen before; the nearest others fill up."""
    order = np.argsort(-value, axis=1, kind="stable")
    near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
    each = x[near]
    between = each @ each.transpose(0, 2, 1)
    taken, n_taken = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for j in range(near.shape[1]):
        clear = (np.where(taken, between[:, j], -9).max(axis=1) < value[:, j]) & (n_taken < links - links // 3) & (near[:, j] >= 0)
        taken[:, j] = clear
        n_taken += clear
    rank = np.argsort(~taken, axis=1, kind="stable")[:, :links]
    out = np.full((len(near), links), -1, np.int32)
    out[:, : rank.shape[1]] = np.take_along_axis(near, rank, 1)
    return out


def link_back(out: np.ndarray, new: np.ndarray, links: int, x: np.ndarray) -> None:
    """Gives the rows that the new ones have chosen a link back, in the second half of out's columns; where it is full,
    choose() picks among the old and the new."""
    a, b = np.repeat(new, links), out[new, :links].ravel()
    a, b = a[b >= 0], b[b >= 0]
    fresh = ~(out[b, :links] == a[:, None]).any(axis=1)
    a, b = a[fresh], b[fresh]
    if not len(a):
        return
    order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), b))
    a, b = a[order], b[order]
    node, first, n = np.unique(b, return_index=True, return_counts=True)
    rank, own = np.arange(len(b)) - np.repeat(first, n), np.repeat(np.arange(len(node)), n)
    for lo in range(0, len(node), 2048):
        part = node[lo : lo + 2048]
        mine = (own >= lo) & (own < lo + len(part)) & (rank < 2 * links)
        more = np.full((len(part), min(int(n[lo : lo + len(part)].max()), 2 * links)), -1, np.int32)
        more[own[mine] - lo, rank[mine]] = a[mine]
        every = np.concatenate([out[part, links:], more], 1)
        value = np.where(every >= 0, np.einsum("rd,rkd->rk", x[part], x[every]), -9)
        out[part, links:] = choose(every, value, x, links)


def grow(x: np.ndarray, n: int, links: int, upper: list[np.ndarray]) -> np.ndarray:
    """The layer of the first n rows, below the layers of `upper`: (n x 2 links), own links and links back. Rows come
    in batches: each looks for its nearest by the graph of those before, and in its own batch directly."""
    out, at = np.full((n, 2 * links), -1, np.int32), 0
    first = max(256, len(upper[-1]) if upper else 0)
    while at < n:
        end = min(n, first if not at else at + min(1024, at))
        new, k = np.arange(at, end), min(end - at - 1, 2 * links)
        near, value = np.full((len(new), max(k, 1)), -1), np.full((len(new), max(k, 1)), -9.0, np.float32)
        for lo in range(0, len(new) if k else 0, 1024):
            s = x[new[lo : lo + 1024]] @ x[at:end].T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -9
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            near[lo : lo + len(s)], value[lo : lo + len(s)] = best + at, np.take_along_axis(s, best, 1)
        if at:
            step = max(64, (1 << 24) // at)
            found = [search(x[new[lo : lo + step]], x, [*upper, out[:at]], 2 * links) for lo in range(0, len(new), step)]
            near, value = np.concatenate([near, np.concatenate([f[0] for f in found])], 1), np.concatenate([value, np.concatenate([f[1] for f in found])], 1)
        for lo in range(0, len(new), 1024):
            out[new[lo : lo + 1024], :links] = choose(near[lo : lo + 1024], value[lo : lo + 1024], x, links)
        link_back(out, new, links, x)
        at = end
    return out


def build(x: np.ndarray) -> list[np.ndarray]:
    """Layers of a graph over unit rows in random order, highest first: each (nodes x links) holds row numbers, -1
    for none; a layer's nodes are the first rows of the one below, one of 2 LINKS of them."""
    x = x.astype(np.float32)
    sizes = [len(x)]
    while sizes[-1] > 8 * LINKS:
        sizes.append(sizes[-1] // (2 * LINKS) + 1)
    layers: list[np.ndarray] = []
    for n in reversed(sizes):
        layers.append(grow(x, n, LINKS * (2 if n == len(x) else 1), layers))
    return layers


def search(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` best rows found for each query and their products, best first; -1 where fewer are found.
    All queries walk in step: each opens its best unopened row until its beam holds none."""
    ids, value = np.zeros((len(q), 1), np.int32), (q @ x[0])[:, None]
    for depth, links in enumerate(layers):
        width = min(beam, len(links)) if depth == len(layers) - 1 else 1
        seen = np.zeros((len(q), len(links) + 1), bool)  # the last column stands for none
        seen[np.arange(len(q)), ids[:, 0]] = True
        ids, value = np.pad(ids[:, :1], ((0, 0), (0, width - 1)), constant_values=-1), np.pad(value[:, :1], ((0, 0), (0, width - 1)), constant_values=-9.0)
        opened, active = ids < 0, np.arange(len(q))
        while len(active):
            go = np.argmin(opened[active], axis=1)
            has = ~opened[active, go]
            active, go = active[has], go[has]
            if not len(active):
                break
            opened[active, go] = True
            new = links[ids[active, go]]
            r, k = np.nonzero((new >= 0) & ~seen[active[:, None], new])
            to = new[r, k]
            seen[active[r], to] = True
            near = np.full(new.shape, -9.0, np.float32)
            near[r, k] = np.einsum("nd,nd->n", q[active[r]], x[to])
            better = near > value[active, -1:]
            some = better.any(axis=1)
            if not some.any():
                continue
            at, near, new = active[some], np.where(better, near, -9.0)[some], new[some]
            every = np.concatenate([value[at], near], 1)
            order = np.argsort(-every, axis=1)[:, :width]
            value[at] = np.take_along_axis(every, order, 1)
            ids[at] = np.take_along_axis(np.concatenate([ids[at], np.where(near > -9, new, -1)], 1), order, 1)
            opened[at] = np.take_along_axis(np.concatenate([opened[at], near <= -9], 1), order, 1)
    return ids, value


def _exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose product in double precision is `least` or more, given that in single precision."""
    keep, edge = value >= least, np.flatnonzero(np.abs(value - least) <= OFF)
    keep[edge] = np.einsum("nd,nd->n", q[a[edge]], x[b[edge]]) >= least
    return a[keep], b[keep]


def parts(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray], least: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of those found with cosine >= least, each once, in parts of bounded size. A query whose beam holds
    nothing but such rows stands in a crowd: it is compared with every row."""
    few, every = q.astype(np.float32), x.astype(np.float32)
    crowd = [np.arange(len(q))] if beam >= len(x) else [np.zeros(0, np.int64)]
    if beam < len(x):
        step = max(64, (1 << 24) // len(x))
        for at in range(0, len(q), step):
            ids, value = search(few[at : at + step], every, layers, beam)
            full = value[:, -1] >= least - OFF
            crowd.append(at + np.flatnonzero(full))
            i, j = np.nonzero((value >= least - OFF) & ~full[:, None])
            yield _exact(q, x, at + i, ids[i, j], value[i, j], least)
    crowd = np.concatenate(crowd)
    step = max(16, (1 << 22) // max(1, len(x)))
    for at in range(0, len(crowd), step):
        part = crowd[at : at + step]
        s = few[part] @ every.T
        i, j = np.nonzero(s >= least - OFF)
        yield _exact(q, x, part[i], j, s[i, j], least)


def within(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray], least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """All of parts() at once."""
    found = [(np.zeros(0, np.int64),) * 2, *parts(q, x, layers, least, beam)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def audited(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, layers: list[np.ndarray], least: float, goal: float, rng: np.random.Generator) -> int:
    """The least beam whose recall on some of the queries, against brute force, is `goal`; len(x), with which
    within() compares every row, where none of up to TRIED is enough.

    Each asked row with a true partner of another id counts once, by the share of its partners found.
    Rows of up to BEAM partners and those of more must each reach the goal, so that a large group
    can't hide what is lost outside it."""
    asked = rng.choice(len(q), min(ASKED, len(q)), replace=False)
    true = np.zeros(len(asked), np.int64)
    for at in range(0, len(asked), 512):
        rows = asked[at : at + 512]
        true[at : at + 512] = ((q[rows] @ x.T >= least) & (own[rows][:, None] != ids[None])).sum(axis=1)
    asked, true = asked[true > 0], true[true > 0]
    few, beam = true <= BEAM, BEAM
    while len(asked) and beam < len(x):
        a, b = within(q[asked], x, layers, least, beam)
        share = np.bincount(a[own[asked][a] != ids[b]], minlength=len(asked)) / true
        if all(share[part].mean() >= goal for part in (few, ~few) if part.any()):
            break
        beam = beam * 2 if beam * 2 <= TRIED else len(x)
    return beam


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (of each vertex the least of its component so far) after the edges a - b."""
    while len(a):
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            break
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new
    return label


def near_duplicates(embeddings: DataFrame, least: float = 0.9, shard_rows: int = 1 << 17, block_rows: int = 1 << 16, goal: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Vectors of cosine >= least link; those that are
    null, empty, zero or hold null or non-finite components link with nothing and keep themselves, and
    vectors of different lengths don't link. n_links counts other rows. Equal vectors fall together first and count with their number.

    Shards of up to shard_rows vectors, six at least, get a graph each; blocks of up to about block_rows vectors query every
    shard, each a group of its own. A group gives a query's number of links, and of the rows of either side that link an edge
    each to the least of those that they are connected with, never all pairs. Rows that repeat a vec_id are one vertex
    each for links, and one for components. A null vec_id gives a row of no links and null component. An empty table gives no rows."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hnsw")
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    fine = usable(embeddings)
    alike = scratch.table(fine.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("v").alias("copies")), "alike")
    n = alike.count()
    shards, blocks = max(6, -(-n // shard_rows)), max(1, -(-n // block_rows))
    heads = alike.select("id", "copies", "v", F.size("v").alias("d"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).cast("int").alias("block"))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf["shard"].iloc[0]))
        pdf = pdf.sort_values("id", kind="stable").iloc[rng.permutation(len(pdf))]
        x = unit(np.stack(pdf["v"].to_numpy()))
        out = io.BytesIO()
        np.savez(out, x=x, ids=pdf["id"].to_numpy(), copies=pdf["copies"].to_numpy(), **{f"layer{i}": y for i, y in enumerate(build(x))})
        return pd.DataFrame({"d": [pdf["d"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [out.getvalue()]})

    graphs = scratch.table(heads.select("id", "copies", "v", "d", "shard").groupBy("d", "shard").applyInPandas(index, "d int, shard int, graph binary"), "graphs")

    def query(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        g = np.load(io.BytesIO(right["graph"].iloc[0]))
        layers = [g[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in g.files))]
        x, ids, copies = g["x"], g["ids"], g["copies"]
        q, own = unit(np.stack(left["v"].to_numpy())), left["id"].to_numpy()
        beam = audited(q, own, x, ids, layers, least, goal, np.random.default_rng(0))
        links, label, met = np.zeros(len(q), np.int64), np.arange(len(q) + len(x)), np.zeros(len(q) + len(x), bool)
        for a, b in parts(q, x, layers, least, beam):
            other = own[a] != ids[b]
            a, b = a[other], b[other]
            links += np.bincount(a, copies[b], len(q)).astype(np.int64)
            label = _united(label, a, len(q) + b)
            met[a] = met[len(q) + b] = True
        names, low = np.concatenate([own, ids]), np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(low, label, names)
        n, to = np.concatenate([links, np.zeros(len(x), np.int64)]), low[label]
        keep = met & ((n > 0) | (names != to))
        return pd.DataFrame({"id": names[keep], "n": n[keep], "to": to[keep]})

    asked = heads.select("id", "v", "d", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = graphs.select("d", "shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = asked.groupBy("d", "shard", "block").cogroup(held.groupBy("d", "shard", "block")).applyInPandas(query, "id long, n long, to long")
    found = scratch.table(found, "found")
    scratch.drop(graphs)
    release(spark)
    groups = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = alike.join(links, "id", "left").join(groups, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    member = fine.join(named, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(member, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(embeddings: DataFrame) -> DataFrame:
    """Every vector's links, component and whether it stays."""
    return near_duplicates(embeddings)
