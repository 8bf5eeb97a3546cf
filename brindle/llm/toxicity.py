"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed letter n-grams within words is trained with numpy from confirmed toxic
texts (P) and unlabelled ones (U). Its risk for the class prior r is r * loss(P, +) plus the larger of 0
and loss(U, -) - r * loss(P, -); where the latter falls below 0 the step goes against it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import spread
from .common import chosen, held_out, widened
from .shingles import BASE, INVERSE, U, mix
from .tokens import forget, gather, groups

#: Hash bits, letters of an n-gram, features at most, and a feature's least gain in standard deviations.
BITS, GRAMS, MOST, LEAST = 20, (3, 4, 5, 6, 7), 6000, 4.0


def grams(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all chunks' words (lower case; with the boundary on either side), and the number of each chunk."""
    data = ("\n" + "\n".join(chunks) + "\n").lower().encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    edge = (b < 128) & ~((b >= 97) & (b <= 122))
    row = np.cumsum(b == 10) - 1
    code = np.where(edge, 0, b).astype(U) + U(1)
    inner = np.concatenate([[0], np.cumsum(edge)])
    found, owner = [], []
    with np.errstate(over="ignore"):
        # windows within the array: prefix sums of powers, as for word hashes
        power = np.cumprod(np.concatenate([[U(1)], np.full(len(b) - 1, BASE)]), dtype=U)
        back = np.cumprod(np.concatenate([[U(1)], np.full(len(b) - 1, INVERSE)]), dtype=U)
        total = np.concatenate([[U(0)], np.cumsum(code * power, dtype=U)])
        for n in GRAMS:
            at = np.arange(max(0, len(b) - n + 1))
            at = at[inner[at + n - 1] - inner[at + 1] == 0]
            h = mix((total[at + n] - total[at]) * back[at] + U(n))
            found.append((h >> U(64 - BITS)).astype(np.int32))
            owner.append(row[at + 1])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner[order].clip(0), minlength=len(chunks))[: len(chunks)]


class Features:
    """The distinct features of texts; chosen: feature -> its number, or -1."""

    def __init__(self, chosen: np.ndarray | None = None, most: int = 100_000):
        self.chosen, self.most, self.cache = chosen, most, {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of each text, and the text of each."""
        chunks, place, ends = spread(texts)
        if len(self.cache) + len(chunks) > self.most // (1 if self.chosen is not None else 8):
            self.cache = {}
        new = [c for c in chunks if c not in self.cache]
        for i in range(0, len(new), 30_000):
            part = new[i : i + 30_000]
            found, n = grams(part)
            if self.chosen is not None:
                own = np.repeat(np.arange(len(part)), n)
                found = self.chosen[found]
                n = np.bincount(own[found >= 0], minlength=len(part))
                found = found[found >= 0]
            data, stop = found.astype("<i4").tobytes(), np.cumsum(n) * 4
            for c, x, y in zip(part, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
                self.cache[c] = data[x:y]
        values = [self.cache[c] for c in chunks]
        each = np.array([len(v) >> 2 for v in values], np.int64)
        used = each[place] > 0 if len(place) else np.zeros(0, bool)
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        flat, _ = gather(np.frombuffer(b"".join(values), "<i4"), (np.cumsum(each) - each)[place[used]], each[place[used]])
        key = np.unique((np.repeat(text[used], each[place[used]]).astype(np.int64) << 32) | flat)
        return key & 0xFFFFFFFF, key >> 32


def fit(owner: np.ndarray, feature: np.ndarray, toxic: np.ndarray, prior: float, width: int, rounds: int = 250, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk. toxic: of each text, True for P, False for U."""
    w, bias, m, v = np.zeros(width + 1), 0.0, np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    n_p, n_u = max(1, toxic.sum()), max(1, (~toxic).sum())
    for t in range(1, rounds + 1):
        z = np.bincount(owner, w[feature], len(toxic)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss_minus = np.logaddexp(0, z)
        negative = loss_minus[~toxic].mean() - prior * loss_minus[toxic].mean() if (~toxic).any() and toxic.any() else 0.0
        sign = 1.0 if negative >= 0 else -1.0
        plus = np.where(toxic, prior * (s - 1) / n_p, 0.0)
        minus = np.where(toxic, -prior * s / n_p, s / n_u)
        g = (plus if sign > 0 else 0.0) + sign * minus
        grad = np.append(np.bincount(feature, g[owner], width), g.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1] + bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature table, weights, bias). docs: doc_id, text; labels: doc_id, toxic; null toxic counts as
    unlabelled. Training reads about `positives` confirmed toxic texts and `unlabelled` others of any
    label, chosen by a hash of their id: the one bound. The class prior is the share of toxic rows
    among all labelled ones. Without toxic rows every score is that of the bias alone."""
    spark = docs.sparkSession
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, good = marks.agg(F.count("toxic"), F.sum("toxic")).first()
    good = int(good or 0)
    prior = min(0.9, max(0.001, good / n)) if n else 0.01
    total = docs.count()
    none = np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log(prior / (1 - prior)))
    if not good or not total:
        return none
    id_hash = chosen(F.col("doc_id"), positives / good, 3)
    known = marks.where("toxic = 1").where(id_hash).select("doc_id")  # about `positives` ids, so it may be broadcast
    known = docs.join(F.broadcast(known), "doc_id").select("text", F.lit(True).alias("toxic"))
    other = docs.where(chosen(F.col("doc_id"), unlabelled / total, 4)).select("text", F.lit(False).alias("toxic"))
    sample = known.unionByName(other).where("text is not null").repartition(6).persist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        features, n, rows = Features(), np.zeros((2, 1 << BITS), np.int32), 0
        for b in batches:
            toxic = np.array(b.column("toxic").to_pylist(), bool)
            for first, texts in groups(b.column("text"), 1 << 20):
                feature, owner = features.of(texts)
                kind = toxic[first + owner].astype(int)
                n += np.bincount((kind << BITS) | feature, minlength=2 << BITS).reshape(2, -1).astype(np.int32)
            rows += b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], ["n"])

    n = np.zeros((2, 1 << BITS), np.int64)
    for row in sample.mapInArrow(counted, "n binary").toLocalIterator():
        n += np.frombuffer(zlib.decompress(row.n), np.int32).reshape(2, -1)
    n_u, n_p = n
    size = max(1, n_p.max()), max(1, n_u.max())
    p, u = (n_p + 0.5) / (size[0] + 1), (n_u + 0.5) / (size[1] + 1)
    # the gain of a feature: how far its rates in P and U differ, over what chance explains
    gain = np.where(n_p >= 3, (p - u) / np.sqrt(u / size[0] + u / size[1]), 0)
    best = np.argsort(-np.abs(gain), kind="stable")[:MOST]
    best = best[np.abs(gain[best]) > LEAST]
    table = np.full(1 << BITS, -1, np.int32)
    table[best] = np.arange(len(best))
    held = spark.sparkContext.broadcast(table)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        features = Features(held.value)
        for b in batches:
            out = []
            for _, texts in groups(b.column("text"), 1 << 20):
                feature, owner = features.of(texts)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                out += [feature[x:y].astype("<u2").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.binary())], ["toxic", "f"])

    rows = sample.mapInArrow(reduced, "toxic boolean, f binary").collect()  # the bounded sample, MOST features each at most
    sample.unpersist()
    toxic = np.array([r.toxic for r in rows], bool)
    feature = np.concatenate([np.frombuffer(r.f, "<u2") for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r.f) >> 1 for r in rows])
    return table, *fit(owner, feature, toxic, prior, len(best))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with toxic_score from 0 to 1 of each whole text; a null or empty text gets that of the bias.
    A column of docs of that name is replaced."""
    docs = docs.drop("toxic_score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w, bias = held.value
        forget()
        features = Features(table)
        for b in batches:
            out = []
            for _, texts in groups(b.column("text")):
                feature, owner = features.of(texts)
                z = np.bincount(owner, w[feature], len(texts)) + bias if len(w) else np.full(len(texts), bias)
                out += (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*names, "toxic_score"])

    return docs.mapInArrow(run, widened(docs.schema, toxic_score="double"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's toxicity, learned where crc32(doc_id) mod 5 is not 0."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.select("doc_id", "text").where(~out), labels.select("doc_id", "toxic").where(~out))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
