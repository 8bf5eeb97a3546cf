"""N-gram Jaccard join by multiple-global-order filtering.

Two sets of Jaccard at least t share a token among the first |x| - ceil(t |x|) + 1 of each under any
global order of the tokens. Candidates of the first order come from an equi-join on its prefix tokens. Those
of the other orders must hold too: their prefixes are short arrays, intersected before any whole set is
fetched. A sketch of token parities bounds by how much two sets differ at least, and rules out most of what the
orders let pass. Exact intersection of the sets decides. Rarity is the count in a fixed table of
hashed counters over all documents: exactness of the filters does not hang on it, only the number of candidates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .graph import differing, resolve
from .shingles import U, mix, shingle_sets

COUNTERS, PIECE, ORDERS = 1 << 22, 1 << 16, 3
#: Bits of a sketch.
BITS = 512


def _counters(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                held.append(s)
                size += len(s)
                if size > PIECE * 8:
                    np.add.at(total, (np.concatenate(held) % U(COUNTERS)).astype(np.int64), 1)
                    held, size = [], 0
            if held:
                np.add.at(total, (np.concatenate(held) % U(COUNTERS)).astype(np.int64), 1)
            rows += batch.num_rows
        if rows:
            key = zlib.crc32(total.tobytes()) % 16
            data = [zlib.compress(total[i : i + PIECE].astype("<i8").tobytes(), 1) for i in range(0, COUNTERS, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([key] * len(data), pa.int32()), pa.array(data, pa.binary())], ["piece", "fork", "data"])

    return run


def _added(pdf):
    total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["data"])
    return pdf.iloc[:1].assign(data=[zlib.compress(total.tobytes(), 1)])


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """For each of COUNTERS hash values a byte that grows with the logarithm of the number of documents
    with shingles of that hash. All documents count; the driver gets COUNTERS counters, whatever the input."""
    parts = docs.select("text").mapInArrow(_counters(k), "piece int, fork int, data binary")
    summed = parts.groupBy("piece", "fork").applyInPandas(_added, parts.schema).groupBy("piece").applyInPandas(_added, parts.schema)
    out = np.zeros(COUNTERS, np.int64)
    for row in summed.toLocalIterator():
        out[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(row.data), "<i8")
    return np.minimum(255, np.round(6 * np.log2(1.0 + out))).astype(np.uint8)


def prefix(tokens: np.ndarray, rare: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under an order: rare ones first, ties by the order's own hash."""
    n = len(tokens) - (len(tokens) * percent + 99) // 100 + 1
    rank = rare[(tokens % U(COUNTERS)).astype(np.int64)]
    if order:  # other orders have other classes of rarity too, so that their prefixes differ
        rank = rank // (4 * order)
    key = (rank.astype(U) << U(56)) | (mix(tokens + U(order) * U(0x632BE59BD9B4E019)) >> U(8))
    return tokens[np.argpartition(key, n - 1)[:n]] if n < len(tokens) else tokens


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of BITS hash values whether an odd number of tokens has it, as longs: sets differ in as many tokens at
    least as their sketches in bits."""
    odd = np.bincount((tokens >> U(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(np.sum(tokens, dtype=U).view(np.int64)), int(np.sum(mix(tokens), dtype=U).view(np.int64))


SIGNED = "doc_id long, n long, one long, two long, sketch array<long>, first array<long>, others array<array<int>>"


def _signed(k: int, percent: int, rare_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rare_var.value
        for batch in batches:
            n, one, two, sketches, first, others = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text").to_pylist(), k):
                    n.append(len(s))
                    for out, x in zip((one, two), fingerprint(s), strict=True):
                        out.append(x)
                    sketches.append(sketch(s))
                    first.append(prefix(s, rare, 0, percent).view(np.int64) if len(s) else None)
                    # 32 bits of a token are enough to rule out: equal tokens stay equal
                    others.append([prefix(s, rare, i, percent).astype(np.uint32).view(np.int32) for i in range(1, ORDERS)] if len(s) else None)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip((n, one, two, sketches, first, others), kinds, strict=True))], ["doc_id", "n", "one", "two", "sketch", "first", "others"])

    return run


def _sets(k: int):
    """The sets of (id, one, two, text) whose fingerprint is the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, keep = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True), []
            with np.errstate(over="ignore"):
                sets = list(shingle_sets(batch.column("text").to_pylist(), k))
                keep = [i for i, (s, f) in enumerate(zip(sets, mine, strict=True)) if fingerprint(s) == f]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["id", "tokens"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(p, U), np.frombuffer(q, U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents whose sets of distinct `words`-word
    shingles have a Jaccard similarity of percent / 100 or more are linked; component_id is the
    smallest id reachable by links, its own included.

    Equal sets fall together by a 128-bit fingerprint first; only one document of each goes on.
    A null or empty text has 0 shingles and links with nothing. Fewer words than `words`: the whole
    sequence is the one shingle. A row with a null id is returned with a null component and takes no
    part. Rows that repeat an id with another text are compared as texts of their own. An empty table
    gives no rows. Columns other than the two named are ignored, whatever their names."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rare = spark.sparkContext.broadcast(rarity(docs, words))
    signed = scratch.table(docs.mapInArrow(_signed(words, percent, rare), SIGNED), "signed")
    release(spark)
    part = signed.where("n > 0 and doc_id is not null")
    once = part.groupBy("one", "two", "n").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("sketch", "first", "others")])
    heads = once = scratch.table(once, "once")
    # a document is a vertex by its id; where ids repeat with other texts, by its set
    distinct, ids = heads.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    vertex = F.col("doc_id") if distinct == ids else F.xxhash64("one", "two", "n")
    heads = heads.withColumn("id", vertex)
    release(spark)

    def marks(ids: DataFrame) -> DataFrame:
        return heads.join(ids, "id", "left_semi").select("id", F.col("n").alias("size"), "sketch")

    def may(m: Column, n: Column, x: Column, y: Column) -> Column:
        return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (differing(x, y) * (100 + percent) <= (m + n) * (100 - percent))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: heads.select(F.col("id").alias(c), F.col("others").alias(f"others_{c}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        for i in range(ORDERS - 1):
            near = near.where(F.arrays_overlap(F.col("others_a")[i], F.col("others_b")[i]))
        near = scratch.table(near.select("a", "b"), "near")
        wanted = heads.select("id", "doc_id", "one", "two").join(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
        sets = scratch.table(docs.join(wanted, "doc_id").select("id", "one", "two", "text").mapInArrow(_sets(words), "id long, tokens binary").dropDuplicates(["id"]), "sets")
        release(spark)
        joined = near.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
        out = scratch.table(joined.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"), "verified")
        scratch.drop(near, sets)
        release(spark)
        return out

    postings = heads.select(F.explode("first").alias("bucket"), "id", F.col("n").cast("int").alias("size"))
    found = resolve(postings, marks, may, verify, scratch, 100 / percent)
    named = heads.select("one", "two", "doc_id", "id").join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = named.where("component is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = scratch.table(named.join(least, "c", "left").select("one", "two", F.coalesce("least", "doc_id").alias("c")), "named")
    scratch.drop(once, found)
    out = signed.select("doc_id", "n", "one", "two").join(named, ["one", "two"], "left")
    alone = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each group of jaccard_groups() the document of the
    smallest doc_id stays. Rows with a null doc_id and those that link with nothing stay. Of rows that
    repeat a doc_id one stays, that of the smallest text."""
    passes = Scratch(docs.sparkSession, "jaccard")
    groups = Scratch(docs.sparkSession, "kept").table(jaccard_groups(docs, words, percent, scratch=passes), "groups")
    passes.clear()
    known = groups.where("doc_id is not null")
    gone = known.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti")
    again = known.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("__again"))
    if again.isEmpty():
        return out
    # the repeated ids' rows only go through a group; the others pass by
    twice = out.join(again.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    first = twice.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.coalesce("text", F.lit(""))).alias("__row")).select("__row.*")
    return out.join(again.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(first)
