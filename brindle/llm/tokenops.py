"""Token counts, token-ID files, and encoding with decoding, over whole texts."""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, widened
from .tokens import CODERS, Coder, default_file, groups, id_coder, library_ids, merge_coder, vocabulary

#: Pre-tokens in the broadcast table, each of at most WIDE bytes: at most 20 MB, whatever the input.
FREQUENT, WIDE = 1 << 16, 256


# ---- token counts ---------------------------------------------------------------------------------


def frequent_lengths(docs: DataFrame, path: str, sample: int = 2000) -> tuple[bytes, bytes]:
    """The most frequent pre-tokens of about `sample` documents drawn at random (joined by line ends) and their numbers of
    ids, 16 bits each. The sample is the one bound: all tasks of the scan draw from it, eight tasks count the whole texts drawn and
    send the words that they hold to the driver. What the table holds decides the speed of count_tokens(), never its results."""
    share = sample / max(1, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = id_coder(path).pieces, Counter()
        for b in batches:
            for _, texts in groups(b.column("text")):
                for t in texts:
                    total.update(w for w in pieces(t.lower()) if len(w) <= WIDE // 4 and "\n" not in w)
        top = total.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], ["w", "n"])

    total: Counter = Counter()
    for row in docs.select("text").where(F.rand(7) < share).repartition(8).mapInArrow(run, "w string, n long").toLocalIterator(prefetchPartitions=True):
        total[row.w] += row.n
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]
    n = [len(x) >> 2 for x in library_ids(path)([w.encode() for w in words])]
    return "\n".join(words).encode(), np.array(n, "<u2").tobytes()


@functools.cache
def _length_coder(path: str) -> Coder:
    ids = library_ids(path)
    return Coder(path, lambda words: [len(x) >> 2 for x in ids(words)], counts=True)


CODERS.append(_length_coder)


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text.

    Two tiers, map-side: a broadcast table of frequent pre-tokens' lengths, and each worker's cache for
    the rest, which the library encodes on a miss. No pre-token is shuffled or counted by the cluster. A null text counts 0 and
    0; columns of docs of the three names are replaced; the rows' order and repeats stay."""
    path = path or default_file()
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    held = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _length_coder(path)
        words, n = held.value
        frequent = dict(zip(words.decode().split("\n"), np.frombuffer(n, "<u2").tolist(), strict=True)) if words else {}
        for b in batches:
            total = []
            for _, texts in groups(b.column("text")):
                coder.frequent = frequent
                total += coder.lengths(texts).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.int64())], [*names, "n_tokens"])

    out = docs.mapInArrow(run, widened(docs.schema, n_tokens="long"))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op5(docs: DataFrame) -> DataFrame:
    """Every document's bytes and tokens. A null or empty text has 0 of both; repeated rows stay; an empty table gives no rows."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


# ---- encoding and decoding ------------------------------------------------------------------------


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids array<int> of each whole text, by batched numpy merges. A null text has none."""
    path = path or default_file()
    docs = docs.drop("ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_coder(path)
        for b in batches:
            for first, texts in groups(b.column("text")):
                ids, n = coder.flat(texts)
                ends = np.concatenate([[0], np.cumsum(n)])
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype("<i4")))], [*names, "ids"])

    return docs.mapInArrow(run, widened(docs.schema, ids="array<int>"))


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (with ids array<int>) with decoded: the tokens' text as the library decodes them. Null ids
    give the empty text; an id beyond the vocabulary is an error."""
    path = path or default_file()
    docs = docs.drop("decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            out = []
            for ids in b.column("ids").to_pylist():
                out.append(v.decode(np.array(ids or [], np.int64))[0].tobytes()[:-1].decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return docs.mapInArrow(run, widened(docs.schema, decoded="string"))


def digests(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text's encoding and its decoding, and the ids
    array<int> themselves if asked for. A null text is empty; columns of docs of these names are replaced; the rows' repeats stay."""
    path = path or default_file()
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    docs = docs.drop(*made)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, v = merge_coder(path), vocabulary(path)
        for b in batches:
            for first, texts in groups(b.column("text")):
                flat, n = coder.flat(texts)
                stop = np.cumsum(n)
                data = memoryview(flat.astype("<u4").view(np.uint8))
                one, two = [hashlib.sha256(data[4 * x : 4 * y]).hexdigest() for x, y in zip((stop - n).tolist(), stop.tolist(), strict=True)], []
                for at in range(0, len(texts), 128):  # decoded text is several times the ids
                    lo, hi = int(stop[at] - n[at]), int(stop[min(len(stop), at + 128) - 1])
                    text, ends = v.decode(flat[lo:hi])
                    ends = np.concatenate([[0], ends])
                    text = memoryview(text)
                    for x, y in zip((stop - n)[at : at + 128] - lo, stop[at : at + 128] - lo, strict=True):
                        two.append(hashlib.sha256(text[ends[x] : max(ends[x], ends[y] - 1)]).hexdigest())
                more = [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                if ids:
                    more.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(flat.astype("<i4"))))
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(texts)).columns, *more], [*names, *made])
        pa.default_memory_pool().release_unused()

    kinds = dict(zip(made, ("long", "string", "string", "array<int>"), strict=False))
    return docs.mapInArrow(run, widened(docs.schema, **kinds))


def op8(docs: DataFrame) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of their decoding. A null text is encoded as the empty one;
    repeated rows stay; an empty table gives no rows."""
    return digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# ---- token-ID files -------------------------------------------------------------------------------


def _store(uri: str):
    """The file system of a URI that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def id_width(path: str | None = None) -> int:
    """Bytes of an id in the files: the least of 2 and 4 that holds the vocabulary."""
    return 2 if vocabulary(path or default_file()).size + 2 <= 1 << 16 else 4


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = 1) -> list[tuple[str, int, int, int, int]]:
    """Writes the ids of all documents in ascending doc_id order (null first, ties by a hash of the text, then by the text, so that rows
    of one id or none spread over parts) and returns
    the manifest: (name, documents, ids, first document, first id) of each part in order.

    Part files: name.bin, ids as unsigned integers of the least width that holds the vocabulary;
    name.idx, documents + 1 offsets in ids as little-endian 64-bit; name.doc, doc_ids as 64-bit; and
    name.ok, a byte of each, 0 where doc_id is null. `end` is written after each document; a null
    text is empty. A task that runs again writes under another name, so a lost executor leaves no
    half-written part in the manifest. Partition bases are prefix sums over the parts' sizes."""
    path = path or default_file()
    width = id_width(path)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        coder, part = id_coder(path), TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:8]}"
        sizes, doc_ids = [], []
        with store.open_output_stream(f"{top}/{name}.bin") as out:
            for b in batches:
                doc_ids.append(b.column("doc_id"))
                for _, texts in groups(b.column("text")):
                    ids, n = coder.flat(texts)
                    out.write(np.insert(ids, np.cumsum(n), end).astype(f"<u{width}").tobytes())
                    sizes.append(n + 1)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        doc_ids = pa.chunked_array(doc_ids, pa.int64())
        for kind, data in (("idx", np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")), ("doc", doc_ids.fill_null(0).to_numpy().astype("<i8")), ("ok", doc_ids.is_valid().to_numpy().astype("u1"))):
            with store.open_output_stream(f"{top}/{name}.{kind}") as out:
                out.write(data.tobytes())
        if len(sizes):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], ["part", "name", "docs", "ids"])

    parts = sorted(ordered.mapInArrow(run, "part long, name string, docs long, ids long").collect())  # a row a partition
    docs_before, ids_before = 0, 0
    manifest = []
    for p in parts:
        manifest.append((p.name, p.docs, p.ids, docs_before, ids_before))
        docs_before, ids_before = docs_before + p.docs, ids_before + p.ids
    return manifest


def read_ids(spark, manifest: list[tuple], folder: str, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: memory-mapped where they
    are in a local folder, else by positioned reads."""
    schema = "name string, docs long, ids long, docs_before long, ids_before long"
    parts = spark.createDataFrame(manifest, schema)
    parts = parts.repartition(max(1, len(manifest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for b in batches:
            for row in b.to_pylist():
                at = f"{top}/{row['name']}"
                read = lambda kind, at=at: store.open_input_stream(f"{at}.{kind}").readall()
                offsets = np.frombuffer(read("idx"), "<i8")
                doc_id, ok = np.frombuffer(read("doc"), "<i8"), np.frombuffer(read("ok"), "u1").astype(bool)
                source = pa.memory_map(f"{at}.bin") if store.type_name == "local" else store.open_input_file(f"{at}.bin")
                with source:
                    for first in range(0, len(doc_id), 4096):
                        last = min(len(doc_id), first + 4096)
                        lo = offsets[first]
                        crc = []
                        for x, y in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True):
                            ids = np.frombuffer(source.read_at(int(y - x) * width, int(x) * width), f"<u{width}")
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        part = [pa.array(doc_id[first:last], mask=~ok[first:last]), pa.array(offsets[first:last] + row["ids_before"]), pa.array(np.diff(offsets[first : last + 1])), pa.array(crc, pa.int64())]
                        assert lo <= offsets[last]
                        yield pa.RecordBatch.from_arrays(part, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(docs: DataFrame) -> DataFrame:
    """Writes all documents' ids and returns each document's digest as read back. The files stay in the
    shared folder until the driver ends."""
    spark = docs.sparkSession
    folder = Scratch(spark, "ids").path("files")
    manifest = write_ids(docs, folder)
    release(spark)
    return read_ids(spark, manifest, folder, id_width())
