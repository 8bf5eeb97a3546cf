"""Shared helpers: tables, scratch tables in the cluster's shared folder, release of shuffle files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where
    that is unset and the master is local, as in tests; a cluster without it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.
    Those that the result still reads go when the driver ends; drop() removes others early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._delete, self.root)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def parts(self, frames: Iterable[DataFrame], name: str = "t") -> DataFrame:
        """One table of frames of the same columns, written one after another; the shuffle files of each go before
        the next, so that the disk holds those of one at a time."""
        path, schema = self.path(name), None
        for df in frames:
            schema = df.schema
            df.write.mode("append").option("compression", "zstd").parquet(path)
            release(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if hasattr(t, "scratch_path"):
                self._delete(t.scratch_path)

    def clear(self) -> None:
        """Removes all tables: nothing reads them any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            pass


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished jobs now, not at the driver's next full
    garbage collection: operators of several passes would else hold every pass's files at once."""
    spark._jvm.System.gc()


def widened(schema: T.StructType, **more: str) -> T.StructType:
    """A copy of a schema with more columns (StructType.add would change the frame's own)."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])


def held_out(doc_id, mod: int, rest: int):
    """The contracts' folds: crc32 of the id as text, modulo mod, is rest (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def chosen(doc_id, share: float, salt: int):
    """A repeatable sample of rows by a hash of their id."""
    top = 1 << 30
    return F.pmod(F.xxhash64(F.lit(salt), doc_id), F.lit(top)) < int(min(1.0, share) * top)
