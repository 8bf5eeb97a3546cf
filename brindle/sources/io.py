"""Readers and writers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBLEM = "problem string, question string, solution string, op bigint, id string, template string, mode string, length string, d bigint"
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text"}


def read_jsonl(spark: SparkSession, path: str, schema: str = PROBLEM, on_bad: str = "skip") -> DataFrame:
    """Rows of JSON lines; blank and bad lines are skipped, or fail."""
    if on_bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_any(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """By extension; all paths must agree."""
    kinds = {FORMATS[p.rsplit(".", 1)[-1]] for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of several formats: {sorted(kinds)}")
    return spark.read.options(**options).format(kinds.pop()).load(paths)


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger does not name."""
    return files.join(ledger, "file", "left_anti")


def write_parts(df: DataFrame, path: str, by: str, rows: int = 1000) -> None:
    """JSON lines by a column's value, at most `rows` a file."""
    df.write.mode("append").option("maxRecordsPerFile", rows).partitionBy(by).json(path)


# ---- layouts -------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in spark.checkpoint.dir, which driver and executors share. A temporary one only where that is unset
    and the master is local; a cluster without it is an error. It goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        store, p = _at(spark, path)
        store.delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def scan_folder(spark: SparkSession, top: str, schema: str = PROBLEM) -> DataFrame:
    """Rows of all JSON files below a folder, with `file`, by which callers order; bad lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
    return rows.json(top).withColumn("file", F.col("_metadata.file_path"))


#: Names of the halves of an evaluation set, in the order tried.
HALVES = [("test_200_id.jsonl", "test_200_ood.jsonl"), ("test_id", "test_ood"), ("val_id", "val_ood")]


def scan_eval(spark: SparkSession, top: str, most: int | None = None, schema: str = PROBLEM) -> DataFrame:
    """Rows of an evaluation set with split (`id` or `ood`). A file is `id` altogether; a folder may hold one of the pairs of HALVES;
    else its files are read, op is taken from a file name's `opN` where a row has none, and rows of op up to `most` are `id`
    (most null: all with an op; a row without an op: `ood`)."""
    store, p = _at(spark, top)
    if store.getFileStatus(p).isFile():
        return scan_folder(spark, top, schema).withColumn("split", F.lit("id"))
    for pair in HALVES:
        found = [(f"{top}/{name}", split) for name, split in zip(pair, ("id", "ood"), strict=True) if exists(spark, f"{top}/{name}")]
        if found:
            parts = [scan_folder(spark, path, schema).withColumn("split", F.lit(split)) for path, split in found]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = scan_folder(spark, top, schema)
    op = F.coalesce("op", F.regexp_extract("file", r"(?i)op(\d+)[^/]*(?:/part-[^/]*)?$", 1).try_cast("long"))
    inside = op.isNotNull() if most is None else op <= most
    return rows.withColumn("op", op).withColumn("split", F.when(inside, "id").otherwise("ood"))


def checkpoints(spark: SparkSession, top: str) -> list[str]:
    """Names of the folders `checkpoint-N` in a folder, by N."""
    store, p = _at(spark, top)
    names = [s.getPath().getName() for s in store.listStatus(p) if s.isDirectory()]
    return sorted((n for n in names if re.fullmatch(r"checkpoint-\d+", n)), key=lambda n: int(n[11:]))


# ---- sinks ---------------------------------------------------------------------------------------

#: The columns of a summary of checkpoints.
SUMMARY = ["checkpoint", "id_acc", "ood_acc", "total_acc", "id_avg_loss", "ood_avg_loss", "total_avg_loss", "id_avg_resp_len", "ood_avg_resp_len", "count_id", "count_ood", "count_total"]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """JSON lines; what is there stays unless it is to be overwritten. Returns whether it wrote."""
    if not overwrite and exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").json(path)
    return True


def write_summary(df: DataFrame, path: str) -> None:
    """SUMMARY's columns, empty where the table lacks them, as CSV with a header in one file: a row a checkpoint."""
    cells = [(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in SUMMARY]
    df.select(*cells).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """Generations as JSON lines in a folder a step; a step written again is replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def write_generations(df: DataFrame, by: list[str], order: list[str], response: str, path: str) -> None:
    """Parquet of a row a prompt with `responses`, its answers in order."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, response))).alias("__r"))
    rows.select(*by, F.transform("__r", lambda r: r[response]).alias("responses")).write.mode("overwrite").parquet(path)
