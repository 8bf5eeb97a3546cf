"""Datasets by name from a registry, and stored results by the digest of what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.relational import renamed

from . import io

#: How each kind of entry is read: a file or folder by its extension, a tree of JSON files, an evaluation set by its halves.
KINDS = {
    "file": lambda spark, e: io.read_any(spark, [e["path"]], **e.get("options", {})),
    "tree": lambda spark, e: io.scan_folder(spark, e["path"], e.get("schema", io.PROBLEM)),
    "halves": lambda spark, e: io.scan_eval(spark, e["path"], e.get("most"), e.get("schema", io.PROBLEM)),
    "table": lambda spark, e: spark.table(e["path"]),
}


def entries(registry: DataFrame) -> dict[str, dict]:
    """The registry's rows by name: (name, kind, path), and columns, options (JSON objects), schema, most and parts (comma-separated names) where it has them. A name twice is an error."""
    out: dict[str, dict] = {}
    for row in registry.toLocalIterator():  # a row a dataset
        e = {k: v for k, v in row.asDict().items() if v is not None}
        for k in ("columns", "options"):
            if k in e:
                e[k] = json.loads(e[k])
        if e["name"] in out:
            raise ValueError(f"registered twice: {e['name']}")
        out[e["name"]] = e
    return out


def load(spark: SparkSession, registry: dict[str, dict], names: list[str]) -> DataFrame:
    """Rows of the named datasets with `dataset`, columns by each entry's map (new name: column; missing ones are null). An entry with `parts` is those datasets together, each
    of which may have parts of its own. Only what is named is looked at; an unknown name or kind and a circle of parts are errors."""

    def resolve(name: str, above: tuple[str, ...]) -> list[DataFrame]:
        if name in above:
            raise ValueError(f"made of itself: {' > '.join((*above, name))}")
        if name not in registry:
            raise KeyError(f"not registered: {name}")
        e = registry[name]
        if "parts" in e:
            return [x for part in e["parts"].split(",") for x in resolve(part.strip(), (*above, name))]
        if e["kind"] not in KINDS:
            raise ValueError(f"no such kind: {e['kind']}")
        rows = KINDS[e["kind"]](spark, e)
        rows = renamed(rows, e["columns"]) if "columns" in e else rows
        return [rows.withColumn("dataset", F.lit(name))]

    parts = [x for name in names for x in resolve(name, ())]
    if not parts:
        raise ValueError("no dataset is named")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def content(df: DataFrame) -> dict:
    """What tells a table's rows apart from another's, whatever their order and partitions: its schema, their number and two sums of hashes."""
    h = [F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(20,0)")) for seed in (0, 1)]
    r = df.agg(F.count(F.lit(1)).alias("n"), h[0].alias("a"), h[1].alias("b")).first()
    return {"schema": df.schema.simpleString(), "rows": r["n"], "sums": [str(r["a"]), str(r["b"])]}


def address(key: dict) -> str:
    return hashlib.sha256(json.dumps(key, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def reused(spark: SparkSession, folder: str, key: dict, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table stored in the folder under the digest of `key`, or build()'s, which is stored there first.

    It is written beside and moved into its place at the end, so a reader sees all of it or none; of two writers the first to move wins, and the other's goes.
    What lies there without its mark of success was torn and is made anew. refresh: made anew whatever is there."""
    at = f"{folder.rstrip('/')}/{address(key)}"
    if not refresh and io.exists(spark, f"{at}/_SUCCESS"):
        return spark.read.parquet(at)
    new = f"{folder.rstrip('/')}/.new-{uuid.uuid4().hex}"
    rows = build()
    rows.write.parquet(new)
    store, target = io._at(spark, at)
    _, source = io._at(spark, new)
    if refresh or not io.exists(spark, f"{at}/_SUCCESS"):
        store.delete(target, True)
        store.rename(source, target)
        # where another came first, the move went inside of it, under a name that readers skip
        io._remove(spark, f"{at}/{source.getName()}")
    else:
        store.delete(source, True)
    return spark.read.schema(rows.schema).parquet(at)


def rollouts(spark: SparkSession, folder: str, prompts: DataFrame, settings: dict, generate: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
    """generate(prompts), or what it gave for the same rows and settings before."""
    return reused(spark, folder, {"settings": settings, "prompts": content(prompts)}, lambda: generate(prompts), refresh)
