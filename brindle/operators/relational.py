"""Look-ups, batches, set operations, exact deduplication and mixture plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import numbered

SEPARATOR = "\n--FIELD--\n"
#: An odd number whose multiples lie far apart modulo 2^64.
STEP = 0x9E3779B97F4A7C15


def round_robin_lookup(rows: DataFrame, gold: DataFrame, keys: list[str], order: list[str], gold_order: list[str]) -> DataFrame:
    """The n-th row of a key takes the key's gold row n modulo their number; no gold: null. Rows are numbered by ranges and prefix sums, so
    that a key of a third of all rows is no single task's."""
    left = numbered(rows, keys, order, "__n")
    right = numbered(gold, keys, gold_order, "__i")
    sizes = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    left = left.join(sizes, keys, "left").withColumn("__i", F.col("__n") % F.col("__c")).drop("__n", "__c")
    return left.join(right, [*keys, "__i"], "left").drop("__i")


def fallback_lookup(rows: DataFrame, gold: DataFrame, op: str, index: str, value: str, later: str) -> DataFrame:
    """The gold value of (op, index modulo the op's number of gold rows); of equal (op, index) the later file's counts."""
    best = gold.groupBy(op, index).agg(F.max_by(value, later).alias(value))
    sizes = best.groupBy(op).agg(F.count(F.lit(1)).alias("__c"))
    left = rows.join(sizes, op, "left").withColumn("__i", F.pmod(F.col(index), F.col("__c")))
    return left.join(best.withColumnRenamed(index, "__i"), [op, "__i"], "left").drop("__i", "__c")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by a hash of keys to four tasks a core: before a step whose work outweighs its rows' bytes. Files are split by bytes, so a table of
    few narrow columns would else be worked off in one task, however many rows it has."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def candidate_pairs(bands: DataFrame, id_col: str) -> DataFrame:
    """(a, b) of ids that share a band key, each once: the key's least id with the others, so that a large bucket gives a pair a member."""
    lead = bands.groupBy("band", "band_key").agg(F.min(id_col).alias("a"))
    return bands.join(lead, ["band", "band_key"]).where(F.col("a") < F.col(id_col)).select("a", F.col(id_col).alias("b")).distinct()


def missing(rows: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gold, keys, "left_anti")


def shifted(df: DataFrame, batch: str, order: str, value: str) -> Column:
    """The value of the row before in its batch, the first row taking the last's."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(value).over(w))


def exact_dedup(df: DataFrame, by: list[str], fields: list[str], order: str, short: bool = False) -> DataFrame:
    """The first row of each digest within `by`. The digest, not `by`, deals rows out, so a large
    group does not land in one task; max_by keeps map-side combining where a window would not. short: a digest of 64 bits, under which
    different rows meet by chance once in about 10^9 to 10^10 rows; only equality counts, so Spark's own hash serves."""
    key = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    digest = F.xxhash64(key) if short else F.sha2(key, 256)
    return df.withColumn("digest", digest).groupBy(*by, "digest").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(text: str, n: int, perms: int) -> np.ndarray:
    """For s in 1 .. perms the least of h * a + b over the hashes h of a text's n-character windows, with a = mixed(s) made odd and b = mixed(s + STEP); a shorter
    text is one window."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    s, one = np.arange(1, perms + 1, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        k = min(n, len(code))
        h = np.zeros(len(code) - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(STEP) + code[i : i + len(h)]
        h, at = mixed(h + np.uint64(k)), np.empty_like(h)
        if len(h) <= 1 << 10:  # all at once, where the product is small
            return (h[:, None] * (mixed(s) | one) + mixed(s + np.uint64(STEP))).min(axis=0).view(np.int64)
        out = np.empty(perms, np.uint64)
        for i, (a, b) in enumerate(zip(mixed(s) | one, mixed(s + np.uint64(STEP)), strict=True)):
            np.multiply(h, a, out=at)
            at += b
            out[i] = at.min()
        return out.view(np.int64)


def minhash(df: DataFrame, text: str, n: int, perms: int) -> DataFrame:
    """df with signature: see signature(), over whole texts in Arrow batches; a null text is an empty one."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(x or "", n, perms) for x in texts])

    return df.withColumn("signature", F.pandas_udf(run, "array<long>")(text))


def band_keys(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row a band with its key."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(bands)])
    return df.select("*", F.posexplode(keys).alias("band", "band_key"))


def repeated(df: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """n copies of each row with position: copies side by side, or the whole table n times over."""
    total = df.count()
    rep = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rep.withColumn("position", F.col("row_id") * n + F.col("rep") if interleave else F.col("rep") * total + F.col("row_id"))


def padded(df: DataFrame, divisor: int, total: int) -> DataFrame:
    """Rows by row_id 0 .. total - 1, and leading rows again until the number divides."""
    pad = -total % divisor
    if not total or not pad:
        return df.withColumn("position", F.col("row_id"))
    again = F.filter(F.sequence(F.lit(0), F.lit(pad - 1)), lambda i: i % total == F.col("row_id"))
    extra = df.withColumn("__p", F.explode(again)).withColumn("position", F.col("__p") + total).drop("__p")
    return df.withColumn("position", F.col("row_id").cast("long")).unionByName(extra.withColumn("position", F.col("position").cast("long")))


def op_budget(plan: DataFrame, p: str, idx: str, total: int) -> DataFrame:
    """Largest remainders: floors of p * total, then one more in order of the fraction, ties by idx. The
    plan is a row an op, so its windows run over a few rows."""
    share = F.col(p) / F.sum(p).over(Window.partitionBy()) * total
    out = plan.withColumn("__s", F.round(share, 9)).withColumn("__f", F.floor("__s"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__s") - F.col("__f"), 9)), idx))
    left = total - F.sum("__f").over(Window.partitionBy())
    return out.withColumn("budget", (F.col("__f") + (rank <= left).cast("int")).cast("long")).drop("__s", "__f")


def mix_plan(plan: DataFrame, total: float) -> DataFrame:
    """Whole repeats and the residual share of each shard for total * p_context * p_op tokens."""
    ratio = F.lit(float(total)) * F.col("p_context") * F.col("p_op") / F.col("tokens")
    out = plan.withColumn("ratio", F.round(ratio, 9)).withColumn("repeats", F.floor("ratio").cast("long"))
    rest = F.col("ratio") - F.col("repeats")
    return out.withColumn("residual", F.round(F.when(rest < 1e-6, 0.0).otherwise(rest), 6)).drop("ratio")


def first_share(df: DataFrame, by: list[str], order: list[str], share: float) -> DataFrame:
    """The first int(n * share) rows of each group, numbered by ranges and prefix sums."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    out = numbered(df, by, order, "__r").join(sizes, by)
    return out.where(F.col("__r") < F.floor(F.col("__n") * share)).select(*df.columns)


def preset_filter(rows: DataFrame, presets: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Rows that the preset of their keys names by `on`; rows whose keys have no preset stay all. presets: keys and `on`."""
    known = presets.select(*keys).distinct().withColumn("__known", F.lit(True))
    named = presets.select(*keys, on).distinct().withColumn("__named", F.lit(True))
    out = rows.join(known, keys, "left").join(named, [*keys, on], "left")
    return out.where("__known is null or __named").select(*rows.columns)


def restored(results: DataFrame, index: DataFrame, place: str, row: str) -> DataFrame:
    """Results by place in micro-batches, with the row that stood there before they were dealt: the inverse of the permutation index (place, row)."""
    return results.join(index.select(place, row), place).drop(place)


def backfilled(store: DataFrame, rows: DataFrame, digest: str, sid: str) -> DataFrame:
    """The store (digest, sid) and a row for each digest of `rows` that it lacks, with the least sid. Digests spread evenly, so no
    group is large after map-side minima."""
    new = rows.groupBy(digest).agg(F.min(sid).alias(sid)).join(store.select(digest), digest, "left_anti")
    return store.select(digest, sid).unionByName(new)


def used_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct keys of all frames."""
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.unionByName(f.select(*keys))
    return out.distinct()


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that a registry names (new name: column), under the new names; those that the table lacks are null."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(k) for k, c in names.items()])


def where_equal(df: DataFrame, wanted: dict[str, object] | str) -> DataFrame:
    """Rows that equal all of the wanted values, compared as text; wanted may be text of the form `column=value,column=value`. A null equals nothing; an unknown column is an error."""
    if isinstance(wanted, str):
        pairs = [x.partition("=") for x in wanted.split(",") if x.strip()]
        if any(not mark for _, mark, _ in pairs):
            raise ValueError(f"not column=value: {wanted!r}")
        wanted = {k.strip(): v.strip() for k, _, v in pairs}
    for k, v in wanted.items():
        if k not in df.columns:
            raise KeyError(k)
        df = df.where(F.col(f"`{k}`").cast("string") == F.lit(str(v)))
    return df
