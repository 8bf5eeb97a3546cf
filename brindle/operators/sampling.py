"""Mixtures, budgets, samples, orders and splits. Plans are a row an op or a context and are settled on the driver; rows are numbered by
range partitions and prefix sums where a group may be large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.sources.io import shared_folder


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the 0-based place of each row in its group, as a long. `order` must tell rows apart; a null key is a group of its own.

    The rows are dealt by ranges of (by, order) once, sorted, and written to the shared folder with their partition and their place in
    it; all that follows reads that table, so no second sampling of ranges can disagree with the first. A row's place in the table is
    its place in its partition and the sizes of the partitions before (a row a partition); its group's first row is the group's least.
    A group of any size so spreads over many tasks. by=[] numbers the whole table."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "numbered")
    part = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    part.write.parquet(at)
    part = spark.read.schema(part.schema).parquet(at)
    own = F.shiftright("__at", 33)
    sizes, before, starts = {r["p"]: r["n"] for r in part.groupBy(own.alias("p")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}, 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts = F.broadcast(spark.createDataFrame(starts, "__p long, __start long"))  # a row a partition

    def place(rows: DataFrame, c: str) -> DataFrame:
        here = rows.join(starts, F.shiftright(c, 33) == F.col("__p"))
        return here.withColumn(c, F.col("__start") + F.col(c).bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__start")

    rows = place(part, "__at")
    if not by:
        return rows.select(*df.columns, F.col("__at").alias(name))
    first = place(part.groupBy(*by).agg(F.min("__at").alias("__first")), "__first").select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], "__first")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    return rows.join(first, same).select(*df.columns, (F.col("__at") - F.col("__first")).alias(name))


def cumulated(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to and with each one, in an order that tells rows apart: rows are dealt by ranges once and written with their
    partition; each adds up its own, on top of the partitions' sums before (a row a partition)."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession, "cumulated")
    part = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    part.write.parquet(at)
    part = spark.read.schema(part.schema).parquet(at)
    sums = {r["__part"]: r["s"] for r in part.groupBy("__part").agg(F.sum(value).alias("s")).toLocalIterator()}
    starts, before = [], 0.0
    for p in sorted(sums):
        starts.append((p, float(before)))
        before += sums[p] or 0
    base = F.broadcast(spark.createDataFrame(starts, "__part int, __start double"))  # a row a partition
    run = F.sum(F.col(value).cast("double")).over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn(name, run).join(base, "__part").select(*df.columns, (F.col(name) + F.col("__start")).alias(name))


def hashed(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def largest_remainders(shares: list[float], total: int) -> list[int]:
    """Floors of share * total, then one more by descending fraction, ties by place, round and round; a floor sum above total loses one
    by ascending fraction."""
    exact = [round(s * total, 9) for s in shares]
    out = [math.floor(x) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (-round(exact[i] - out[i], 9), i))
    left, at = total - sum(out), 0
    while left and order:
        i = order[at % len(order)] if left > 0 else order[-1 - at % len(order)]
        if left > 0 or out[i] > 0:
            out[i] += 1 if left > 0 else -1
            left -= 1 if left > 0 else -1
        at += 1
    return out


def balanced(contexts: list[tuple[str, float]], ops: list[int], total: int) -> dict[tuple[str, int], int]:
    """Rows of each (context, op): as many of every op within a context; rounds of one more for all ops of a context go by the descending
    fraction of its share, and what is left over to the largest ops, one each. A context that gets nothing is an error."""
    exact = [p * total / len(ops) for _, p in contexts]
    each = [math.floor(x + 1e-9) for x in exact]
    left = total - sum(each) * len(ops)
    order = sorted(range(len(contexts)), key=lambda i: (-(exact[i] - each[i]), i))
    for i in order[: left // len(ops)]:
        each[i] += 1
    left -= min(left // len(ops), len(order)) * len(ops)
    if min(each, default=0) < 1 or left > len(ops):
        raise ValueError("a context has too small a share")
    out = {(c, op): n for (c, _), n in zip(contexts, each, strict=True) for op in ops}
    top = contexts[order[min(len(order) - 1, 0)]][0]
    for op in sorted(ops, reverse=True)[:left]:
        out[top, op] += 1
    return out


def allocation(contexts: dict[str, float], ops: dict[int, float], held: dict[tuple[str, int], int], total: int) -> dict[tuple[str, int], int]:
    """Rows of each (context, op) by the product of their shares, normalised over the pairs that hold rows."""
    cells = sorted((c, o) for c, o in held if held[c, o] and contexts.get(c) and ops.get(o))
    mass = [contexts[c] * ops[o] for c, o in cells]
    return dict(zip(cells, largest_remainders([m / sum(mass) for m in mass], total), strict=True)) if cells else {}


def drawn(df: DataFrame, by: list[str], id_col: str, plan: dict[tuple, int], seed: int = 42) -> DataFrame:
    """As many rows of each group as planned, by a seeded order; where a group is short its rows come again in that order (copy counts
    them). Groups without a plan go."""
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("want", T.LongType())])
    table = df.sparkSession.createDataFrame([(*k, v) for k, v in plan.items()], schema)
    some = df.join(table, by).withColumn("h", hashed(seed, id_col))
    ranked = numbered(some, by, ["h", id_col], "place")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("have"))
    copies = F.floor((F.col("want") - F.col("place") - 1) / F.col("have")) + 1
    out = ranked.join(sizes, by).where("place < want")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).select(*df.columns, "copy")


def compose_plan(plan: DataFrame, total: float) -> DataFrame:
    """Whole files and the share of the next one for p * total tokens of files of file_tokens."""
    exact = F.round(F.col("p") * total / F.col("file_tokens"), 9)
    return plan.withColumn("files", F.floor(exact).cast("long")).withColumn("rest", F.round(exact - F.floor(exact), 6))


def materialized(rows: DataFrame, shard: str, plan: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows of each shard `repeats` times, and of ceil(residual * n) of them, by a seeded order, once more; a residual of 0.999999 or
    more takes all. plan: (shard, repeats, residual), a row a shard."""
    sizes = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).join(plan, shard)
    more = F.when(F.col("residual") >= 0.999999, F.col("n")).otherwise(F.ceil(F.round(F.col("residual") * F.col("n"), 6)))
    some = rows.join(sizes.withColumn("more", more), shard).withColumn("h", hashed(seed, id_col))
    ranked = numbered(some, [shard], ["h", id_col], "place")
    copies = F.col("repeats") + (F.col("place") < F.col("more")).cast("int")
    return ranked.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*rows.columns, "copy")


def resampled(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: a seeded permutation's first, and again from its start where there are fewer."""
    have = df.count()
    if not have:
        return df.withColumn("copy", F.lit(0))
    ranked = numbered(df.withColumn("h", hashed(seed, id_col)), [], ["h", id_col], "place")
    copies = (F.lit(n) - F.col("place") - 1 + have) / have
    return ranked.where(F.col("place") < n).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.floor(copies) - 1).cast("int")))).select(*df.columns, "copy")


def split(df: DataFrame, id_col: str, held: float, seed: int = 42) -> DataFrame:
    """df with split: `validation` for a seeded share of rows, else `train`; a hash of the id decides, so reruns and streams agree."""
    return df.withColumn("split", F.when(F.pmod(hashed(seed, id_col), F.lit(1 << 20)) < int(held * (1 << 20)), "validation").otherwise("train"))


def natural(op: str) -> list[Column]:
    """Sort keys: whole numbers, then texts that begin with one, by it, then the others."""
    c = F.col(op)
    head = F.regexp_extract(c, r"^(\d+)", 1)
    return [F.when(c.rlike(r"^\d+$"), 0).when(head != "", 1).otherwise(2), F.coalesce(head.try_cast("long"), F.lit(0)), c]


def interleaved(frames: list[DataFrame], order: str, stop: str = "first") -> DataFrame:
    """Rows of several tables in turn, with position: until the first is exhausted, or (stop='all') until all have been, the
    shorter ones from their start again."""
    sizes = [f.count() for f in frames]
    n = min(sizes) if stop == "first" else max(sizes)
    out = None
    for i, f in enumerate(frames):
        ranked = numbered(f, [], [order], "place")
        if stop == "first":
            rows = ranked.where(F.col("place") < n).withColumn("turn", F.col("place"))
        else:
            turns = F.sequence(F.col("place"), F.lit(n - 1).cast("long"), F.lit(max(sizes[i], 1)).cast("long"))
            rows = ranked.where(F.col("place") < n).withColumn("turn", F.explode(turns))
        rows = rows.withColumn("position", F.col("turn") * len(frames) + i).drop("place", "turn")
        out = rows if out is None else out.unionByName(rows)
    return out


def fraction(seed: int, key: Column) -> Column:
    """A number from 0 to below 1: the first 32 bits of sha256(seed:key)."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def interleaved_by(frames: list[DataFrame], order: str, shares: list[float], stop: str = "first", seed: int = 42) -> DataFrame:
    """Rows of several tables with position, the table of each position drawn by its share: until a table that is exhausted is drawn again, or (stop='all') until
    all have been exhausted, the others from their start again. Draws are of (seed, position). An empty table ends it at once, by either rule."""
    sizes = [f.count() for f in frames]
    if not frames or len(shares) != len(frames) or min(shares, default=0) <= 0:
        raise ValueError("each table wants a share above 0")
    spark, edges, run = frames[0].sparkSession, [], 0.0
    for share in shares[:-1]:
        run += share / sum(shares)
        edges.append(run)
    source = F.lit(len(frames) - 1)
    for i in reversed(range(len(edges))):
        source = F.when(F.col("__u") < edges[i], i).otherwise(source)
    # the first table drawn once more than it has rows comes by this many draws; all have been drawn out by as many again, or more are drawn
    most = sum(sizes) + len(frames) if stop == "first" else 2 * math.ceil(max(n / (s / sum(shares)) for n, s in zip(sizes, shares, strict=True))) + 64
    if min(sizes) == 0:
        most = 0
    while True:
        drawn_ = spark.range(most).select(F.col("id").alias("position")).withColumn("__u", fraction(seed, F.col("position"))).select("position", source.alias("source"))
        drawn_ = numbered(drawn_, ["source"], ["position"], "__turn")
        size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("source") + 1)
        if stop == "first":
            end = drawn_.where(F.col("__turn") == size).agg(F.min("position")).first()[0]
            end = most if end is None else end
            break
        last = drawn_.where(F.col("__turn") == size - 1).agg(F.count("position"), F.max("position")).first()
        end = last[1] + 1 if last[0] == len(frames) else most
        if last[0] == len(frames) or not most:
            break
        most *= 2
    held = drawn_.where(F.col("position") < end).withColumn("__place", F.col("__turn") % size)
    out = None
    for i, f in enumerate(frames):
        rows = numbered(f, [], [order], "__place").join(held.where(F.col("source") == i).select("position", "__place"), "__place").drop("__place")
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_lines(a: DataFrame, b: DataFrame, c: DataFrame, order: str) -> DataFrame:
    """Two rows of a, one of b and one of c in turn while all three last, then the rest of a."""
    place = lambda f: numbered(f, [], [order], "place")
    rounds = min(a.count() // 2, b.count(), c.count())
    p = F.col("place")
    first = place(a).withColumn("position", F.when(p < 2 * rounds, F.floor(p / 2) * 4 + p % 2).otherwise(4 * rounds + p - 2 * rounds))
    rest = [place(f).where(p < rounds).withColumn("position", p * 4 + 2 + i) for i, f in enumerate((b, c))]
    return first.unionByName(rest[0]).unionByName(rest[1]).drop("place")


def chunked(df: DataFrame, order: str, size: int, whole: bool = False) -> DataFrame:
    """df with chunk: the number of its run of `size` rows; whole=True leaves the last, short run out."""
    out = numbered(df, [], [order], "place")
    out = out.where(F.col("place") < df.count() // size * size) if whole else out
    return out.withColumn("chunk", F.floor(F.col("place") / size)).drop("place")


def gathered(df: DataFrame, row: str, index: list[int]) -> DataFrame:
    """Rows by number in the order of `index`, repeats too, with position."""
    table = df.sparkSession.createDataFrame(list(enumerate(index)), f"position long, {row} long")
    return table.join(df, row)


def gathered_by(df: DataFrame, row: str, keep: DataFrame) -> DataFrame:
    """Rows by a mask (row, keep) over their numbers, in their order, with position from 0; numbers that the mask lacks go. A mask's null is false."""
    some = df.join(keep.where("keep").select(row), row, "left_semi")
    return numbered(some, [], [row], "position")


def repeated_by(df: DataFrame, order: str, times: str) -> DataFrame:
    """Each row as often as its own `times` says, copies side by side, with rep (from 0 in each row) and position (from 0 over all). A null or negative number is 0."""
    n = F.greatest(F.coalesce(times, F.lit(0)), F.lit(0)).cast("int")
    rep = df.where(n > 0).withColumn("rep", F.explode(F.sequence(F.lit(0), n - 1)))
    return numbered(rep, [], [order, "rep"], "position")


def aligned_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both tables by key; a column of both must have equal values, null and NaN equal to themselves, or it is an error."""
    both = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(key, *[F.col(c).alias(f"__{c}") for c in both], *[c for c in b.columns if c not in a.columns])
    out = a.join(other, key)
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs")).cast(a.schema[c].dataType)))
    return out.drop(*[f"__{c}" for c in both])


def checkpoint_order(name: str) -> list[Column]:
    """Sort keys: names with `checkpoint-N` by N, then the others, by name."""
    n = F.regexp_extract(name, r"checkpoint-(\d+)", 1)
    return [F.when(n != "", 0).otherwise(1), F.coalesce(n.try_cast("long"), F.lit(0)), F.col(name)]


def first_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows in an order that tells rows apart, nulls last. Each task keeps `most` rows before they meet."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(most)


def mini_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch and place (both 0-based): consecutive batches of `size` rows, which must divide the table's."""
    n = df.count()
    if size < 1 or n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    ranked = numbered(df, [], order, "__n")
    return ranked.select(*df.columns, F.floor(F.col("__n") / size).cast("long").alias("batch"), (F.col("__n") % size).alias("place"))


def context_filter(df: DataFrame, context: str, id_col: str, shares: dict[str, float], seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Rows of the contexts named, of each its share by a seeded order, and the shares of those kept, scaled to a sum of 1. n rows of
    a share p leave n - ceil((1 - p) * n). Contexts without a positive share or without rows go; a share above 1, no positive share, or nothing
    left is an error."""
    if sum(shares.values()) <= 0 or any(p > 1 for p in shares.values()):
        raise ValueError("shares must lie in 0 to 1 and not all be 0")
    asked = {c: p for c, p in shares.items() if p > 0}
    sizes = df.where(F.col(context).isin(list(asked))).groupBy(context).count()
    held = {r[context]: r["count"] for r in sizes.toLocalIterator()}  # a row a context asked for
    if not held:
        raise ValueError("no rows are left")
    plan = {(c,): n - math.ceil(round((1 - asked[c]) * n, 9)) for c, n in held.items()}
    total = sum(asked[c] for c in held)
    return drawn(df, [context], id_col, {k: n for k, n in plan.items() if n}, seed).drop("copy"), {c: asked[c] / total for c in asked if c in held}


def rest_budget(total: float, epoch: float, explicit: float | str | None = None) -> int:
    """floor((1 - epoch) * total), or the number given (text may carry a `# comment`); 0 at least."""
    if explicit is None:
        rest = (1 - epoch) * total
    else:
        text = str(explicit).split("#", 1)[0].strip()
        if not text:
            raise ValueError("the budget is empty")
        rest = float(text)
    return max(0, math.floor(rest))


def exact_counts(rows: DataFrame, op: str, cell: list[str], order: list[str], quotas: dict, done: DataFrame | None = None) -> DataFrame:
    """Of over-generated distinct rows as many of each op as its quota asks, less what `done` (op, n) already holds: one of each cell in turn (the
    columns `cell` in their order), a cell's rows by `order`, until the quota is full. Ops without a quota go. Rows are numbered by ranges and
    prefix sums twice, so that an op of a third of all rows is no single task's."""
    schema = T.StructType([rows.schema[op], T.StructField("__want", T.LongType())])
    want = rows.sparkSession.createDataFrame(list(quotas.items()), schema)  # a row an op
    some = rows.join(want, op)
    if done is not None:
        held = done.groupBy(op).agg(F.sum("n").alias("__done"))
        some = some.join(held, op, "left").withColumn("__want", F.col("__want") - F.coalesce("__done", F.lit(0))).drop("__done")
    turn = numbered(some, [op, *cell], order, "__turn")
    return numbered(turn, [op], ["__turn", *cell, *order], "__place").where("__place < __want").select(*rows.columns)


def limited_splits(rows: DataFrame, split: str, order: list[str], least: int, most: int, limit: int) -> DataFrame:
    """The first `limit` rows of each split from `least` to `most`, in order."""
    some = rows.where(F.col(split).between(least, most))
    return numbered(some, [split], order, "__n").where(F.col("__n") < limit).select(*rows.columns)


def take_skip(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with split: the first n are `validation`, the rest `train`. n is a whole number, not a share: a stream's length is not known."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError("a stream's validation rows are a whole number")
    ranked = numbered(rows, [], order, "__n")
    return ranked.select(*rows.columns, F.when(F.col("__n") < n, "validation").otherwise("train").alias("split"))


def buffer_shuffled(rows: DataFrame, order: list[str], size: int, seed: int = 42) -> DataFrame:
    """rows with buffer and position: consecutive buffers of `size` rows, each in a seeded order of its own. A buffer is one task's, and its
    size the bound."""
    ranked = numbered(rows, [], order, "__n")
    ranked = ranked.withColumn("buffer", F.floor(F.col("__n") / size).cast("long"))
    place = F.row_number().over(Window.partitionBy("buffer").orderBy(hashed(seed, "__n"), "__n")) - 1
    return ranked.withColumn("position", F.col("buffer") * size + place).select(*rows.columns, "buffer", "position")


def logged_samples(rows: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """n rows for a table of validation samples, by a seeded order of their text, so that reruns and other partitionings agree; equal texts are
    told apart by the other columns. Each task keeps n before they meet."""
    every = [c for c in rows.columns if c != text]
    return rows.orderBy(hashed(seed, text), text, *every).limit(n)
