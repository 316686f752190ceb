"""Ordered analytics: percentiles, cumulative shares, fills, running ids, runs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_of_positive(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Adds ``percentile``: the share of positive values not greater, ties alike; 0 for values that are not positive."""
    positive = F.col(column) > 0
    w = Window.partitionBy(*by, positive).orderBy(column)
    return df.withColumn("percentile", F.when(positive, F.cume_dist().over(w)).otherwise(0.0))


def running(df: DataFrame, order: str, value: str, to: str = "running") -> DataFrame:
    """Adds ``to``: the sum of ``value`` up to and with a row, by ``order``, whose values are distinct; nulls first.

    Rows are range-partitioned and summed within partitions; a partition begins at the sum
    of those before, a table of one row a partition.
    """
    from loomgraph.functions.scratch import stored

    ordered = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))  # range bounds come from a sample: fix them
    parts = ordered.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = parts.withColumn("_before", F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).drop("_s")
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ordered.join(F.broadcast(before), "_part").withColumn(to, F.sum(value).over(w) + F.col("_before")).drop("_part", "_before")


def percentile_ranks(df: DataFrame, column: str, to: str, positive_only: bool = False) -> DataFrame:
    """Adds ``to``: the global percentile rank, ties alike, from running counts per distinct value instead of a window over all rows.

    With ``positive_only`` other values get 0.
    """
    own = df.where(F.col(column) > 0) if positive_only else df
    counts = running(own.groupBy(column).agg(F.count("*").alias("_n")), column, "_n", "_up_to")
    ranks = counts.join(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).select(column, (F.col("_up_to") / F.col("_all")).alias(to))
    return df.join(ranks, column, "left").withColumn(to, F.coalesce(to, F.lit(0.0)))


def cumulative(df: DataFrame, weight: str = "weight", mass: str = "mass") -> DataFrame:
    """Adds ``share`` (cumulative, by rising weight) and ``place`` (by falling weight) to rows of distinct weights."""
    up = running(running(df.withColumn("_one", F.lit(1)), weight, mass, "_mass"), weight, "_one", "_place")
    totals = up.agg(F.sum(mass).alias("_all"), F.count("*").alias("_rows"))
    made = up.join(F.broadcast(totals)).withColumn("share", F.col("_mass") / F.col("_all")).withColumn("place", (F.col("_rows") - F.col("_place") + 1).cast("int"))
    return made.select(*df.columns, "share", "place")


#: Rows of a group that one task orders; beyond, groups are dealt to tasks by ranges.
GROUP_ROWS = 1_000_000


def _long_groups(df: DataFrame, by: list[str], most: int) -> bool:
    """Whether a group has more rows than one task is to order; counted, with partial counts in the tasks."""
    top = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return bool(top and top > most)


def _ranged(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_part``, a part of the order by group and ``order``; (_part, *by) of the groups that stand in several parts)."""
    from loomgraph.functions.scratch import stored

    rows = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))  # range bounds come from a sample: fix them
    several = rows.groupBy(*by).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).where("_first < _last")
    spread = several.select(*by, F.explode(F.sequence("_first", "_last")).alias("_part"))  # two groups a part at most
    return rows, spread


def _same(by: list[str]) -> Column:
    """A key that is equal for equal groups, nulls alike."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def filled(df: DataFrame, column: str, by: list[str], order: list[str], most: int = GROUP_ROWS) -> DataFrame:
    """Adds ``forward`` and ``backward``: the last and the next value that is not null.

    Groups of over ``most`` rows are scanned in ranges: each range of a group keeps its last and
    first value, these are carried over ranges as a table of two rows a range, and
    only then rows without a value of their own range take what was carried.
    """
    if not _long_groups(df, by, most):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("forward", F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("backward", F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows, spread = _ranged(df, by, order)
    place = F.struct(*order)
    ends = rows.where(F.col(column).isNotNull()).groupBy("_part", *by).agg(F.max_by(column, place).alias("_end"), F.min_by(column, place).alias("_begin"))
    keyed = spread.select("_part", _same(by).alias("_key")).join(ends.select("_part", _same(by).alias("_key"), "_end", "_begin"), ["_part", "_key"], "left")
    over = Window.partitionBy("_key").orderBy("_part")
    carried = keyed.select("_part", "_key", F.last("_end", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_begin", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    own = rows.withColumn("forward", F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("backward", F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = own.withColumn("_key", _same(by)).join(F.broadcast(carried), ["_part", "_key"], "left")
    return out.select(*df.columns, F.coalesce("forward", "_before").alias("forward"), F.coalesce("backward", "_after").alias("backward"))


def running_sums(df: DataFrame, by: list[str], order: list[str], value: Column, to: str, most: int = GROUP_ROWS) -> DataFrame:
    """Adds ``to``: the sum of ``value`` (a column that is never null) up to and with a row in its group; groups of over ``most`` rows by carried sums of their ranges."""
    if not _long_groups(df, by, most):
        return df.withColumn(to, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows, spread = _ranged(df.withColumn("_value", value), by, order)
    sums = rows.groupBy("_part", *by).agg(F.sum("_value").alias("_s")).select("_part", _same(by).alias("_key"), "_s")
    over = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select("_part", _same(by).alias("_key")).join(sums, ["_part", "_key"]).select("_part", "_key", F.sum("_s").over(over).alias("_before"))
    own = rows.withColumn(to, F.sum("_value").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    out = own.withColumn("_key", _same(by)).join(F.broadcast(carried), ["_part", "_key"], "left")
    return out.select(*df.columns, (F.col(to) + F.coalesce("_before", F.lit(0))).alias(to))


def running_ids(df: DataFrame, group: str, order: list[str], most: int = GROUP_ROWS) -> DataFrame:
    """Adds ``running_id``: the group's id, an underscore and the row's place in it."""
    numbered = running_sums(df, [group], order, F.lit(1), "_k", most)
    return numbered.withColumn("running_id", F.concat_ws("_", F.col(group).cast("string"), (F.col("_k") - 1).cast("string"))).drop("_k")


def global_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Adds consecutive numbers in the stated order.

    Rows are range-partitioned and numbered within partitions; partitions start at the
    sum of the counts before, a table of one row a partition.
    """
    from loomgraph.functions.scratch import stored

    ordered = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ordered = stored(ordered)  # range bounds come from a sample: fix them before counting
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    numbered = ordered.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_k") - 1).drop("_part", "_k", "_start")


def offsets(df: DataFrame, by: list[str], order: list[str], length: Column, gap: int = 1, most: int = GROUP_ROWS) -> DataFrame:
    """Adds ``start``: the sum of lengths and gaps before a row in its group."""
    size = length + gap
    return running_sums(df, by, order, size, "start", most).withColumn("start", F.col("start") - size)


def rescaled(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Adds ``scaled``: min-max into [low, high]; and the column's ``high``. One row of bounds is broadcast."""
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("high"))
    return df.join(F.broadcast(bounds)).withColumn("scaled", low + (high - low) * (F.col(column) - F.col("_low")) / (F.col("high") - F.col("_low"))).drop("_low")


def runs(df: DataFrame, by: list[str], order: list[str], column: str, most: int = GROUP_ROWS) -> DataFrame:
    """Adds ``run``: the number of the run of equal values that a row is in.

    In groups of over ``most`` rows a range's first row looks at the last value of the range before, and numbers are carried sums.
    """
    if not _long_groups(df, by, most):
        w = Window.partitionBy(*by).orderBy(*order)
        new = F.when(F.lag(column).over(w).eqNullSafe(F.col(column)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
    rows, spread = _ranged(df, by, order)
    ends = rows.groupBy("_part", *by).agg(F.max_by(F.struct(column), F.struct(*order)).alias("_end")).select("_part", _same(by).alias("_key"), "_end")
    over = Window.partitionBy("_key").orderBy("_part")
    carried = spread.select("_part", _same(by).alias("_key")).join(ends, ["_part", "_key"]).select("_part", "_key", F.lag("_end").over(over).alias("_before"))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    before = F.coalesce(F.lag(F.struct(column)).over(w), "_before")
    marked = rows.withColumn("_key", _same(by)).join(F.broadcast(carried), ["_part", "_key"], "left").withColumn("_new", F.when(before.isNotNull() & before[column].eqNullSafe(F.col(column)), 0).otherwise(1))
    return running_sums(marked.select(*df.columns, "_new"), by, order, F.col("_new"), "run", most).drop("_new")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def mode_label(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value per group; ties go to the shorter, then the lesser one."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), F.length(column), F.col(column))
    return counts.groupBy(*by).agg(F.min_by(column, order).alias(column))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share): relative frequencies; the total is one broadcast row."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    return counts.join(F.broadcast(counts.agg(F.sum("_n").alias("_t")))).select(column, (F.col("_n") / F.col("_t")).alias("share"))


def chunks(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Adds ``chunk``: rows in a seeded random order, ``size`` to a chunk."""
    shuffled = global_ids(df.withColumn("_r", F.xxhash64(F.col(key), F.lit(seed))), ["_r", key], "_id")
    return shuffled.withColumn("chunk", F.floor(F.col("_id") / size).cast("long")).drop("_r", "_id")
