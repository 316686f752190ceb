"""Relational steps that take more than one built-in: zips by position, lookups, incidence, correlation, pooling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.windows import global_ids


def zip_rows(left: DataFrame, right: DataFrame, order: list[str], drop_repeated: bool = True) -> DataFrame:
    """Two frames side by side by position, each in the stated order; the longer one's rest has nulls on the other side.

    Columns that the right frame repeats are dropped, as are the positions.
    """
    a, b = global_ids(left, order, "_at"), global_ids(right, order, "_at")
    if drop_repeated:
        b = b.select("_at", *[c for c in right.columns if c not in left.columns])
    return a.join(b, "_at", "full_outer").drop("_at")


def first_range(points: DataFrame, ranges: DataFrame, by: str, at: str, start: str = "start", end: str = "end", number: str = "i") -> DataFrame:
    """Points with the least ``number`` of the half-open ranges that hold them; points in no range are left out."""
    met = points.join(ranges, by).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return met.groupBy(*points.columns).agg(F.min(number).alias(number))


def items_at(items: Column, places: Column) -> Column:
    """The elements at 0-based places; null for a place outside."""
    return F.transform(places, lambda i: F.try_element_at(items, i + 1))


def keep_last(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes last in the stated order, whole."""
    return df.groupBy(*by).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def incidence(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One row a ``row`` and a boolean column for each of the values: whether the two occur together."""
    return df.groupBy(row).agg(*[F.coalesce(F.bool_or(F.col(column) == v), F.lit(False)).alias(v) for v in values])


def correlations(df: DataFrame, columns: list[str], above: float | None = None) -> DataFrame:
    """(a, b, r): Pearson correlation of every two columns, each pair once, undefined ones left out; one pass over the table."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    long = one.select(F.inline(rows)).where("r IS NOT NULL AND NOT isnan(r)")
    return long if above is None else long.where(F.col("r") > above)


def aligned_explode(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Array columns exploded together: the shorter ones are filled, a row without elements stays with one filled row."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline_outer(F.arrays_zip(*columns))).fillna(fill, columns)


def same_common_order(a: Column, b: Column) -> Column:
    """Whether two arrays, each cut down to elements of the other, are equal."""
    return F.filter(a, lambda x: F.array_contains(b, x)) == F.filter(b, lambda x: F.array_contains(a, x))


def map_by_number(df: DataFrame, by: str, number: str, value: str, to: str = "tags") -> DataFrame:
    """(by, map from number to value), keys in order; the greatest value where a number repeats."""
    one = df.groupBy(by, number).agg(F.max(value).alias(value))
    return one.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(number, value)))).alias(to))


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, i, mean): element-wise means of vectors, summed per element before the shuffle, so no group's vectors are gathered."""
    v = df.select(by, F.posexplode(vector).alias("i", "x"))
    return v.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def numbered_fields(df: DataFrame, source: str, prefix: str, to: str = "value") -> DataFrame:
    """One row for each JSON field ``{prefix}{k}`` of a text column, with its number ``k``."""
    others = [c for c in df.columns if c != source]
    long = df.select(*others, F.explode(F.from_json(source, "map<string,string>")).alias("_key", to)).where(F.col("_key").rlike(f"^{prefix}[0-9]+$"))
    return long.select(*others, to, F.regexp_extract("_key", "([0-9]+)$", 1).cast("int").alias("k"))


def labelled(df: DataFrame, codes: DataFrame, column: str, to: str = "label") -> DataFrame:
    """Adds the label of a code from ``codes(code, label)``; unknown codes keep themselves."""
    return df.join(codes.select(F.col("code").alias(column), F.col("label").alias("_label")), column, "left").withColumn(to, F.coalesce("_label", column)).drop("_label")


def value_maps(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, counts): a map from each value to how often it occurs, keys in order."""
    c = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return c.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def counts_with_members(members: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n) for every member, 0 where it has no rows."""
    return members.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])
