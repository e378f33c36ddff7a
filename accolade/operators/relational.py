"""Relational steps that the award plans share: first wins, carried headings, ties, gaps, key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accolade.operators.rounds import safe_on
from accolade.sources.shared import Kept


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Of rows with equal keys (null equals null) the first in order. Rows are reduced within tasks first, so keys may be hot."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def in_order_once(at: Column, value: Column) -> Column:
    """An aggregate: the different values of a group, in the order of each one's first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("value")))), lambda x: x["value"]))


def without_identities(df: DataFrame, row: list[str], where: Column, corrected: DataFrame, on: list[str], keys: str) -> DataFrame:
    """df without the rows for which `where` holds and that agree with a row of corrected on `on` and share one of the keys (an array); row tells rows apart."""
    right = corrected.select(*on, F.explode(keys).alias("_key")).distinct()
    wrong = df.where(where).select(*row, *[c for c in on if c not in row], F.explode(keys).alias("_key"))
    return df.join(wrong.join(right, [*on, "_key"], "left_semi").select(*row).distinct(), row, "left_anti")


def numbered(df: DataFrame, order: list[str], name: str, group: list[str] | None = None, descending: tuple[str, ...] = ()) -> DataFrame:
    """df with the place (from 1) of each row in the order, within its group if one is given, without a task that sees all rows of it.

    Rows are dealt by ranges of (group, order) and sorted there; a range starts where those before it end, and groups start
    where their first row is. The order should tell rows apart: equal ones get places in any order. The rows are stored once.
    """
    group = group or []
    by = [*group, *[F.col(c).desc() if c in descending else F.col(c).asc() for c in order]]
    kept = Kept(df.sparkSession, "places")
    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_from"))
    starts = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_from")).alias("_start"))
    rows = rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_in") + F.col("_start") + 1).drop("_part", "_in", "_start")
    if not group:
        return rows
    first = rows.groupBy(*group).agg(F.min(name).alias("_first")).alias("g")
    return rows.alias("r").join(first, safe_on("r", "g", group)).select("r.*", "g._first").withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def carry_forward(value: Column, keys: list, order: list) -> Column:
    """The last value that is not null, up to a row."""
    return F.last_value(value, ignoreNulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def is_shared(keys: list) -> Column:
    """Whether more than one row has a row's keys."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def gaps(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected that found lacks."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def gap_message(missing: DataFrame, group: list[str], year: str, prefix: Column) -> DataFrame:
    """group and message: the first missing year, and how many more there are."""
    first, n = F.min(year), F.count(F.lit(1))
    more = F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return missing.groupBy(*group).agg(F.concat(F.any_value(prefix), first.cast("string"), more).alias("message"))


def key_join(left: DataFrame, right: DataFrame, left_keys: str, right_keys: str, on: list[str], left_id: list[str], right_id: list[str]) -> DataFrame:
    """Pairs of ids whose key arrays meet and that agree on `on`: an equi-join of exploded keys, each pair once."""
    a = left.select(*left_id, *on, F.explode(left_keys).alias("_key"))
    b = right.select(*right_id, *on, F.explode(right_keys).alias("_key"))
    return a.join(b, [*on, "_key"]).select(*left_id, *right_id).distinct()


def only_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that have exactly one match."""
    return matches.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def year_in_range(year: Column, start: Column, end: Column) -> Column:
    """Inclusive; an open bound holds for any year, a set one for no unknown year."""
    return F.coalesce(start.isNull() | (year >= start), F.lit(False)) & F.coalesce(end.isNull() | (year <= end), F.lit(False))
