"""Relational operators of a panel store as DataFrame functions: upserts, snapshots, cascades, as-of and interval joins, set operations, filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark leveraged products.
LEVERAGE_WORDS = ("leveraged", "leverage", "2x", "3x", "ultra", "double", "triple", "levered", "geared", "x2", "x3", "200%", "300%")


def universe(df: DataFrame, *, ids: Sequence | None = None, prefix: str | None = None, least_size: float | None = None, most_ter: float | None = None, currency: str | None = None, exchange: Sequence[str] | None = None, numeric_id: bool = False, least_months: int | None = None) -> DataFrame:
    """Conjunction of the conditions that are given; a null fails them."""
    c = F.lit(True)
    if ids is not None:
        c &= F.col("isin").isin(list(ids))
    if prefix is not None:
        c &= F.col("name").startswith(prefix)
    if least_size is not None:
        c &= F.col("fund_size") >= least_size
    if most_ter is not None:
        c &= F.col("ter") <= most_ter
    if currency is not None:
        c &= F.col("currency") == currency
    if exchange is not None:
        c &= F.col("exchange").isin(list(exchange))
    if numeric_id:
        c &= F.col("isin").cast("string").rlike(r"^\d+$")
    if least_months is not None:
        c &= F.col("months_of_data") >= least_months
    return df.where(c)


def without_words(df: DataFrame, column: str, words: Sequence[str] = LEVERAGE_WORDS) -> DataFrame:
    """Rows whose text holds none of the words in any case; a null is kept."""
    import re

    hit = F.lower(F.col(column)).rlike("|".join(re.escape(w) for w in words))
    return df.where(~F.coalesce(hit, F.lit(False)))


def require(df: DataFrame, key: str, value, size: str | None = None, least: float = 0.0) -> DataFrame:
    """df, if it holds the instrument and that is large enough; else ValueError. Reads the rows of that key alone."""
    found = df.where(F.col(key) == value).agg(F.count("*"), F.max(size) if size else F.lit(None)).first()
    if not found[0]:
        raise ValueError(f"{key} {value} is not there")
    if size and (found[1] is None or found[1] < least):
        raise ValueError(f"{size} of {key} {value} is {found[1]}, below {least}")
    return df


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def map_values(column: Column, values: Mapping, default: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def upsert(dim: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Inserts new keys; for known ones a value of delta replaces the old one unless it is null."""
    rest = [c for c in dim.columns if c != key]
    d = delta.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in rest])
    return dim.join(d, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def replace_facts(facts: DataFrame, delta: DataFrame, keys: Sequence[str], replace: bool = False) -> DataFrame:
    """Latest wins by key; nulls in delta's value are dropped. replace: an instrument in delta loses all old rows."""
    delta = delta.where(F.col("price").isNotNull())
    if replace:
        return facts.join(delta.select(keys[0]).distinct(), keys[0], "left_anti").unionByName(delta)
    both = facts.withColumn("_v", F.lit(0)).unionByName(delta.withColumn("_v", F.lit(1)))
    return first_per(both, keys, [F.desc("_v")]).drop("_v")


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Appends rows whose keys aren't there."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti"))


def delete_cascade(tables: Mapping[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def asof(left: DataFrame, right: DataFrame, on: str, value: str, by: Sequence[str] = (), direction: str = "backward", else_first: bool = False) -> DataFrame:
    """left with the value of right's last row at or before (``backward``), or first at or after (``forward``), its ``on``, by group. else_first: where
    there is none, the first value of the group.

    A union and one ordered window instead of a range join: rows are compared within their group only."""
    at = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    cols = [c for c in left.columns if c not in (*by, on)]
    from_ = right.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols])
    side = F.col("_side") if direction == "backward" else -F.col("_side")
    w = Window.partitionBy(*by).orderBy(on, side)
    if direction == "backward":
        got = F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        got = F.first("_v", True).over(Window.partitionBy(*by).orderBy(on, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing))
    if else_first:
        got = F.coalesce(got, F.first("_v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return at.unionByName(from_).withColumn(f"asof_{value}", got).where("_side = 1").select(*left.columns, f"asof_{value}")


def periods(points: DataFrame, column: str) -> DataFrame:
    """Consecutive points as (period, start, end)."""
    w = Window.partitionBy(F.lit(0)).orderBy(column)
    return points.select(F.row_number().over(w).cast("long").alias("period"), F.col(column).alias("start"), F.lead(column).over(w).alias("end")).where("end IS NOT NULL")


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side) with side only_old, only_new or common."""
    o, n = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    side = F.when(F.col("n").isNull(), "only_old").when(F.col("o").isNull(), "only_new").otherwise("common")
    return o.join(n, key, "full").select(key, side.alias("side"))


def decode_ohlc(df: DataFrame) -> DataFrame:
    """df(base date, bars array<struct<offset, open, high, low, close>>) to a row for each bar with its date."""
    return df.select("*", F.explode("bars").alias("bar")).select("id", F.date_add("base", F.col("bar.offset")).alias("dt"), "bar.open", "bar.high", "bar.low", "bar.close")
