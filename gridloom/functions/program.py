"""Programs: stages of named expressions, each over the columns of the stages before."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from gridloom.functions.sql import DUCK, SPARK, Dialect

Stage = Mapping[str, str]
Program = Callable[[Dialect], Sequence[Stage]]


def apply(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Adds every stage's columns; Catalyst gathers those of a stage that share a window into one pass."""
    for s in stages:
        df = df.selectExpr("*", *[f"{x} AS {n}" for n, x in s.items()])
    return df


def finish(df: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 6, exact: Sequence[str] = ()) -> DataFrame:
    """exact: columns that are the same to the last bit in any engine, and stay as they are."""
    return df.selectExpr(*keys, *[n if n in exact else f"{SPARK.out(n, digits)} AS {n}" for n in names])


def text(source: str, stages: Sequence[Stage], keys: Sequence[str], names: Sequence[str], digits: int = 6, exact: Sequence[str] = ()) -> str:
    """The same program as DuckDB SQL over ``source`` (a list of CTEs that ends with one named ``panel``)."""
    ctes, before = [source], "panel"
    for i, s in enumerate(stages):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in s.items())} FROM {before})")
        before = f"s{i}"
    cols = ", ".join([*keys, *[n if n in exact else f"{DUCK.out(n, digits)} AS {n}" for n in names]])
    return f"WITH {', '.join(ctes)} SELECT {cols} FROM {before}"
