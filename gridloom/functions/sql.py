"""Expressions as SQL text in two dialects: Spark's, which the operators run, and DuckDB's, for checks on the same tables.

Every ratio is guarded with NULLIF, logarithms and roots with CASE, and missing values are NULL throughout. A rolling kernel gives a value only
where all rows of its frame have one (the full-window rule), so it needs a dense calendar.
"""

from __future__ import annotations


class Dialect:
    """Text of the constructs in which the two engines differ, and of the shared kernels built on them."""

    def __init__(self, spark: bool):
        self.spark = spark

    # windows ---------------------------------------------------------------------------------------------------------
    @staticmethod
    def ts(k: int | None = None, shift: int = 0) -> str:
        """Rows of an instrument: the last k up to ``shift`` rows ago; all up to now for None."""
        low = "UNBOUNDED PRECEDING" if k is None else f"{k - 1 + shift} PRECEDING"
        high = f"{shift} PRECEDING" if shift else "CURRENT ROW"
        return f"(PARTITION BY inst ORDER BY dt ROWS BETWEEN {low} AND {high})"

    XS = "(PARTITION BY dt)"

    def full(self, agg: str, x: str, k: int) -> str:
        w = self.ts(k)
        return f"CASE WHEN count({x}) OVER {w} = {k} THEN {agg} OVER {w} END"

    def mean(self, x, k):
        return self.full(f"avg({x})", x, k)

    def sum(self, x, k):
        return self.full(f"sum({x})", x, k)

    def std(self, x, k):
        return self.full(f"stddev_samp({x})", x, k)

    def stdp(self, x, k):
        return self.full(f"stddev_pop({x})", x, k)

    def var(self, x, k):
        return self.full(f"var_samp({x})", x, k)

    def max(self, x, k):
        return self.full(f"max({x})", x, k)

    def min(self, x, k):
        return self.full(f"min({x})", x, k)

    def both(self, agg: str, x: str, y: str, k: int) -> str:
        w = self.ts(k)
        return f"CASE WHEN count({x} + {y}) OVER {w} = {k} THEN {agg} OVER {w} END"

    def cov(self, x, y, k):
        return self.both(f"covar_samp({x}, {y})", x, y, k)

    def corr(self, x, y, k):
        """Null where either side is constant (up to rounding) in the frame."""
        w = self.ts(k)
        sx, sy = f"stddev_pop({x}) OVER {w}", f"stddev_pop({y}) OVER {w}"
        return f"CASE WHEN count({x} + {y}) OVER {w} = {k} AND {sx} > 1e-10 AND {sy} > 1e-10 THEN covar_pop({x}, {y}) OVER {w} / NULLIF({sx} * {sy}, 0) END"

    @staticmethod
    def lag(x, k=1):
        return f"lag({x}, {k}) OVER (PARTITION BY inst ORDER BY dt)"

    @staticmethod
    def lead(x, k=1):
        return f"lead({x}, {k}) OVER (PARTITION BY inst ORDER BY dt)"

    @staticmethod
    def div(a, b):
        return f"({a}) / NULLIF({b}, 0)"

    @staticmethod
    def ln(x):
        return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"

    @staticmethod
    def clip(x, low, high):
        return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END"

    @staticmethod
    def out(x, digits=6):
        return f"round({x}, {digits}) + 0.0e0"

    def last(self, x: str, order: str = "PARTITION BY inst ORDER BY dt") -> str:
        """The last value that is not null, up to now."""
        return f"last_value({x}, true) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if self.spark else f"last_value({x} IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def next(self, x: str) -> str:
        """The first value that is not null, from now on."""
        frame = "(PARTITION BY inst ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        return f"first_value({x}, true) OVER {frame}" if self.spark else f"first_value({x} IGNORE NULLS) OVER {frame}"

    def quantile(self, x: str, q: float, over: str = "") -> str:
        f = f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"
        return f"{f} OVER {over}" if over else f

    def rolled(self, x: str, k: int) -> str:
        """The frame's values, oldest first; null unless all are there."""
        f = f"collect_list({x})" if self.spark else f"list({x})"
        return self.full(f, x, k)

    def fold(self, values: str, start: str, step: str, fields: tuple[str, ...] = ()) -> str:
        """Left fold; step is an expression in ``a`` (the state) and ``x``. A state of several fields is an array of doubles: a[1] .. in step, as {1} ..."""
        for k in range(9):
            step = step.replace("{%d}" % k, f"a[{k - 1}]" if self.spark else f"a[{k}]")
        if self.spark:
            return f"aggregate({values}, {start}, (a, x) -> {step})"
        return f"list_reduce({values}, lambda a, x: {step}, {start})"

    def states(self, *xs: str) -> str:
        cast = [f"CAST({x} AS DOUBLE)" for x in xs]
        return f"array({', '.join(cast)})" if self.spark else f"[{', '.join(cast)}]"

    def pair(self, x: str, y: str) -> str:
        """A value of two fields, ordered by x, then y."""
        return f"named_struct('x', {x}, 'y', {y})" if self.spark else f"{{'x': {x}, 'y': {y}}}"

    def item(self, values: str, k: int) -> str:
        """k from 1."""
        return f"element_at({values}, {k})" if self.spark else f"({values})[{k}]"

    def mapped(self, values: str, expr: str) -> str:
        return f"transform({values}, x -> {expr})" if self.spark else f"list_transform({values}, lambda x: {expr})"

    def zipped(self, values: str, weights: list[float]) -> str:
        """Sum of values times weights, for values given as an array of the same length."""
        w = ", ".join(f"CAST({x!r} AS DOUBLE)" for x in weights)
        if self.spark:
            return f"aggregate(zip_with({values}, array({w}), (x, y) -> x * y), CAST(0 AS DOUBLE), (a, x) -> a + x)"
        return f"list_sum(list_transform({values}, lambda x, i: x * ([{w}])[i]))"

    def sorted(self, values: str) -> str:
        return f"array_sort({values})" if self.spark else f"list_sort({values})"

    def head(self, values: str, k: int) -> str:
        return f"slice({values}, 1, {k})" if self.spark else f"list_slice({values}, 1, {k})"

    def total(self, values: str) -> str:
        return f"aggregate({values}, CAST(0 AS DOUBLE), (a, x) -> a + x)" if self.spark else f"list_sum({values})"


SPARK, DUCK = Dialect(True), Dialect(False)
