"""Price panels (inst, dt, p) from the driver's tables, as dense calendars: every instrument has a row for every date, and p is null
where there is no price.

The calendar is the distinct dates, a small table next to the facts; crossing it with the distinct instruments is bounded by the panel itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.sql import DUCK, SPARK, Dialect

#: Sums of money and quantities are exact, so a price doesn't hang on the order of rows.
PRICE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE)"

#: name: (facts with inst, dt, p; core instrument, forward filled?)
FACTS = {
    "monthly": (
        f"SELECT CAST(l_suppkey AS BIGINT) AS inst, CAST(last_day(l_shipdate) AS DATE) AS dt, {PRICE} AS p FROM lineitem GROUP BY 1, 2",
        "min(inst)",
    ),
    "daily": (
        f"SELECT p_brand AS inst, CAST(l_shipdate AS DATE) AS dt, {PRICE} AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
        "min(inst)",
    ),
    "regional": (
        f"SELECT CAST(n_regionkey AS BIGINT) AS inst, CAST(l_shipdate AS DATE) AS dt, {PRICE} AS p "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
        "min(inst)",
    ),
    "users": ("SELECT user_id AS inst, CAST(ts AS DATE) AS dt, avg(value) AS p FROM events GROUP BY 1, 2", "min(inst)"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The star schema's tables as temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_GRID = "SELECT i.inst, d.dt, f.p FROM (SELECT DISTINCT inst FROM facts) i CROSS JOIN (SELECT DISTINCT dt FROM facts) d LEFT JOIN facts f ON f.inst = i.inst AND f.dt = d.dt"
_FILL = "SELECT inst, dt, {last} AS p FROM grid"
_CORE = "SELECT *, max(CASE WHEN inst = core THEN p END) OVER (PARTITION BY dt) AS cp FROM (SELECT *, (SELECT {core} FROM facts) AS core FROM {grid}) g"


def ctes(name: str, filled: bool = False, d: Dialect = DUCK) -> str:
    """CTEs of a panel (inst, dt, p, core, cp); the last is named panel."""
    facts, core = FACTS[name]
    grid = "filled" if filled else "grid"
    last = d.last("p")
    return f"facts AS ({facts}), grid AS ({_GRID}), filled AS ({_FILL.format(last=last)}), panel AS ({_CORE.format(core=core, grid=grid)})"


def panel(spark: SparkSession, sf_dir: str, name: str, filled: bool = False) -> DataFrame:
    """The panel with its core instrument's key (core) and price on the date (cp). filled: the last price stands in for missing ones."""
    views(spark, sf_dir)
    facts, core = FACTS[name]
    f = spark.sql(facts)
    one = f.selectExpr(f"{core} AS core").first()[0]
    grid = f.select("inst").distinct().crossJoin(f.select("dt").distinct()).join(f, ["inst", "dt"], "left")
    if filled:
        grid = grid.selectExpr("inst", "dt", f"{SPARK.last('p')} AS p")
    literal = f"'{one}'" if isinstance(one, str) else f"CAST({one} AS BIGINT)"
    return grid.selectExpr("inst", "dt", "p", f"{literal} AS core", f"max(CASE WHEN inst = {literal} THEN p END) OVER (PARTITION BY dt) AS cp")
