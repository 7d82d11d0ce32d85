"""Queries of the relational operators, over a universe made of suppliers and prices made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import relational as rel
from gridloom.registry import QUERIES, SQL
from gridloom.sources import panels

UNIVERSE = "SELECT s_suppkey AS isin, s_name AS name, s_acctbal AS fund_size, n_name AS exchange, CAST(s_suppkey % 60 AS INT) AS months_of_data FROM supplier JOIN nation ON s_nationkey = n_nationkey"
PRICES = panels.FACTS["daily"][0]
PRICES_SQL = f"SELECT inst AS isin, dt, p AS price FROM ({PRICES}) q"
DELTA_SQL = "SELECT isin + 2 AS isin, name, CASE WHEN isin % 3 = 0 THEN NULL ELSE fund_size + 1 END AS fund_size, CASE WHEN isin % 2 = 0 THEN NULL ELSE 'new' END AS exchange, months_of_data FROM u WHERE isin % 4 = 0"


def _sql(spark, sf_dir, text):
    panels.views(spark, sf_dir)
    return spark.sql(text)


def add(name, sql):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


@add("universe_filter", f"SELECT * FROM ({UNIVERSE}) u WHERE fund_size >= 75 AND name LIKE 'Supplier%' AND months_of_data >= 12 AND regexp_matches(CAST(isin AS VARCHAR), '^[0-9]+$')")
def universe_filter(spark, sf_dir):
    return rel.universe(_sql(spark, sf_dir, UNIVERSE), prefix="Supplier", least_size=75, least_months=12, numeric_id=True)


@add("keyword_exclude", "SELECT p_partkey, p_name FROM part WHERE NOT coalesce(regexp_matches(lower(p_name), '1|steel|green'), false)")
def keyword_exclude(spark, sf_dir):
    return rel.without_words(_sql(spark, sf_dir, "SELECT p_partkey, p_name FROM part"), "p_name", ("1", "steel", "green"))


@add("dedup_latest", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) q WHERE k = 1")
def dedup_latest(spark, sf_dir):
    return rel.first_per(_sql(spark, sf_dir, "SELECT p_brand, p_partkey, p_size FROM part"), ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")])


@add("enrich_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def enrich_lookup(spark, sf_dir):
    s = _sql(spark, sf_dir, "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0")
    n, r = spark.table("nation"), spark.table("region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@add("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'XFIN' WHEN 'O' THEN 'XOPN' ELSE 'OTHER' END AS code FROM orders")
def value_map(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM orders").select("o_orderkey", rel.map_values(F.col("o_orderstatus"), {"F": "XFIN", "O": "XOPN"}, "OTHER").alias("code"))


def _two(spark, sf_dir):
    u = _sql(spark, sf_dir, UNIVERSE)
    u.createOrReplaceTempView("u")
    return u, spark.sql(DELTA_SQL)


@add("upsert_coalesce", f"WITH u AS ({UNIVERSE}), d AS ({DELTA_SQL}) SELECT coalesce(u.isin, d.isin) AS isin, coalesce(d.name, u.name) AS name, coalesce(d.fund_size, u.fund_size) AS fund_size, coalesce(d.exchange, u.exchange) AS exchange, coalesce(d.months_of_data, u.months_of_data) AS months_of_data FROM u FULL JOIN d ON u.isin = d.isin")
def upsert_coalesce(spark, sf_dir):
    u, d = _two(spark, sf_dir)
    return rel.upsert(u, d, "isin")


_FACT_DELTA = "SELECT isin, dt, CASE WHEN day(dt) = 1 THEN NULL ELSE price * 2 END AS price FROM f WHERE day(dt) <= 3"


@add("replace_facts", f"WITH f AS ({PRICES_SQL}), d AS (SELECT * FROM ({_FACT_DELTA}) q WHERE price IS NOT NULL) SELECT f.isin, f.dt, coalesce(d.price, f.price) AS price FROM f LEFT JOIN d ON f.isin = d.isin AND f.dt = d.dt")
def replace_facts(spark, sf_dir):
    f = _sql(spark, sf_dir, PRICES_SQL)
    f.createOrReplaceTempView("f")
    return rel.replace_facts(f, spark.sql(_FACT_DELTA), ["isin", "dt"]).select("isin", "dt", "price")


@add("snapshot_ignore", f"WITH u AS ({UNIVERSE}), s AS (SELECT isin, DATE '2024-01-31' AS snapshot_date, fund_size FROM u WHERE isin % 2 = 0) SELECT * FROM s UNION ALL SELECT isin, DATE '2024-01-31', fund_size * 2 FROM u WHERE isin NOT IN (SELECT isin FROM s)")
def snapshot_ignore(spark, sf_dir):
    u = _sql(spark, sf_dir, UNIVERSE).select("isin", F.to_date(F.lit("2024-01-31")).alias("snapshot_date"), "fund_size")
    return rel.insert_new(u.where("isin % 2 = 0"), u.withColumn("fund_size", F.col("fund_size") * 2), ["isin", "snapshot_date"])


@add("delete_cascade", "SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey % 5 <> 0")
def delete_cascade(spark, sf_dir):
    panels.views(spark, sf_dir)
    t = {"orders": spark.table("orders").select(F.col("o_orderkey").alias("k")), "lineitem": spark.table("lineitem").select(F.col("l_orderkey").alias("k"))}
    out = rel.delete_cascade(t, "k", t["orders"].where("k % 5 = 0"))
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n, d in out.items()]
    return parts[0].unionByName(parts[1])


@add("orphan_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_lines")
def orphan_semi_anti(spark, sf_dir):
    panels.views(spark, sf_dir)
    c, o, li = (spark.table(t) for t in ("customer", "orders", "lineitem"))
    on, line = c.c_custkey == o.o_custkey, li.l_orderkey == o.o_orderkey
    a = c.join(o, on, "left_anti").agg(F.count("*").alias("without_orders"))
    b = c.join(o, on, "left_semi").agg(F.count("*").alias("with_orders"))
    return a.join(b).join(li.join(o, line, "left_anti").agg(F.count("*").alias("orphan_lines")))


@add("isin_set_ops", "SELECT coalesce(a.c_custkey, b.o_custkey) AS isin, CASE WHEN b.o_custkey IS NULL THEN 'only_old' WHEN a.c_custkey IS NULL THEN 'only_new' ELSE 'common' END AS side FROM (SELECT DISTINCT c_custkey FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey FROM orders) b ON a.c_custkey = b.o_custkey")
def isin_set_ops(spark, sf_dir):
    panels.views(spark, sf_dir)
    return rel.set_difference(spark.table("customer").select(F.col("c_custkey").alias("isin")), spark.table("orders").select(F.col("o_custkey").alias("isin")), "isin")


_DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem"
_ENDS = f"SELECT DISTINCT CAST(last_day(dt) AS DATE) AS me FROM ({_DAYS}) q"
_NEXT = f"SELECT me, (SELECT min(dt) FROM ({_DAYS}) d WHERE d.dt >= e.me) AS asof_day FROM ({_ENDS}) e"


def _starts(spark, sf_dir):
    days, ends = _sql(spark, sf_dir, _DAYS), spark.sql(_ENDS)
    got = rel.asof(ends.select(F.col("me").alias("dt")), days.select("dt", F.col("dt").alias("day")), "dt", "day", direction="forward")
    return got.where("asof_day IS NOT NULL").select(F.col("dt").alias("me"), "asof_day")


@add("asof_next_trading_day", f"SELECT * FROM ({_NEXT}) q WHERE asof_day IS NOT NULL")
def asof_next_trading_day(spark, sf_dir):
    return _starts(spark, sf_dir)


@add("asof_backward_weights", "SELECT e.user_id, e.event_id, e.ts, (SELECT arg_max(w.value, w.ts) FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'purchase' AND w.ts <= e.ts) AS asof_value FROM events e WHERE e.event_type = 'click'")
def asof_backward_weights(spark, sf_dir):
    e = _sql(spark, sf_dir, "SELECT user_id, event_id, ts, value, event_type FROM events")
    return rel.asof(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "ts", "value", ["user_id"])


_AT = "(SELECT {} FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'purchase' {})"


@add("asof_weights_or_first", f"SELECT e.user_id, e.event_id, e.ts, coalesce({_AT.format('arg_max(w.value, w.ts)', 'AND w.ts <= e.ts')}, {_AT.format('arg_min(w.value, w.ts)', '')}) AS asof_value FROM events e WHERE e.event_type = 'click'")
def asof_weights_or_first(spark, sf_dir):
    """Before its first purchase a user's click takes the first one's value."""
    e = _sql(spark, sf_dir, "SELECT user_id, event_id, ts, value, event_type FROM events")
    return rel.asof(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "ts", "value", ["user_id"], else_first=True)


_PERIODS = f"SELECT row_number() OVER (ORDER BY asof_day) AS period, asof_day AS a, lead(asof_day) OVER (ORDER BY asof_day) AS z FROM (SELECT DISTINCT asof_day FROM ({_NEXT}) q WHERE asof_day IS NOT NULL) q"


@add("interval_period_days", f"SELECT period, count(*) AS n_days, min(dt) AS first_day, max(dt) AS last_day FROM ({_PERIODS}) p JOIN ({_DAYS}) d ON d.dt >= p.a AND d.dt <= p.z WHERE z IS NOT NULL GROUP BY period")
def interval_period_days(spark, sf_dir):
    p = rel.periods(_starts(spark, sf_dir).select("asof_day").distinct(), "asof_day")
    d = spark.sql(_DAYS)
    return d.join(p, (d.dt >= p.start) & (d.dt <= p.end)).groupBy("period").agg(F.count("*").alias("n_days"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))


@add("last_row_per_month", f"SELECT isin, month, arg_max(price, dt) AS price FROM (SELECT *, CAST(date_trunc('month', dt) AS DATE) AS month FROM ({PRICES_SQL}) q) r GROUP BY isin, month")
def last_row_per_month(spark, sf_dir):
    f = _sql(spark, sf_dir, PRICES_SQL)
    return f.groupBy("isin", F.trunc("dt", "month").alias("month")).agg(F.max_by("price", "dt").alias("price"))


@add("ffill_bfill", f"WITH {panels.ctes('daily')} SELECT inst, dt, last_value(p IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffilled, first_value(p IGNORE NULLS) OVER (PARTITION BY inst ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfilled FROM panel")
def ffill_bfill(spark, sf_dir):
    from gridloom.functions.sql import SPARK

    return panels.panel(spark, sf_dir, "daily").selectExpr("inst", "dt", f"{SPARK.last('p')} AS ffilled", f"{SPARK.next('p')} AS bfilled")


for _name, _panel, _k in (("panel_monthly", "monthly", 12), ("panel_daily_grid", "daily", 12), ("panel_users", "users", 6)):
    QUERIES[_name] = lambda spark, sf_dir, p=_panel, k=_k: panels.panel(spark, sf_dir, p).selectExpr("inst", "dt", *[f"round({c}, {k}) AS {c}" if k < 12 else c for c in ("p", "cp")])
    SQL[_name] = f"WITH {panels.ctes(_panel)} SELECT inst, dt, {', '.join(f'round({c}, {_k}) AS {c}' if _k < 12 else c for c in ('p', 'cp'))} FROM panel"

#: Queries whose text both engines share.
PORTABLE = {
    "point_scan": "SELECT CAST(l_shipdate AS DATE) AS dt, l_orderkey, l_extendedprice FROM lineitem WHERE l_suppkey = 3 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'",
    "range_lookup": "SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "store_stats": "SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_instruments, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem",
    "log_keep_latest": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) q WHERE k <= 100",
    "topk_by_value": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) q WHERE k <= 10",
    "distinct_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT CAST(ts AS DATE)) AS n_days, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
    "pivot_status": "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_suppkey",
    "date_parts": "SELECT o_orderkey, month(o_orderdate) AS m, CAST(last_day(o_orderdate) AS DATE) AS me, CAST(date_trunc('month', o_orderdate) AS DATE) AS ms FROM orders",
}


def _portable(name):
    QUERIES[name] = lambda spark, sf_dir: _sql(spark, sf_dir, PORTABLE[name])
    SQL[name] = PORTABLE[name]


for _name in PORTABLE:
    _portable(_name)


@add("unpivot_quantities", "SELECT l_suppkey, 'l_quantity' AS field, sum(l_quantity) AS total FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'l_linenumber', CAST(sum(l_linenumber) AS DOUBLE) FROM lineitem GROUP BY 1")
def unpivot_quantities(spark, sf_dir):
    wide = _sql(spark, sf_dir, "SELECT l_suppkey, sum(l_quantity) AS l_quantity, CAST(sum(l_linenumber) AS DOUBLE) AS l_linenumber FROM lineitem GROUP BY 1")
    return wide.unpivot("l_suppkey", ["l_quantity", "l_linenumber"], "field", "total")


@add("json_extra_data", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_extra_data(spark, sf_dir):
    e = _sql(spark, sf_dir, "SELECT event_type, props FROM events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


@add("ohlc_decode", "SELECT p_partkey AS id, CAST(DATE '2024-01-01' + CAST(k AS INTEGER) AS DATE) AS dt, p_retailprice AS open, p_retailprice + k + 1 AS high, p_retailprice - k - 1 AS low, p_retailprice + k AS close FROM part, (SELECT unnest([0, 1, 2]) AS k) q")
def ohlc_decode(spark, sf_dir):
    bars = [F.struct(F.lit(k).alias("offset"), F.col("p_retailprice").alias("open"), (F.col("p_retailprice") + k + 1).alias("high"), (F.col("p_retailprice") - k - 1).alias("low"), (F.col("p_retailprice") + k).alias("close")) for k in range(3)]
    return rel.decode_ohlc(_sql(spark, sf_dir, "SELECT p_partkey AS id, p_retailprice FROM part").select("id", F.to_date(F.lit("2024-01-01")).alias("base"), F.array(*bars).alias("bars")))
