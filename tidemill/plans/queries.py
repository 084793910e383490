"""One query for each operator family over the test tables, with the SQL that defines its result."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import as_of_join, dense_grid, full_outer, keep_first, not_in, override, point_in_time, range_lookup, union_all, year_counter
from ..session import shared_dir, table
from ..sources import VersionedTable, empty_clone, latest_timestamp, snapshot, table_metadata
from . import costs, features, graph, marts, models, quality
from .metrics import Compiler, Measure, Metric, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.date(1998, 9, 2)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# -- metrics


def compiler(spark: SparkSession, d: str) -> Compiler:
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return Compiler(
        [
            Model("orders", orders, {"order": "o_orderkey", "customer": "o_custkey"}, "day", (Measure("order_total", "sum", "o_totalprice"), Measure("orders_counted", "count", "o_orderkey"), Measure("customers_counted", "count_distinct", "o_custkey")), {"status": "o_orderstatus"}),
            Model("customers", customers, {"customer": "c_custkey"}, None, (), {"region": "r_name", "is_emea": "r_name in ('EUROPE', 'AFRICA', 'MIDDLE EAST')"}),
        ],
        [
            Metric("revenue", measure="order_total", filter="{{ Dimension('order__status') }} <> 'F'", fill=0, spine=True),
            Metric("order_count", measure="orders_counted", filter="{{ Dimension('order__status') }} <> 'F'"),
            Metric("active_customers", measure="customers_counted"),
            Metric("emea_revenue", measure="order_total", filter="{{ Dimension('order__status') }} <> 'F' and {{ Dimension('customer__is_emea') }}"),
            Metric("aov", "ratio", numerator="revenue", denominator="order_count"),
            Metric("emea_share", "ratio", numerator="emea_revenue", denominator="revenue"),
            Metric("revenue_mom", "derived", expr="round((cast(now as double) - cast(was as double)) / nullif(cast(was as double), 0D), 9)", inputs=(("revenue", "now", None), ("revenue", "was", "1 month"))),
            Metric("trailing_28d", "cumulative", measure="order_total", window=28),
            Metric("mtd", "cumulative", measure="order_total", grain_to_date="month"),
            Metric("conversion_rate", "conversion"),
        ],
    )


_REV = "SELECT date_trunc('{g}', o_orderdate)::DATE AS t, sum(o_totalprice::DECIMAL(28,6)) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"
_SPINE = "SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 {g}))::DATE AS t FROM r"


@query(f"WITH r AS ({_REV.format(g='day')}), s AS ({_SPINE.format(g='day')}) SELECT s.t AS metric_time, coalesce(v, 0)::DOUBLE AS revenue FROM s LEFT JOIN r ON r.t = s.t")
def metric_revenue(spark, d):
    return _double(compiler(spark, d).build("revenue"), "revenue")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS metric_time, count(o_orderkey) AS order_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def metric_order_count(spark, d):
    return compiler(spark, d).build("order_count", "month")


@query("SELECT date_trunc('quarter', o_orderdate)::DATE AS metric_time, count(DISTINCT o_custkey) AS active_customers FROM orders GROUP BY 1")
def metric_active_customers(spark, d):
    return compiler(spark, d).build("active_customers", "quarter")


@query(f"WITH r AS ({_REV.format(g='month')}), n AS (SELECT date_trunc('month', o_orderdate)::DATE AS t, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT n.t AS metric_time, round(coalesce(v::DOUBLE, 0) / nullif(n::DOUBLE, 0), 6) AS aov FROM n LEFT JOIN r USING (t)")
def metric_aov(spark, d):
    return compiler(spark, d).build("aov", "month").withColumn("aov", F.round("aov", 6))


@query(f"WITH r AS ({_REV.format(g='month')}), s AS ({_SPINE.format(g='month')}), e AS (SELECT date_trunc('month', o_orderdate)::DATE AS t, sum(o_totalprice::DECIMAL(28,6)) AS e FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus <> 'F' AND r_name IN ('EUROPE', 'AFRICA', 'MIDDLE EAST') GROUP BY 1) SELECT s.t AS metric_time, round(coalesce(e::DOUBLE, 0) / nullif(coalesce(v, 0)::DOUBLE, 0), 9) AS emea_share FROM s LEFT JOIN r ON r.t = s.t LEFT JOIN e ON e.t = s.t")
def metric_emea_share(spark, d):
    return compiler(spark, d).build("emea_share", "month").withColumn("emea_share", F.round("emea_share", 9))


@query(f"WITH r AS ({_REV.format(g='month')}), s AS ({_SPINE.format(g='month')}), f AS (SELECT s.t, coalesce(v, 0)::DOUBLE AS v FROM s LEFT JOIN r ON r.t = s.t) SELECT t AS metric_time, round((v - lag(v) OVER (ORDER BY t)) / nullif(lag(v) OVER (ORDER BY t), 0), 9) AS revenue_mom FROM f")
def metric_revenue_mom(spark, d):
    return compiler(spark, d).build("revenue_mom")


_DAILY = "WITH r AS (SELECT o_orderdate::DATE AS t, sum(o_totalprice::DECIMAL(28,6)) AS v FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY))::DATE AS t FROM r)"


@query(f"{_DAILY} SELECT s.t AS metric_time, coalesce(sum(v), 0)::DOUBLE AS trailing_28d FROM s LEFT JOIN r ON r.t > s.t - INTERVAL 28 DAY AND r.t <= s.t GROUP BY s.t")
def metric_trailing_28d(spark, d):
    return _double(compiler(spark, d).build("trailing_28d"), "trailing_28d")


@query(f"{_DAILY} SELECT s.t AS metric_time, coalesce(sum(v), 0)::DOUBLE AS mtd FROM s LEFT JOIN r ON r.t >= date_trunc('month', s.t) AND r.t <= s.t GROUP BY s.t")
def metric_mtd(spark, d):
    return _double(compiler(spark, d).build("mtd"), "mtd")


@query("WITH b AS (SELECT date_trunc('week', o_orderdate)::DATE AS metric_time, r_name AS customer__region, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus <> 'F') SELECT metric_time, customer__region, sum(o_totalprice::DECIMAL(28,6))::DOUBLE AS revenue, count(*) AS order_count FROM b GROUP BY 1, 2")
def saved_weekly_by_region(spark, d):
    return _double(compiler(spark, d).saved(["revenue", "order_count"], "week", ("customer__region",)), "revenue")


@query("SELECT * FROM (VALUES ('conversion_rate', 'kind conversion')) t(metric, reason)")
def metric_refusals(spark, d):
    c = compiler(spark, d)
    c.build_all()
    return spark.createDataFrame(sorted(c.skipped.items()), "metric string, reason string")


# -- order mart


def _stg_orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.lower(F.trim("o_orderstatus")).alias("status"), X.money(F.col("o_totalprice")).alias("order_amount"), F.to_date("o_orderdate").alias("ordered_date"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, lower(trim(o_orderstatus)) AS status, o_totalprice::DOUBLE AS order_amount, o_orderdate::DATE AS ordered_date FROM orders")
def stg_orders(spark, d):
    return _double(_stg_orders(spark, d), "order_amount")


_LINES = "SELECT l_orderkey AS order_id, count(*) AS line_item_count, sum((l_extendedprice::DECIMAL(28,6) * l_discount::DECIMAL(28,6))::DECIMAL(28,6)) AS discount, sum(l_extendedprice::DECIMAL(28,6)) AS gross FROM lineitem GROUP BY 1"
_FCT = f"WITH l AS ({_LINES}) SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE WHEN r_name IN ('EUROPE', 'AFRICA', 'MIDDLE EAST') THEN 'EMEA' WHEN r_name = 'AMERICA' THEN 'AMER' ELSE 'OTHER' END AS region, coalesce(line_item_count, 0) AS line_item_count, round(coalesce(gross, 0) - coalesce(discount, 0), 2)::DOUBLE AS net_line_amount, o_orderdate::DATE AS ordered_date FROM orders LEFT JOIN l ON order_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"


def _order_lines(spark, d):
    line = table(spark, d, "lineitem")
    gross = X.money(F.col("l_extendedprice"))
    return line.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count(F.lit(1)).alias("line_item_count"), F.sum(X.money(gross * X.money(F.col("l_discount")))).alias("discount"), F.sum(gross).alias("gross"))


@query(f"SELECT order_id, line_item_count, discount::DOUBLE AS discount, gross::DOUBLE AS gross FROM ({_LINES})")
def int_order_line_totals(spark, d):
    return _double(_order_lines(spark, d), "gross", "discount")


def _geo(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")


def _fct(spark, d):
    region = F.when(F.col("r_name").isin("EUROPE", "AFRICA", "MIDDLE EAST"), "EMEA").when(F.col("r_name") == "AMERICA", "AMER").otherwise("OTHER")
    o = _stg_orders(spark, d).join(_order_lines(spark, d), "order_id", "left").join(_geo(spark, d).select("c_custkey", "r_name"), F.col("customer_id") == F.col("c_custkey"), "left")
    net = F.coalesce("gross", F.lit(0)) - F.coalesce("discount", F.lit(0))
    return o.select("order_id", "customer_id", region.alias("region"), F.coalesce("line_item_count", F.lit(0)).alias("line_item_count"), F.round(net, 2).cast("double").alias("net_line_amount"), "ordered_date")


@query(_FCT)
def fct_orders(spark, d):
    return _fct(spark, d)


@query(_FCT)
def fct_orders_incremental(spark, d):
    """A first load up to a day, then an upsert of what a lookback of three days reads again: the same as a full build."""
    full = _fct(spark, d)
    t = VersionedTable(spark, f"{shared_dir(spark)}/fct-{uuid.uuid4().hex}", ["order_id"])
    t.upsert(full.where("ordered_date <= date'1999-06-30'"))
    t.upsert(full.where(F.col("ordered_date") >= F.lit(t.since("ordered_date", dt.timedelta(days=3)))))
    return t.current()


@query("SELECT c_custkey AS customer_id, initcap_free AS name, coalesce(c_acctbal, 0) > 0 AS in_credit, CASE WHEN r_name IN ('EUROPE', 'AFRICA', 'MIDDLE EAST') THEN 'EMEA' WHEN r_name = 'AMERICA' THEN 'AMER' ELSE 'OTHER' END AS region FROM (SELECT *, upper(c_name) AS initcap_free FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dim_customers(spark, d):
    region = F.when(F.col("r_name").isin("EUROPE", "AFRICA", "MIDDLE EAST"), "EMEA").when(F.col("r_name") == "AMERICA", "AMER").otherwise("OTHER")
    return _geo(spark, d).select(F.col("c_custkey").alias("customer_id"), F.upper("c_name").alias("name"), (F.coalesce("c_acctbal", F.lit(0.0)) > 0).alias("in_credit"), region.alias("region"))


def _history(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    day = lambda s: F.to_timestamp(F.lit(s))
    first = snapshot(None, c, "c_custkey", ["c_mktsegment"], day("1995-01-01"))
    later = c.where("c_custkey % 10 <> 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.lit("MOVED")).otherwise(F.col("c_mktsegment")))
    return snapshot(first, later, "c_custkey", ["c_mktsegment"], day("1998-01-01"))


_HISTORY = """SELECT c_custkey, c_mktsegment, false AS is_deleted, TIMESTAMP '1995-01-01' AS valid_from,
  CASE WHEN c_custkey % 10 = 3 OR (c_custkey % 7 = 0 AND c_mktsegment <> 'MOVED') THEN TIMESTAMP '1998-01-01' END AS valid_to FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, true, TIMESTAMP '1998-01-01', NULL FROM customer WHERE c_custkey % 10 = 3
UNION ALL SELECT c_custkey, 'MOVED', false, TIMESTAMP '1998-01-01', NULL FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 7 = 0"""


@query(_HISTORY)
def customer_snapshot(spark, d):
    return _history(spark, d).select("c_custkey", "c_mktsegment", "is_deleted", "valid_from", "valid_to")


@query(f"WITH h AS ({_HISTORY}) SELECT o_orderkey, c_mktsegment AS segment_then FROM orders LEFT JOIN h ON o_custkey = c_custkey AND o_orderdate >= valid_from AND o_orderdate < coalesce(valid_to, TIMESTAMP '9999-12-31')")
def orders_as_was(spark, d):
    h = _history(spark, d).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "valid_from", "valid_to")
    return point_in_time(table(spark, d, "orders"), h, "o_custkey", "o_orderdate").select("o_orderkey", F.col("c_mktsegment").alias("segment_then"))


# -- conformed layer


@query("SELECT 'c' || c_custkey AS PartyId, c_name AS Name, c_acctbal AS Balance, NULL::VARCHAR AS Brand, 'Retail' AS DataSource, 'SEK' AS DefaultCurrency, 'c' || c_custkey || '-ds_retail' AS PartyIdERP FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_acctbal, NULL, 'Whole Sale', 'EUR', 's' || s_suppkey || '-ds_whole_sale' FROM supplier")
def erp_union_parties(spark, d):
    party = lambda t, p: table(spark, d, t).select(F.concat(F.lit(p), F.col({"c": "c_custkey", "s": "s_suppkey"}[p]).cast("string")).alias("PartyId"), F.col(f"{p}_name").alias("Name"), F.col(f"{p}_acctbal").alias("Balance"), F.lit(None).cast("string").alias("Brand"))
    registry = [models.Connector("Retail", "SEK", True, ("parties",)), models.Connector("Off", "USD", False, ("parties",)), models.Connector("Whole Sale", "EUR", True, ("parties",))]
    return models.conformed_union("parties", registry, {"Retail": lambda: party("customer", "c"), "Whole Sale": lambda: party("supplier", "s")}, ("PartyId",))


@query("SELECT p_partkey, p_type AS category FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'user-' || p_brand FROM part WHERE p_partkey % 5 = 0")
def override_union(spark, d):
    p = table(spark, d, "part")
    return override(p.select("p_partkey", F.col("p_type").alias("category")), p.where("p_partkey % 5 = 0").select("p_partkey", F.concat(F.lit("user-"), "p_brand").alias("category")), ["p_partkey"])


@query("SELECT c_custkey, coalesce(r_name, n_name, 'Others') AS level1, coalesce(CASE WHEN r_name IS NOT NULL THEN n_name END, 'Others') AS level2, c_name AS level3 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def hierarchy_3level(spark, d):
    return _geo(spark, d).select("c_custkey", F.coalesce("r_name", "n_name", F.lit("Others")).alias("level1"), F.coalesce(F.when(F.col("r_name").isNotNull(), F.col("n_name")), F.lit("Others")).alias("level2"), F.col("c_name").alias("level3"))


@query("SELECT n_name, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, c_custkey, NULL AS s_suppkey FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier) ON k = n_nationkey GROUP BY 1")
def union_counts(spark, d):
    u = union_all([table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.lit(None).cast("long").alias("s_suppkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(None).cast("long").alias("c_custkey"), "s_suppkey")])
    return table(spark, d, "nation").join(u, F.col("k") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


# -- windows


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedupe_latest_order(spark, d):
    return keep_first(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT make_date(y, 1, 1) AS FromDate, make_date(y, 12, 31) AS ToDate, (y - 1998)::INTEGER AS FyCounter FROM y")
def fy_counter(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    years = y.select(F.make_date("y", F.lit(1), F.lit(1)).alias("FromDate"), F.make_date("y", F.lit(12), F.lit(31)).alias("ToDate"))
    return year_counter(years, "FromDate", "ToDate", AS_OF)


_MONTHLY = "WITH o AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(28,6)) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), m AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM o), g AS (SELECT seg, m.month, coalesce(amount, 0) AS amount FROM (SELECT DISTINCT seg FROM o) CROSS JOIN m LEFT JOIN o USING (seg, month))"


def _monthly(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), F.col("c_custkey") == F.col("o_custkey"))
    by = o.groupBy("seg", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(X.money(F.col("o_totalprice"))).alias("amount"))
    return dense_grid(by, "seg", "month").join(by, ["seg", "month"], "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(38,6)")))


@query(f"{_MONTHLY} SELECT seg, month, (sum(amount) OVER (PARTITION BY seg ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))::DOUBLE AS rolling FROM g")
def rolling_12m(spark, d):
    w = Window.partitionBy("seg").orderBy("month").rowsBetween(-11, 0)
    return _double(_monthly(spark, d).select("seg", "month", F.sum("amount").over(w).alias("rolling")), "rolling")


@query(f"{_MONTHLY} SELECT seg, month, (sum(amount) OVER (PARTITION BY seg ORDER BY month))::DOUBLE AS closing, (sum(amount) OVER (PARTITION BY seg ORDER BY month) - amount)::DOUBLE AS opening FROM g")
def balance_sheet_running(spark, d):
    w = Window.partitionBy("seg").orderBy("month")
    g = _monthly(spark, d).withColumn("closing", F.sum("amount").over(w))
    return _double(g.select("seg", "month", "closing", (F.col("closing") - F.col("amount")).alias("opening")), "closing", "opening")


@query(f"{_MONTHLY} SELECT seg, month, (amount * 2 - sum(amount) OVER (PARTITION BY month))::DOUBLE AS rest FROM g")
def budget_rest(spark, d):
    return _double(_monthly(spark, d).select("seg", "month", (F.col("amount") * 2 - F.sum("amount").over(Window.partitionBy("month"))).alias("rest")), "rest")


@query(f"{_MONTHLY} SELECT seg, month, (first_value(total) OVER (PARTITION BY seg ORDER BY month DESC) - sum(amount) OVER (PARTITION BY seg ORDER BY month DESC))::DOUBLE AS opening FROM (SELECT *, sum(amount) OVER (PARTITION BY seg) + 1000 AS total FROM g)")
def warehouse_backcast(spark, d):
    """What was there before each month, counted back from what is there now."""
    back = Window.partitionBy("seg").orderBy(F.desc("month"))
    g = _monthly(spark, d).withColumn("now", F.sum("amount").over(Window.partitionBy("seg")) + 1000)
    return _double(g.select("seg", "month", (F.first("now").over(back) - F.sum("amount").over(back)).alias("opening")), "opening")


@query("WITH d AS (SELECT o_custkey AS k, o_orderdate::DATE AS day, sum(-(o_totalprice::DECIMAL(28,6))) AS v FROM orders GROUP BY 1, 2) SELECT k, day, coalesce(sum(v) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS brought_forward FROM d")
def balance_brought_forward(spark, d):
    day = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.sum(-X.money(F.col("o_totalprice"))).alias("v"))
    w = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return _double(day.select("k", "day", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("brought_forward")), "brought_forward")


# -- joins


@query("WITH a AS (SELECT year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(28,6)) AS v FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1), b AS (SELECT year(l_shipdate) AS y, sum(l_extendedprice::DECIMAL(28,6)) AS v FROM lineitem WHERE year(l_shipdate) > 1996 GROUP BY 1) SELECT coalesce(a.y, b.y)::INTEGER AS y, a.v::DOUBLE AS actual, b.v::DOUBLE AS budget FROM a FULL JOIN b ON a.y = b.y")
def full_outer_actual_vs_budget(spark, d):
    total = lambda t, at, v, keep, n: table(spark, d, t).where(keep).groupBy(F.year(at).alias("y")).agg(F.sum(X.money(F.col(v))).cast("double").alias(n))
    return full_outer([total("orders", "o_orderdate", "o_totalprice", "year(o_orderdate) < 2000", "actual"), total("lineitem", "l_shipdate", "l_extendedprice", "year(l_shipdate) > 1996", "budget")], ["y"])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l.l_orderkey, l.l_linenumber,
  (SELECT arg_max(s.l_extendedprice, (s.l_shipdate, s.l_orderkey * 10 + s.l_linenumber)) FROM lineitem s WHERE s.l_partkey = l.l_partkey AND s.l_shipdate <= l.o_orderdate) AS last_price FROM l""")
def asof_last_supply(spark, d):
    """The price of the last shipment of each line's part up to the day of its order."""
    line = table(spark, d, "lineitem")
    left = line.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate")
    right = line.select("l_partkey", F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return as_of_join(left, right, "l_partkey", "o_orderdate", "at", "price", "tie").select("l_orderkey", "l_linenumber", "last_price")


@query("""WITH large AS (SELECT o_orderstatus AS s, o_orderdate::DATE AS at, max(o_orderkey) AS k FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2)
SELECT o.o_orderkey, l.k AS last_large FROM orders o ASOF LEFT JOIN large l ON l.s = o.o_orderstatus AND l.at <= o.o_orderdate::DATE""")
def asof_large_order(spark, d):
    """The last large order of each order's status up to its day. A status holds up to half of all rows, so it is swept by months."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    large = orders.where("o_totalprice > 300000").select("o_orderstatus", F.col("day").alias("at"), F.col("o_orderkey").alias("large"), F.col("o_orderkey").alias("tie"))
    return as_of_join(orders.select("o_orderkey", "o_orderstatus", "day"), large, "o_orderstatus", "day", "at", "large", "tie", span="month").select("o_orderkey", "last_large")


@query("SELECT o_orderkey, 'FY' || CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS fy FROM orders")
def range_fy_lookup(spark, d):
    y = table(spark, d, "orders").select(F.explode(F.array(F.year("o_orderdate"), F.year("o_orderdate") - 1)).alias("y")).distinct()
    fy = y.select(F.make_date("y", F.lit(7), F.lit(1)).alias("lo"), F.make_date(F.col("y") + 1, F.lit(6), F.lit(30)).alias("hi"), F.concat(F.lit("FY"), F.col("y").cast("string")).alias("fy"))
    return range_lookup(table(spark, d, "orders"), fy, F.to_date("o_orderdate"), "lo", "hi").select("o_orderkey", "fy")


@query("""SELECT last_day((date_trunc('day', l_shipdate) + to_months(k::INTEGER))::DATE) AS month, l_returnflag, count(*) AS payments, sum((l_extendedprice / l_quantity)::DECIMAL(28,6))::DOUBLE AS amount
FROM lineitem, unnest(range(0, l_quantity::BIGINT + 1)) AS u(k) GROUP BY 1, 2""")
def contract_expansion(spark, d):
    """Each line as a contract of as many months as it has units: what falls due in each month."""
    line = table(spark, d, "lineitem")
    months = X.series(F.lit(0), F.col("l_quantity").cast("int"))
    # Lines that start in one month and run as long fall due alike, so they are summed before they are expanded.
    alike = line.groupBy("l_returnflag", F.trunc("l_shipdate", "month").alias("start"), "l_quantity")
    alike = alike.agg(F.count(F.lit(1)).alias("n"), F.sum(X.money(F.col("l_extendedprice") / F.col("l_quantity"))).alias("amount"))
    due = alike.select("l_returnflag", "start", "n", "amount", F.explode(months).alias("k"))
    by = due.groupBy(F.last_day(F.add_months("start", F.col("k"))).alias("month"), "l_returnflag")
    return by.agg(F.sum("n").alias("payments"), F.sum("amount").cast("double").alias("amount"))


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal < -500)")
def anti_join(spark, d):
    """Nations without a customer deep in debt in a segment, by two columns."""
    debtors = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < -500")
    return table(spark, d, "nation").join(debtors, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("n_name")


_NOT_IN = "SELECT 'plain' AS values_, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) UNION ALL SELECT 'with a null', n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_acctbal < -950 THEN c_nationkey END FROM customer WHERE c_acctbal < -900)"


@query(_NOT_IN)
def not_in_semantics(spark, d):
    """A null among the values leaves no row."""
    nation, poor = table(spark, d, "nation"), table(spark, d, "customer").where("c_acctbal < -900")
    plain = not_in(nation, "n_nationkey", poor.select("c_nationkey"))
    holed = not_in(nation, "n_nationkey", poor.select(F.when(F.col("c_acctbal") < -950, F.col("c_nationkey")).alias("key")))
    return union_all([rows.select(F.lit(what).alias("values_"), "n_name") for what, rows in (("plain", plain), ("with a null", holed))])


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS large FROM part")
def existence_flag(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, d, "part").join(keys, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.col("k").isNotNull().alias("large"))


@query("SELECT event_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def events_latest_batch(spark, d):
    e = table(spark, d, "events")
    return e.join(e.agg(F.max("ts").alias("ts")), "ts", "left_semi").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey % 3 = 0 AND o_orderdate >= DATE '1997-01-01') OR (o_custkey % 3 = 1 AND o_orderdate >= DATE '1999-01-01') OR o_custkey % 3 = 2")
def start_year_floor(spark, d):
    floors = spark.createDataFrame([(0, dt.date(1997, 1, 1)), (1, dt.date(1999, 1, 1))], "org long, floor date")
    o = table(spark, d, "orders").withColumn("org", F.col("o_custkey") % 3)
    return o.join(floors, "org", "left").where("floor is null or o_orderdate >= floor").select("o_orderkey")


# -- scalars, JSON, aggregates


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NotSent' WHEN o_totalprice < 1000 THEN 'Paid' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 15 THEN '0-15d' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 30 THEN '16-30d' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 45 THEN '31-45d' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 60 THEN '46-60d' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 90 THEN '61-90d' WHEN abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) <= 120 THEN '91-120d' ELSE '>120d' END AS bucket FROM orders")
def due_status_buckets(spark, d):
    balance = F.when(F.col("o_totalprice") < 1000, 0).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", X.due_status(F.to_date("o_orderdate"), balance, F.col("o_orderstatus") != "P", AS_OF).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 1 / (1 + l_tax * 100 / 100) END) AS net, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS ratio FROM lineitem")
def net_of_vat_discount(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.net_unit_price(F.col("l_extendedprice"), F.lit(1.0), F.col("l_returnflag") == "R", F.col("l_tax") * 100).alias("net"), F.try_divide("l_extendedprice", "l_discount").alias("ratio"))


@query("SELECT event_id, props AS raw, json_keys(props) AS keys FROM events WHERE event_id < 0")
def empty_clone_events(spark, d):
    return empty_clone(table(spark, d, "events")).select("event_id", F.col("props").alias("raw"), F.json_object_keys("props").alias("keys"))


@query("SELECT event_type, count(*) AS n, sum(list_sum(list_transform(json_keys(props), lambda k: length(k)))) AS key_chars FROM events GROUP BY 1")
def json_props(spark, d):
    chars = F.aggregate(F.json_object_keys("props"), F.lit(0), lambda a, k: a + F.length(k))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("key_chars"))


@query("SELECT user_id, i AS at, event_id FROM (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY 1), unnest(range(1, len(l))) u(j), (SELECT 0 AS z), LATERAL (SELECT j AS i, l[j + 1] AS event_id)")
def json_array_explode(spark, d):
    """An array in JSON text per user, taken apart with its offsets; the first entry is left out."""
    a = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list("event_id"))).alias("ids"))
    return a.select("user_id", F.posexplode(F.from_json("ids", "array<long>")).alias("at", "event_id")).where("at > 0").withColumn("at", F.col("at").cast("long"))


@query("SELECT c_mktsegment, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1")
def labels_string_agg(spark, d):
    return _geo(spark, d).where("n_name is not null").select("c_mktsegment", "n_name").distinct().groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("SELECT p_partkey, (CASE WHEN p_size > 40 THEN NULL ELSE p_size > 20 END) IS NOT TRUE AS not_true, (CASE WHEN p_size > 40 THEN NULL ELSE p_size > 20 END) IS NOT FALSE AS not_false FROM part")
def three_valued_filter(spark, d):
    flag = F.when(F.col("p_size") > 40, F.lit(None).cast("boolean")).otherwise(F.col("p_size") > 20)
    return table(spark, d, "part").select("p_partkey", X.is_not_true(flag).alias("not_true"), (~flag.eqNullSafe(F.lit(False))).alias("not_false"))


@query("SELECT p_partkey, nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, '') AS brand, split_part(p_type, ' ', 2) AS second, nullif(split_part(p_type, ' ', 9), '') AS ninth, nullif(regexp_extract(p_brand, '[0-9]+', 0), '') AS digits, left(p_name, 3) AS three, length(p_name) AS n, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS marked, md5(p_brand || '-' || p_partkey) AS key FROM part")
def scalar_string(spark, d):
    types = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", X.blank_to_null(F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand"))).alias("brand"), F.coalesce(X.safe_offset(types, 1), F.lit("")).alias("second"), X.safe_offset(types, 8).alias("ninth"), X.regexp_first(F.col("p_brand"), "[0-9]+").alias("digits"), F.left("p_name", F.lit(3)).alias("three"), F.length("p_name").alias("n"), F.regexp_replace("p_name", "([aeiou])", "<$1>").alias("marked"), X.surrogate_key(F.col("p_brand"), F.col("p_partkey")).alias("key"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_brand || '-' || p_name), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda w: upper(w[1]) || w[2:]), '') AS name FROM part")
def initcap_words(spark, d):
    return table(spark, d, "part").select("p_partkey", X.initcap_words(F.concat("p_brand", F.lit("-"), "p_name")).alias("name"))


@query("SELECT o_orderkey, year(DATE '1998-09-02') - year(o_orderdate) AS years, make_date(year(o_orderdate), 12, 31) AS year_end, last_day(o_orderdate::DATE) AS month_end, strftime(o_orderdate, '%y%m%d') AS short, date_trunc('week', o_orderdate)::DATE AS week, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_month, least(make_date(year(o_orderdate) + 1, month(o_orderdate), 1) + (day(o_orderdate) - 1)::INTEGER, last_day(make_date(year(o_orderdate) + 1, month(o_orderdate), 1))) AS shifted, datediff('day', o_orderdate::DATE, DATE '1998-09-02') AS age FROM orders")
def scalar_date(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", X.year_diff(F.lit(AS_OF), day).cast("long").alias("years"), X.last_day_of_year(day).alias("year_end"), F.last_day(day).alias("month_end"), F.date_format("o_orderdate", "yyMMdd").alias("short"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), F.add_months(F.trunc(day, "month"), 1).alias("next_month"), X.shifted_year(day, 1).alias("shifted"), F.datediff(F.lit(AS_OF), day).cast("long").alias("age"))


@query("SELECT p_partkey, CASE WHEN v IS NULL THEN NULL ELSE least(p_size, v) END AS low, CASE WHEN v IS NULL THEN NULL ELSE greatest(p_size, v) END AS high, abs(p_size - 25) AS away, p_retailprice / 7 AS seventh FROM (SELECT *, CASE WHEN p_size % 5 <> 0 THEN 20 END AS v FROM part)")
def scalar_math(spark, d):
    v = F.when(F.col("p_size") % 5 != 0, 20)
    return table(spark, d, "part").select("p_partkey", X.null_if_any(F.least, F.col("p_size"), v).alias("low"), X.null_if_any(F.greatest, F.col("p_size"), v).alias("high"), F.abs(F.col("p_size") - 25).alias("away"), (F.col("p_retailprice") / 7).alias("seventh"))


@query("SELECT year(l_shipdate) AS y, sum(l_extendedprice::DECIMAL(28,6) * (CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END))::DOUBLE AS amount, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate)::DATE AS first, round(avg(l_quantity), 6) AS quantity, round(median(l_quantity), 6) AS middle FROM lineitem GROUP BY 1")
def signed_profit_loss(spark, d):
    sign = F.when(F.col("l_linestatus") == "F", -1).otherwise(1)
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.sum(X.money(F.col("l_extendedprice")) * sign).cast("double").alias("amount"), F.countDistinct("l_suppkey").alias("suppliers"), F.to_date(F.min("l_shipdate")).alias("first"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.median("l_quantity"), 6).alias("middle"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def top_balances(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(10)


@query("SELECT CASE WHEN event_id % 10 = 0 THEN '(none)' ELSE event_type END AS branch, count(*) AS turns, round(sum(CASE event_type WHEN 'view' THEN 2.0 WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 5.0 WHEN 'signup' THEN 7.0 END * (event_id % 1000) / 1e6), 9)::DOUBLE AS cost, count(*) FILTER (event_type = 'error') AS unpriced FROM events GROUP BY 1")
def usage_cost_by_branch(spark, d):
    card = {"source": "test", "models": {m: {"input": r, "output": 1, "cache_creation": 1, "cache_read": 1} for m, r in (("view", 2), ("click", 3), ("purchase", 5), ("signup", 7))}}
    usage = costs.read_flat(table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("branch")))
    out = costs.cost_by(costs.priced(usage, costs.rate_card(spark, card)), "branch", "(none)")
    return out.withColumn("cost", F.round("cost", 9))


# -- quality, catalog, graph


@query("SELECT 'unique' AS test, count(*) AS failing FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'not_null', count(*) FROM documents WHERE lang IS NULL UNION ALL SELECT 'accepted_values', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'relationships', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION ALL SELECT 'range', count(*) FROM part WHERE p_size < 5 OR p_size > 45 UNION ALL SELECT 'expression', count(*) FROM lineitem WHERE NOT coalesce(l_discount < 0.05, false) UNION ALL SELECT 'unique_combination', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def quality_tests(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    tests = {
        "unique": quality.unique(line, "l_orderkey"),
        "not_null": quality.not_null(table(spark, d, "documents"), "lang"),
        "accepted_values": quality.accepted_values(orders, "o_orderstatus", ["F", "O"]),
        "relationships": quality.relationships(orders, "o_custkey", table(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey"),
        "range": quality.accepted_range(table(spark, d, "part"), "p_size", 5, 45),
        "expression": quality.expression_is_true(line, "l_discount < 0.05"),
        "unique_combination": quality.unique(line, "l_orderkey", "l_linenumber"),
    }
    return union_all([t.select(F.lit(n).alias("test"), "failing") for n, t in tests.items()])


@query("SELECT epoch(TIMESTAMP '2030-01-01')::BIGINT - epoch(max(ts))::BIGINT AS age_seconds, 'error' AS status FROM events")
def source_freshness(spark, d):
    now = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)
    return quality.freshness(table(spark, d, "events"), "ts", now, dt.timedelta(hours=24), dt.timedelta(hours=48))


@query("SELECT 'events' AS table_name, event_type AS org, max(ts) AS last_sync, count(*) AS n_rows FROM events GROUP BY 2")
def catalog_metadata(spark, d):
    return table_metadata(table(spark, d, "events"), "events", "event_type", "ts")


@query("SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS latest")
def latest_source_timestamp(spark, d):
    return latest_timestamp([(table(spark, d, "orders"), "o_orderdate"), (table(spark, d, "lineitem"), "l_shipdate")], spark)


_EDGES = "e AS (SELECT p_partkey AS s, t FROM part, unnest([p_partkey * 2, p_partkey * 3]) u(t) WHERE t IN (SELECT p_partkey FROM part))"


def _graph(spark, d):
    """Each part is needed by the parts of twice and three times its number, if there are any."""
    p = table(spark, d, "part")
    edges = p.select(F.col("p_partkey").alias("source"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("target"))
    return edges.join(p.select(F.col("p_partkey").alias("target")), "target", "left_semi").select("source", "target")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS distance UNION SELECT t, distance + 1 FROM r JOIN e ON s = node) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def graph_reachability(spark, d):
    shared_dir(spark)
    return graph.reachable(_graph(spark, d), spark.range(1, 2).select(F.col("id").alias("node")))


@query("SELECT o.name AS column_name, i.name AS input, k AS kind FROM (VALUES ('total', 'o_totalprice', 'renamed'), ('o_orderkey', 'o_orderkey', 'direct'), ('net', 'o_totalprice', 'derived'), ('net', 'o_orderkey', 'derived')) t(a, b, k), LATERAL (SELECT a AS name) o, LATERAL (SELECT b AS name) i")
def lineage_columns(spark, d):
    o = table(spark, d, "orders")
    df = o.select(F.col("o_totalprice").alias("total"), "o_orderkey").withColumn("net", F.col("total") - F.col("o_orderkey"))
    return spark.createDataFrame(graph.column_lineage(df), "column_name string, input string, kind string")


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS id, n_name AS name, count(c_custkey)::DOUBLE AS cost FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
e AS (SELECT DISTINCT p AS s, id AS t FROM n, unnest([id // 2, id // 3]) u(p) WHERE p <> id),
r AS (SELECT id, cost, name AS path FROM n UNION ALL SELECT e.t, r.cost + n.cost, r.path || '>' || n.name FROM r JOIN e ON e.s = r.id JOIN n ON n.id = e.t)
SELECT cost, path FROM r ORDER BY cost DESC, path DESC LIMIT 1""")
def critical_path(spark, d):
    """The dearest chain of nations, each after those of half and of a third of its number; a nation costs its customers."""
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    rows = table(spark, d, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n")).collect()  # a model graph's size
    name = {r.n_nationkey: r.n_name for r in rows}
    parents = {name[k]: sorted({name[p] for p in (k // 2, k // 3) if p != k}) for k in name}
    cost, path = graph.critical_path(parents, {r.n_name: float(r.n) for r in rows})
    return spark.createDataFrame([(cost, ">".join(path))], "cost double, path string")


@query(f"""WITH n AS (SELECT p_partkey AS id, p_brand AS src FROM part), {_EDGES},
j AS (SELECT a.src AS a, b.src AS b FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE a.src = 'Brand#11' OR b.src = 'Brand#11')
SELECT CASE WHEN b = 'Brand#11' THEN a ELSE b END AS file, 'uses' AS relation, count(*) FILTER (b = 'Brand#11' AND a <> 'Brand#11') AS dependents,
  count(*) FILTER (a = 'Brand#11' AND b <> 'Brand#11') AS dependencies, count(*) FILTER (a = b) AS internal FROM j GROUP BY 1""")
def graph_impact(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("src"))
    return graph.impact(nodes, _graph(spark, d).withColumn("relation", F.lit("uses")), nodes.where("src = 'Brand#11'"))


@query(f"""WITH {_EDGES}, n AS (SELECT p_partkey AS id FROM part WHERE lower(p_type) LIKE '%o%' AND p_brand LIKE 'Brand#1%')
SELECT s AS source, t AS target FROM e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)""")
def graph_subset(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("src"), F.col("p_type").alias("community"))
    edges = _graph(spark, d).withColumn("relation", F.lit("uses"))
    return graph.subset(nodes, edges, community="O", prefix="Brand#1", relation="uses")[1].select("source", "target")


QUERIES |= marts.QUERIES | features.QUERIES
ORACLES |= marts.ORACLES | features.ORACLES
