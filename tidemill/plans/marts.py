"""Composite marts: unions of documents, balances, stock, categories, forecasts. Each has the SQL that defines its result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import as_of_join, full_outer, keep_first, override, range_lookup, union_all
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.date(1998, 9, 2)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _money(c: str | Column) -> Column:
    return X.money(F.col(c) if isinstance(c, str) else c)


# -- categories

_CATEGORIES = """
cat(id, name, parent, active) AS (
  SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, CASE WHEN n_nationkey = 3 THEN false WHEN n_nationkey < 10 THEN true END FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'w', NULL FROM region UNION ALL SELECT 'w', 'World', NULL, true UNION ALL SELECT 'd', 'Debtors', NULL, true),
sys AS (SELECT 'Customer' AS dimension, c_custkey::VARCHAR AS id, 'n' || c_nationkey AS category FROM customer UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, 'n' || s_nationkey FROM supplier),
usr AS (SELECT 'Customer' AS dimension, c_custkey::VARCHAR AS id, 'd' AS category FROM customer WHERE c_acctbal < 0),
map AS (SELECT * FROM sys WHERE NOT EXISTS (SELECT 1 FROM usr WHERE usr.dimension = sys.dimension AND usr.id = sys.id) UNION ALL SELECT * FROM usr),
cxm AS (
  SELECT m.dimension, m.id, coalesce(g.name, p.name, c.name, 'Others') AS level1,
         CASE WHEN g.id IS NOT NULL THEN p.name WHEN p.id IS NOT NULL THEN c.name ELSE 'Others' END AS level2, CASE WHEN g.id IS NOT NULL THEN c.name ELSE 'Others' END AS level3
  FROM map m LEFT JOIN cat c ON c.id = m.category AND c.active IS NOT FALSE LEFT JOIN cat p ON p.id = c.parent AND p.active IS NOT FALSE LEFT JOIN cat g ON g.id = p.parent AND g.active IS NOT FALSE)"""


def category_tree(spark: SparkSession, d: str) -> DataFrame:
    """``id``, ``name``, ``parent``, ``active`` (null counts as active): nations below regions below the world, and one of its own."""
    nation = table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.when(F.col("n_nationkey") == 3, False).when(F.col("n_nationkey") < 10, True).alias("active"),
    )
    region = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("w").alias("parent"), F.lit(None).cast("boolean").alias("active"))
    return union_all([nation, region, spark.createDataFrame([("w", "World", None, True), ("d", "Debtors", None, True)], "id string, name string, parent string, active boolean")])


def mapped_categories(mapping: DataFrame, tree: DataFrame) -> DataFrame:
    """``dimension``, ``id`` and three levels, the top one first: a category, its parent, its grandparent. A missing or inactive one is 'Others'."""
    live = tree.where(X.is_not_false(F.col("active")))
    level = lambda n: live.select(F.col("id").alias(f"id{n}"), F.col("name").alias(f"name{n}"), F.col("parent").alias(f"parent{n}"))
    up = mapping.join(level(0), F.col("category") == F.col("id0"), "left").join(level(1), F.col("parent0") == F.col("id1"), "left").join(level(2), F.col("parent1") == F.col("id2"), "left")
    others = F.lit("Others")
    levels = [
        F.coalesce("name2", "name1", "name0", others),
        F.when(F.col("id2").isNotNull(), F.col("name1")).when(F.col("id1").isNotNull(), F.col("name0")).otherwise(others),
        F.when(F.col("id2").isNotNull(), F.col("name0")).otherwise(others),
    ]
    out = up.select("dimension", "id", *[c.alias(f"level{i + 1}") for i, c in enumerate(levels)])
    return keep_first(out, ["dimension", "id"], F.col("level1"), F.col("level2"), F.col("level3"))


def category_map(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t, k, n, dim: table(spark, d, t).select(F.lit(dim).alias("dimension"), F.col(k).cast("string").alias("id"), F.concat(F.lit("n"), F.col(n).cast("string")).alias("category"))
    system = union_all([own("customer", "c_custkey", "c_nationkey", "Customer"), own("supplier", "s_suppkey", "s_nationkey", "Supplier")])
    user = table(spark, d, "customer").where("c_acctbal < 0").select(F.lit("Customer").alias("dimension"), F.col("c_custkey").cast("string").alias("id"), F.lit("d").alias("category"))
    return mapped_categories(override(system, user, ["dimension", "id"]), category_tree(spark, d))


def with_categories(facts: DataFrame, cxm: DataFrame, keys: dict[str, tuple[str, Column]]) -> DataFrame:
    """Left joins with the category map, one for each alias: (dimension, key) give ``<alias>_level1`` to ``<alias>_level3``."""
    for alias, (dimension, key) in keys.items():
        side = cxm.where(F.col("dimension") == dimension).select(F.col("id").alias(f"_{alias}"), *[F.col(f"level{i}").alias(f"{alias}_level{i}") for i in (1, 2, 3)])
        facts = facts.join(side, key.cast("string") == F.col(f"_{alias}"), "left").drop(f"_{alias}")
    return facts


@query(f"WITH {_CATEGORIES} SELECT * FROM cxm")
def categories_x_mapping(spark, d):
    return category_map(spark, d)


@query(f"""WITH {_CATEGORIES}
SELECT l_orderkey, l_linenumber, l_partkey, c.level1 AS buyer_level1, c.level2 AS buyer_level2, c.level3 AS buyer_level3, s.level1 AS seller_level1, s.level2 AS seller_level2, s.level3 AS seller_level3
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN cxm c ON c.dimension = 'Customer' AND c.id = o_custkey::VARCHAR LEFT JOIN cxm s ON s.dimension = 'Supplier' AND s.id = l_suppkey::VARCHAR""")
def lines_with_categories(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = with_categories(lines, category_map(spark, d), {"buyer": ("Customer", F.col("o_custkey")), "seller": ("Supplier", F.col("l_suppkey"))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[f"{a}_level{i}" for a in ("buyer", "seller") for i in (1, 2, 3)])


@query(f"""WITH {_CATEGORIES}
SELECT 'Customer' AS kind, c_custkey AS id, c_name AS name, level1, level2 FROM customer LEFT JOIN cxm ON dimension = 'Customer' AND cxm.id = c_custkey::VARCHAR
UNION ALL SELECT 'Supplier', s_suppkey, s_name, level1, level2 FROM supplier LEFT JOIN cxm ON dimension = 'Supplier' AND cxm.id = s_suppkey::VARCHAR""")
def dim_customers_suppliers(spark, d):
    cxm = category_map(spark, d)
    party = lambda t, p, kind: with_categories(
        table(spark, d, t).select(F.lit(kind).alias("kind"), F.col({"c": "c_custkey", "s": "s_suppkey"}[p]).alias("id"), F.col(f"{p}_name").alias("name")), cxm, {"x": (kind, F.col("id"))}
    )
    both = union_all([party("customer", "c", "Customer"), party("supplier", "s", "Supplier")])
    return both.select("kind", "id", "name", F.col("x_level1").alias("level1"), F.col("x_level2").alias("level2"))


@query("""SELECT DISTINCT 1 AS level, 'World' AS name, NULL AS parent UNION ALL SELECT DISTINCT 2, r_name, 'World' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT DISTINCT 3, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def hierarchy_flatten(spark, d):
    """Each level of a three-level hierarchy once, below its parent."""
    wide = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("World").alias("a"), F.col("r_name").alias("b"), F.col("n_name").alias("c"))
    level = lambda n, name, parent: wide.select(F.lit(n).alias("level"), F.col(name).alias("name"), (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent")).distinct()
    return union_all([level(1, "a", None), level(2, "b", "a"), level(3, "c", "b")])


# -- documents

_FY = "CASE WHEN month({d}) >= 7 THEN year({d}) ELSE year({d}) - 1 END"
_FIRST = "first AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


def fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    """July to June, for two organisations whose years have different labels."""
    y = table(spark, d, "orders").select(F.explode(F.array(F.year("o_orderdate"), F.year("o_orderdate") - 1)).alias("y")).distinct()
    of = lambda org, mark: y.select(F.lit(org).alias("fy_org"), F.make_date("y", F.lit(7), F.lit(1)).alias("FromDate"), F.make_date(F.col("y") + 1, F.lit(6), F.lit(30)).alias("ToDate"), F.concat(F.lit(mark), F.col("y").cast("string")).alias("fy"))
    return of("A", "FY").unionByName(of("B", "BY"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'BY' ELSE 'FY' END || ({_FY.format(d='o_orderdate')}) AS fy FROM orders")
def fiscal_year_by_org(spark, d):
    """The organisation's own year that holds the date: an equi key and a range."""
    orders = table(spark, d, "orders").withColumn("org", F.when(F.col("o_orderpriority").like("1%"), "B").otherwise("A"))
    return range_lookup(orders, fiscal_years(spark, d), F.to_date("o_orderdate"), "FromDate", "ToDate", on=F.col("org") == F.col("fy_org")).select("o_orderkey", "fy")


@query(f"""WITH {_FIRST}, docs AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'Invoice' WHEN 'O' THEN 'Order' ELSE 'Quote' END AS DocumentType, o_orderkey AS DocId, o_custkey AS CustomerId, o_orderdate::DATE AS day, o_totalprice AS Net FROM orders
  UNION ALL SELECT 'Opportunity', event_id, user_id, ts::DATE, value FROM events WHERE event_type = 'purchase')
SELECT DocumentType, DocId, CustomerId, c_mktsegment AS Segment, 'FY' || ({_FY.format(d='day')}) AS FinancialYear, Net, coalesce(day <= first, true) AS isNewCustomer
FROM docs LEFT JOIN customer ON c_custkey = CustomerId LEFT JOIN first ON k = CustomerId""")
def fact_sales(spark, d):
    """Invoices, open orders, open quotes and opportunities with customer, year and whether the customer was new."""
    orders = table(spark, d, "orders")
    doc = lambda kind, df, i, k, day, net: df.select(F.lit(kind).alias("DocumentType"), F.col(i).alias("DocId"), F.col(k).alias("CustomerId"), F.to_date(day).alias("day"), F.col(net).alias("Net"))
    by_status = [doc(kind, orders.where(F.col("o_orderstatus") == s), "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice") for kind, s in (("Invoice", "F"), ("Order", "O"), ("Quote", "P"))]
    docs = union_all([*by_status, doc("Opportunity", table(spark, d, "events").where("event_type = 'purchase'"), "event_id", "user_id", "ts", "value")])
    first = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("first"))
    years = docs.select(F.explode(F.array(F.year("day"), F.year("day") - 1)).alias("y")).distinct()
    years = years.select(F.make_date("y", F.lit(7), F.lit(1)).alias("FromDate"), F.make_date(F.col("y") + 1, F.lit(6), F.lit(30)).alias("ToDate"), F.concat(F.lit("FY"), F.col("y").cast("string")).alias("FinancialYear"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("Segment"))
    out = range_lookup(docs, years, F.col("day"), "FromDate", "ToDate").join(customer, F.col("c_custkey") == F.col("CustomerId"), "left").join(first, F.col("k") == F.col("CustomerId"), "left")
    return out.select("DocumentType", "DocId", "CustomerId", "Segment", "FinancialYear", "Net", X.is_not_true(F.col("day") > F.col("first")).alias("isNewCustomer"))


_DUE = "CASE WHEN {s} IS NOT TRUE THEN 'NotSent' WHEN {b} = 0 THEN 'Paid' WHEN a <= 15 THEN '0-15d' WHEN a <= 30 THEN '16-30d' WHEN a <= 45 THEN '31-45d' WHEN a <= 60 THEN '46-60d' WHEN a <= 90 THEN '61-90d' WHEN a <= 120 THEN '91-120d' ELSE '>120d' END"


@query(f"""WITH i AS (
  SELECT 'Customer' AS kind, o_orderkey AS id, o_totalprice AS gross, 0.0::DOUBLE AS fee, abs(datediff('day', o_orderdate::DATE, DATE '1998-09-02')) AS a, o_orderstatus <> 'P' AS sent, CASE WHEN o_totalprice < 1000 THEN 0 ELSE 1 END AS balance FROM orders
  UNION ALL SELECT 'Supplier', l_orderkey * 10 + l_linenumber, l_extendedprice, l_extendedprice * l_tax, abs(datediff('day', l_shipdate::DATE, DATE '1998-09-02')), l_linestatus = 'F', 1 FROM lineitem)
SELECT kind, id, gross - fee AS net, {_DUE.format(s='sent', b='balance')} AS due FROM i""")
def fact_invoices(spark, d):
    """Customers' and suppliers' invoices without fees, by how far they are from being due."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    customer = o.select(F.lit("Customer").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("net"), X.due_status(F.to_date("o_orderdate"), F.when(F.col("o_totalprice") < 1000, 0).otherwise(1), F.col("o_orderstatus") != "P", AS_OF).alias("due"))
    fee = F.col("l_extendedprice") * F.col("l_tax")
    supplier = line.select(F.lit("Supplier").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") - fee).alias("net"), X.due_status(F.to_date("l_shipdate"), F.lit(1), F.col("l_linestatus") == "F", AS_OF).alias("due"))
    return union_all([customer, supplier])


# -- ledgers

_ACCOUNTS = "SELECT c_mktsegment AS account, o_orderdate::DATE AS day, sum(-(o_totalprice::DECIMAL(28,6))) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"


@query(f"""WITH v AS ({_ACCOUNTS}), since AS (SELECT account, min(day) AS since FROM v GROUP BY 1), days AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM v),
g AS (SELECT account, d.day, {_FY.format(d='d.day')} AS fy, coalesce(amount, 0) AS amount FROM days d JOIN since ON since <= d.day LEFT JOIN v USING (account, day))
SELECT account, day, fy::INTEGER AS fy, (sum(amount) OVER w - amount)::DOUBLE AS opening, (sum(amount) OVER w)::DOUBLE AS closing, (sum(amount) OVER (PARTITION BY account, fy, year(day), month(day)))::DOUBLE AS period
FROM g WINDOW w AS (PARTITION BY account, fy ORDER BY day)""")
def fact_balance(spark, d):
    """Every day of an account since it was first used: opening and closing balance in its fiscal year, and the month's total."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    daily = orders.groupBy(F.col("c_mktsegment").alias("account"), F.to_date("o_orderdate").alias("day")).agg(F.sum(-_money("o_totalprice")).alias("amount"))
    since = daily.groupBy("account").agg(F.min("day").alias("since"))
    days = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    grid = days.join(since, F.col("since") <= F.col("day")).join(daily, ["account", "day"], "left")
    grid = grid.withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(38,6)"))).withColumn("fy", F.year("day") - F.when(F.month("day") >= 7, 0).otherwise(1))
    closing = F.sum("amount").over(Window.partitionBy("account", "fy").orderBy("day"))
    period = F.sum("amount").over(Window.partitionBy("account", "fy", F.year("day"), F.month("day")))
    return grid.select("account", "day", "fy", (closing - F.col("amount")).cast("double").alias("opening"), closing.cast("double").alias("closing"), period.cast("double").alias("period"))


@query("""WITH v AS (
  SELECT 'Actual' AS kind, last_day(l_shipdate::DATE) AS month, p_brand AS account, sum(l_extendedprice::DECIMAL(28,6) * (CASE WHEN l_returnflag IN ('R', 'A') THEN -1 ELSE 1 END)) AS amount
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') GROUP BY 2, 3)
SELECT kind, month, account, amount::DOUBLE AS amount FROM v
UNION ALL SELECT 'Budget', last_day((month + INTERVAL 1 YEAR)::DATE), account, round(amount::DOUBLE * 1.1, 4) FROM v WHERE year(month) < 1998""")
def fact_profit_loss(spark, d):
    """Actual amounts by month end and account with their source's sign, in the categories that count, and budgets from them."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")), F.col("p_partkey") == F.col("l_partkey"))
    sign = F.when(F.col("l_returnflag").isin("R", "A"), -1).otherwise(1)
    actual = lines.groupBy(F.last_day("l_shipdate").alias("month"), F.col("p_brand").alias("account")).agg(F.sum(_money("l_extendedprice") * sign).cast("double").alias("amount"))
    budget = actual.where(F.year("month") < 1998).select(F.lit("Budget").alias("kind"), F.last_day(F.add_months("month", 12)).alias("month"), "account", F.round(F.col("amount") * 1.1, 4).alias("amount"))
    return union_all([actual.select(F.lit("Actual").alias("kind"), "month", "account", "amount"), budget])


@query("""WITH a AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(28,6)) AS actual FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT c_mktsegment AS seg, (date_trunc('month', o_orderdate) + INTERVAL 1 YEAR)::DATE AS month, sum(o_totalprice::DECIMAL(28,6)) AS budget FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(a.seg, b.seg) AS seg, coalesce(a.month, b.month) AS month, coalesce(actual, 0)::DOUBLE AS actual, coalesce(budget, 0)::DOUBLE AS budget FROM a FULL JOIN b ON a.seg = b.seg AND a.month = b.month""")
def vouchers_budgets(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    total = lambda s, at, n: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("c_mktsegment").alias("seg"), at.alias("month")).agg(F.sum(_money("o_totalprice")).cast("double").alias(n))
    return full_outer([total("F", month, "actual"), total("O", F.add_months(month, 12), "budget")], ["seg", "month"]).na.fill(0.0, ["actual", "budget"])


@query("""WITH n AS (SELECT p_brand AS number, p_name AS name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS rn FROM part)
SELECT number, split_part(number, '#', 2) AS short, name, CASE WHEN length(number) > 7 THEN left(number, 7) ELSE number END AS groups, 'Jan''98' AS since FROM n WHERE rn = 1""")
def dim_accounts(spark, d):
    """The latest name of each account number, its parts and a label of its first month."""
    latest = keep_first(table(spark, d, "part"), ["p_brand"], F.desc("p_size"), F.desc("p_partkey"))
    number = F.col("p_brand")
    return latest.select(
        number.alias("number"), X.safe_offset(F.split(number, "#"), 1).alias("short"), F.col("p_name").alias("name"),
        F.when(F.length(number) > 7, F.left(number, F.lit(7))).otherwise(number).alias("groups"), F.date_format(F.lit(dt.date(1998, 1, 1)), "MMM''yy").alias("since"),
    )


# -- stock

_MOVES = "SELECT l_partkey AS part, date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2"


@query(f"""WITH sold AS ({_MOVES.format(f='N')}), received AS ({_MOVES.format(f='A')}), taken AS ({_MOVES.format(f='R')}),
stock AS (SELECT p_partkey AS part, (SELECT max(date_trunc('month', l_shipdate))::DATE FROM lineitem) AS month, p_size::DOUBLE AS q, p_retailprice AS price FROM part WHERE p_size > 10),
m AS (
  SELECT coalesce(s.part, a.part, b.part, c.part) AS part, coalesce(s.month, a.month, b.month, c.month) AS month, s.q AS stock, s.price, coalesce(a.q, 0) AS sold, coalesce(b.q, 0) AS received, coalesce(c.q, 0) AS taken
  FROM stock s FULL JOIN sold a ON s.part = a.part AND s.month = a.month FULL JOIN received b ON b.part = coalesce(s.part, a.part) AND b.month = coalesce(s.month, a.month)
  FULL JOIN taken c ON c.part = coalesce(s.part, a.part, b.part) AND c.month = coalesce(s.month, a.month, b.month)),
w AS (SELECT *, received - sold - taken AS change, coalesce(first_value(stock) OVER x, 0) AS now, coalesce(first_value(price) OVER x, 0) AS cost FROM m WINDOW x AS (PARTITION BY part ORDER BY month DESC)),
o AS (SELECT *, round(now - sum(change) OVER (PARTITION BY part ORDER BY month DESC), 2) AS opening FROM w)
SELECT part, month, sold, received, taken, opening, round(opening + change, 2) AS closing, round((opening + change) * cost, 2) + 0.0::DOUBLE AS closing_value FROM o""")
def fact_warehouses(spark, d):
    """Stock, sales, receipts and stocktakes of a part by month, and what was there, counted back from what is there now."""
    line, last = table(spark, d, "lineitem"), table(spark, d, "lineitem").agg(F.to_date(F.date_trunc("month", F.max("l_shipdate"))).alias("month"))
    move = lambda flag, name: line.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.sum("l_quantity").alias(name))
    stock = table(spark, d, "part").where("p_size > 10").crossJoin(last).select(F.col("p_partkey").alias("part"), "month", F.col("p_size").cast("double").alias("stock"), F.col("p_retailprice").alias("price"))
    all_ = full_outer([stock, move("N", "sold"), move("A", "received"), move("R", "taken")], ["part", "month"]).na.fill(0.0, ["sold", "received", "taken"])
    back = Window.partitionBy("part").orderBy(F.desc("month"))
    change = F.col("received") - F.col("sold") - F.col("taken")
    now = lambda c: F.coalesce(F.first(c).over(back), F.lit(0.0))
    out = all_.withColumn("change", change).withColumn("opening", F.round(now("stock") - F.sum("change").over(back), 2)).withColumn("cost", now("price"))
    closing = F.col("opening") + F.col("change")
    return out.select("part", "month", "sold", "received", "taken", "opening", F.round(closing, 2).alias("closing"), (F.round(closing * F.col("cost"), 2) + F.lit(0.0)).alias("closing_value"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(l.value - coalesce(p.price, l.value / nullif(l.l_quantity, 0)) * l.l_quantity, 6) + 0.0::DOUBLE AS margin
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS value FROM lineitem) l,
LATERAL (SELECT arg_max(s.l_extendedprice / s.l_quantity, (s.l_shipdate, s.l_orderkey * 10 + s.l_linenumber)) AS price FROM lineitem s JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE s.l_partkey = l.l_partkey AND s.l_shipdate <= o.o_orderdate) p""")
def contribution_suppliers(spark, d):
    """A line's margin over the last price at which its part came in by the day of the order; without one, over its own."""
    line = table(spark, d, "lineitem")
    left = line.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    left = left.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_orderdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    came = line.select("l_partkey", F.col("l_shipdate").alias("at"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    priced = as_of_join(left, came, "l_partkey", "o_orderdate", "at", "price", "tie")
    cost = F.coalesce("last_price", F.try_divide("value", "l_quantity")) * F.col("l_quantity")
    return priced.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(F.col("value") - cost, 6) + F.lit(0.0)).alias("margin"))


# -- people


@query("""WITH w AS (SELECT user_id, ts::DATE AS day, 'attendance' AS kind, value AS hours FROM events WHERE event_type = 'click'
UNION ALL SELECT user_id, ts::DATE, 'absence', CASE WHEN value <> 0 THEN value ELSE json_extract(props, '$.k')::DOUBLE / 100 * 8 END FROM events WHERE event_type = 'error'),
h AS (SELECT user_id, day, sum(hours::DECIMAL(28,6)) FILTER (kind = 'attendance') AS attended, sum(hours::DECIMAL(28,6)) FILTER (kind = 'absence') AS absent FROM w GROUP BY 1, 2),
p AS (SELECT user_id, ts::DATE AS day, sum(value::DECIMAL(28,6)) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT coalesce(h.user_id, p.user_id) AS user_id, coalesce(h.day, p.day) AS day, attended::DOUBLE AS attended, absent::DOUBLE AS absent, paid::DOUBLE AS paid FROM h FULL JOIN p ON h.user_id = p.user_id AND h.day = p.day""")
def fact_salaries(spark, d):
    """Attendance and absence beside what was paid, by person and day; absence without hours counts by its extent."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    extent = X.json_typed(F.col("props"), "$.k", "double") / 100 * 8
    worked = union_all([
        e.where("event_type = 'click'").select("user_id", "day", F.lit("attendance").alias("kind"), F.col("value").alias("hours")),
        e.where("event_type = 'error'").select("user_id", "day", F.lit("absence").alias("kind"), F.when(F.col("value") != 0, F.col("value")).otherwise(extent).alias("hours")),
    ])
    of = lambda k: F.sum(F.when(F.col("kind") == k, _money("hours"))).cast("double")
    hours = worked.groupBy("user_id", "day").agg(of("attendance").alias("attended"), of("absence").alias("absent"))
    paid = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.sum(_money("value")).cast("double").alias("paid"))
    return full_outer([hours, paid], ["user_id", "day"])


@query("""SELECT user_id, ts::DATE AS day, coalesce(cause, 'Other') AS cause, max(event_id) AS last_id, count(*) AS n, round(sum(value::DECIMAL(28,6))::DOUBLE, 6) AS hours
FROM events LEFT JOIN (VALUES ('click', 'Work'), ('view', 'Travel'), ('error', 'Leave')) c(code, cause) ON code = event_type GROUP BY 1, 2, 3""")
def fact_time_reporting(spark, d):
    codes = spark.createDataFrame([("click", "Work"), ("view", "Travel"), ("error", "Leave")], "code string, cause string")
    e = table(spark, d, "events").join(codes, F.col("code") == F.col("event_type"), "left")
    return e.groupBy("user_id", F.to_date("ts").alias("day"), F.coalesce("cause", F.lit("Other")).alias("cause")).agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.round(F.sum(_money("value")).cast("double"), 6).alias("hours"))


# -- forecast

_CASH = """WITH o AS (SELECT *, o_orderdate::DATE AS day FROM orders), l AS (SELECT *, l_shipdate::DATE AS day FROM lineitem), c AS (
  SELECT 'customer invoices' AS kind, (day + 30)::DATE AS due, o_totalprice AS amount FROM o WHERE o_orderstatus = 'F' AND day + 30 >= DATE '1998-09-02'
  UNION ALL SELECT 'orders', (day + 60)::DATE, o_totalprice FROM o WHERE o_orderstatus = 'O' AND day >= DATE '1998-09-02' - 365
  UNION ALL SELECT 'supplier invoices', (day + 30)::DATE, -l_extendedprice FROM l WHERE l_linestatus = 'F' AND day + 30 >= DATE '1998-09-02'
  UNION ALL SELECT 'taxes', last_day(day), -l_extendedprice * l_tax FROM l WHERE l_tax > 0 AND day >= DATE '1998-09-02'
  UNION ALL SELECT 'contracts', (date_trunc('month', day) + to_months(k::INTEGER))::DATE, o_totalprice / 12 FROM o, unnest([0, 3, 6, 9]) u(k) WHERE o_orderpriority LIKE '5%' AND day >= DATE '1998-09-02'
  UNION ALL SELECT 'balance', DATE '1998-09-02', c_acctbal FROM customer WHERE c_acctbal <> 0)"""


@query(f"{_CASH} SELECT kind, due, count(*) AS n, sum(amount::DECIMAL(28,6))::DOUBLE AS amount FROM c GROUP BY 1, 2")
def liquidity(spark, d):
    """Cash to come, by kind and day, as seen on a day: six kinds, each with its own filter."""
    o, line = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    now = F.lit(AS_OF)
    row = lambda df, kind, due, amount: df.select(F.lit(kind).alias("kind"), due.alias("due"), amount.cast("double").alias("amount"))
    quarters = o.where(F.col("o_orderpriority").like("5%") & (F.col("day") >= now)).withColumn("k", F.explode(F.array(*map(F.lit, (0, 3, 6, 9)))))
    cash = union_all([
        row(o.where((F.col("o_orderstatus") == "F") & (F.date_add("day", 30) >= now)), "customer invoices", F.date_add("day", 30), F.col("o_totalprice")),
        row(o.where((F.col("o_orderstatus") == "O") & (F.col("day") >= F.date_sub(now, 365))), "orders", F.date_add("day", 60), F.col("o_totalprice")),
        row(line.where((F.col("l_linestatus") == "F") & (F.date_add("day", 30) >= now)), "supplier invoices", F.date_add("day", 30), -F.col("l_extendedprice")),
        row(line.where((F.col("l_tax") > 0) & (F.col("day") >= now)), "taxes", F.last_day("day"), -F.col("l_extendedprice") * F.col("l_tax")),
        row(quarters, "contracts", F.add_months(F.trunc("day", "month"), F.col("k")), F.col("o_totalprice") / 12),
        row(table(spark, d, "customer").where("c_acctbal <> 0"), "balance", now, F.col("c_acctbal")),
    ])
    return cash.groupBy("kind", "due").agg(F.count(F.lit(1)).alias("n"), F.sum(_money("amount")).cast("double").alias("amount"))

