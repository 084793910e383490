"""Queries of single operators: JSON, dates, arrays, filters, sort keys, catalog, text tables, refusals."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import keep_first, range_lookup, top_counted, union_all
from ..session import shared_dir, table
from ..sources import VersionedTable, from_toon, publish, read_seed, schema_name, stale_tables, to_toon
from . import costs, quality
from .metrics import Compiler, Measure, Metric, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.date(1998, 9, 2)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# -- JSON

_DOC = """'{"a":' || props || ',"l":[' || props || ',{"k":"x' || event_type || '"}],"s":"' || event_type || '","t":' || (event_id % 2 = 0)::VARCHAR || ',"z":null,"f":"12.5"}'"""


def _docs(spark, d):
    e = table(spark, d, "events")
    parts = [F.lit('{"a":'), "props", F.lit(',"l":['), "props", F.lit(',{"k":"x'), "event_type", F.lit('"}],"s":"'), "event_type", F.lit('","t":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"z":null,"f":"12.5"}')]
    return e.select("event_id", F.concat(*parts).alias("doc"))


@query(f"""WITH d AS (SELECT event_id, {_DOC} AS doc FROM events)
SELECT event_id, doc->>'$.a.k' AS inner_k, CASE WHEN json_type(doc, '$.a') IN ('OBJECT', 'ARRAY') THEN NULL ELSE doc->>'$.a' END AS object, doc->>'$.l[0].k' AS first, doc->>'$.l[1].k' AS second, doc->>'$.l[2].k' AS third,
       doc->>'$.s' AS s, doc->>'$.t' AS t, doc->>'$.z' AS z, doc->>'$.missing' AS missing FROM d""")
def json_scalars(spark, d):
    """Scalars by path, also into arrays; an object, a JSON null and a missing path are null."""
    c = F.col("doc")
    paths = {"inner_k": "$.a.k", "object": "$.a", "first": "$.l[0].k", "second": "$.l[1].k", "third": "$.l[2].k", "s": "$.s", "t": "$.t", "z": "$.z", "missing": "$.missing"}
    return _docs(spark, d).select("event_id", *[X.json_scalar(c, p).alias(n) for n, p in paths.items()])


@query(f"""WITH d AS (SELECT event_id, {_DOC} AS doc FROM events)
SELECT event_id, (doc->>'$.a.k')::BIGINT AS whole, (doc->>'$.f')::DOUBLE AS number, try_cast(doc->>'$.s' AS BIGINT) AS none, (doc->>'$.t')::BOOLEAN AS flag FROM d""")
def json_types(spark, d):
    c = F.col("doc")
    return _docs(spark, d).select("event_id", *[X.json_typed(c, p, k).alias(n) for n, p, k in (("whole", "$.a.k", "bigint"), ("number", "$.f", "double"), ("none", "$.s", "bigint"), ("flag", "$.t", "boolean"))])


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS built, event_type AS plain FROM events")
def json_build(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("built"), X.unquoted(F.concat(F.lit(chr(34)), "event_type", F.lit(chr(34)))).alias("plain"))


# -- dates


@query("""SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m'), '%Y%m')::DATE AS month, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS tried,
  strftime(o_orderdate, '%b''%y') AS label FROM orders""")
def dates_parsed(spark, d):
    at = F.col("o_orderdate")
    tried = F.try_to_date(F.when(F.col("o_orderkey") % 3 == 0, F.lit("no date")).otherwise(F.date_format(at, "yyyy-MM-dd")), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(F.date_format(at, "yyyyMM"), "yyyyMM").alias("month"), F.to_date(F.date_format(at, "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"), tried.alias("tried"), F.date_format(at, "MMM''yy").alias("label"))


@query("""SELECT event_id, date_trunc('milliseconds', ts) AS millis, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 2 HOUR AS earlier FROM events""")
def timestamps(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.timestamp_millis(F.unix_millis(ts.cast("timestamp"))).alias("millis"), F.timestamp_add("MINUTE", F.lit(90), ts).alias("later"), F.timestamp_add("HOUR", F.lit(-2), ts).alias("earlier"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (s + INTERVAL 1 YEAR)::DATE - 1 ELSE (s + INTERVAL 1 YEAR)::DATE - 1 END AS last_day FROM (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS s FROM orders)""")
def fiscal_year_ends(spark, d):
    """Ends that are given as the first day after the year, and ends that are its last day, come out the same."""
    start = F.trunc("o_orderdate", "month")
    after = F.add_months(start, 12)
    end = F.when(F.col("o_orderkey") % 2 == 0, after).otherwise(F.date_sub(after, 1))
    return table(spark, d, "orders").select("o_orderkey", X.inclusive_end(start, end).alias("last_day"))


@query("SELECT unnest(generate_series(min(o_orderdate)::DATE, (DATE '1998-09-02' + INTERVAL 2 YEAR)::DATE - 1, INTERVAL 1 DAY))::DATE AS day FROM orders")
def time_spine(spark, d):
    """Days from the first of the data up to two years after a day, which is left out."""
    end = F.date_sub(F.add_months(F.lit(AS_OF), 24), 1)
    return table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo")).select(F.explode(F.sequence("lo", end)).alias("day"))


# -- arrays


@query("""WITH t AS (SELECT l_orderkey, list(l_tax ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS taxes, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(taxes, lambda x: x > 0.04)) AS taxed, list_max(taxes) AS highest, array_to_string(list_filter(flags, lambda f: f <> 'N'), ' ') AS returned, list_filter(flags, lambda f: f <> 'N')[1] AS first_returned FROM t""")
def arrays_of_lines(spark, d):
    """Scalars over an order's own array of lines: how many, the highest, the first that fits, all of them as text."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    returned = F.transform(F.filter("lines", lambda x: x["l_returnflag"] != "N"), lambda x: x["l_returnflag"])
    taxes = F.transform("lines", lambda x: x["l_tax"])
    return o.select("l_orderkey", F.size(F.filter(taxes, lambda t: t > 0.04)).cast("long").alias("taxed"), F.array_max(taxes).alias("highest"), F.array_join(returned, " ").alias("returned"), X.safe_offset(returned, 0).alias("first_returned"))


@query("SELECT o_orderkey, n, v FROM orders, LATERAL (SELECT unnest(['status', 'priority']) AS n, unnest([o_orderstatus, o_orderpriority]) AS v)")
def arrays_of_structs(spark, d):
    pairs = F.array(F.struct(F.lit("status").alias("n"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("priority").alias("n"), F.col("o_orderpriority").alias("v")))
    return table(spark, d, "orders").select("o_orderkey", F.inline(pairs))


# -- filters and joins


@query("""SELECT o_orderkey, instr(o_orderpriority, '-') AS dash, regexp_matches(o_orderpriority, '^[1-3]') AS urgent, try_cast(left(o_orderpriority, 1) AS INTEGER) AS rank, try_cast(o_orderpriority AS INTEGER) AS none FROM orders
WHERE NOT coalesce(CASE WHEN o_custkey % 7 = 0 THEN true WHEN o_custkey % 7 = 1 THEN NULL ELSE false END, false) AND o_orderpriority LIKE '%-%I%' AND o_orderstatus <> 'F' AND o_orderdate >= DATE '1998-09-02' - 365""")
def live_orders(spark, d):
    """Not deleted (null counts as not), a pattern, a status, and no older than a year as seen on a day."""
    k, p = F.col("o_custkey") % 7, F.col("o_orderpriority")
    deleted = F.when(k == 0, True).when(k == 1, F.lit(None)).otherwise(False)
    rows = table(spark, d, "orders").where(~F.coalesce(deleted, F.lit(False)) & p.like("%-%I%") & (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") >= F.date_sub(F.lit(AS_OF), 365)))
    return rows.select("o_orderkey", F.instr(p, "-").cast("long").alias("dash"), p.rlike("^[1-3]").alias("urgent"), F.left(p, F.lit(1)).try_cast("int").alias("rank"), p.try_cast("int").alias("none"))


@query("SELECT p_partkey, p_retailprice - (SELECT avg(p_retailprice::DECIMAL(28,6)) FROM part)::DOUBLE AS above FROM part WHERE p_retailprice > (SELECT avg(p_retailprice::DECIMAL(28,6)) FROM part)::DOUBLE")
def above_average(spark, d):
    """A scalar subquery in the filter and in the projection: one row, joined to all."""
    part = table(spark, d, "part")
    mean = part.agg((F.sum(X.money(F.col("p_retailprice"))).cast("double") / F.count("p_retailprice")).alias("mean"))
    return part.crossJoin(F.broadcast(mean)).where("p_retailprice > mean").select("p_partkey", (F.col("p_retailprice") - F.col("mean")).alias("above"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' THEN c_name ELSE s_name END AS party FROM lineitem JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON l_linestatus = 'F' AND c_custkey = o_custkey LEFT JOIN supplier ON l_linestatus <> 'F' AND s_suppkey = l_suppkey""")
def join_by_kind(spark, d):
    """The join's key depends on the row's kind: a computed key, then one equi-join."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    party = union_all([table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_name").alias("party")), table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ref"), F.col("s_name").alias("party"))])
    ref = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return lines.withColumn("ref", ref).join(party, "ref", "left").select("l_orderkey", "l_linenumber", "l_partkey", "party")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderdate::DATE <= DATE '1998-09-02' THEN o_orderdate::DATE END DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def latest_as_of(spark, d):
    return keep_first(table(spark, d, "orders"), ["o_custkey"], X.latest_first(F.to_date("o_orderdate"), AS_OF), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS key FROM nation")
def dense_keys(spark, d):
    """Keys 1, 2, ... in the order of a dimension's names; a window over all rows, for small dimensions."""
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy("n_name")).cast("long").alias("key"))


@query("""WITH t AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS rn, count(*) OVER () - 15 AS dropped FROM t) SELECT l_partkey, n, dropped FROM r WHERE rn <= 15""")
def top_parts_and_dropped(spark, d):
    return top_counted(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), 15, F.desc("n"), F.col("l_partkey"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def memory_search(spark, d):
    return table(spark, d, "conversations").where(F.lower("text").contains("the")).select("conv_id", "turn")


# -- sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name FROM nation")
def seed_round_trip(spark, d):
    path = _folder(spark, "seed")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return read_seed(spark, path, "n_nationkey int, n_name string")


@query("SELECT event_type AS model, count(*) AS turns, sum(event_id % 1000)::BIGINT AS input_tokens FROM events GROUP BY 1")
def nested_traces(spark, d):
    """Nested JSON lines, with lines between them that are no traces."""
    path = _folder(spark, "traces")
    usage = F.struct((F.col("event_id") % 1000).alias("input_tokens"))
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.col("event_type").alias("model"), usage.alias("usage")).alias("message"))).alias("value"))
    noise = spark.range(1).select(F.explode(F.array(F.lit(""), F.lit("not json"), F.lit('{"type":"user"}'), F.lit('{"type":"assistant","message":{"model":"m"}}'))).alias("value"))
    lines.unionByName(noise).write.text(path)
    return costs.read_traces(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("turns"), F.sum("input_tokens").alias("input_tokens"))


_COST = "round(sum(CASE event_type WHEN 'view' THEN 2.0 WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 5.0 WHEN 'signup' THEN 7.0 END * (event_id % 1000) / 1e6), 9)::DOUBLE AS cost"


def _priced(spark, d):
    card = {"source": "test", "models": {m: {"input": r, "output": 1, "cache_creation": 1, "cache_read": 1} for m, r in (("view", 2), ("click", 3), ("purchase", 5), ("signup", 7))}}
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("session"), "ts", (F.col("event_id") % 1000).alias("prompt_tokens"))
    return costs.priced(costs.read_flat(e), costs.rate_card(spark, card))


@query(f"SELECT event_type AS model, count(*) AS turns, sum(event_id % 1000)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, {_COST} FROM events GROUP BY 1")
def usage_cost_by_model(spark, d):
    return costs.by_model(_priced(spark, d)).select("model", "turns", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


@query(f"SELECT user_id::VARCHAR AS session, min(ts) AS started_at, count(*) AS turns, {_COST}, count(*) FILTER (event_type = 'error') AS unpriced FROM events GROUP BY 1")
def usage_cost_by_session(spark, d):
    return costs.by_session(_priced(spark, d), "ts").withColumn("cost", F.round("cost", 9))


@query("SELECT * FROM (VALUES ('customer_alias', true), ('customer_export', true)) t(name, same)")
def published_aliases(spark, d):
    """One frame under an alias and as an exported table, and both found in the catalog."""
    nation = table(spark, d, "nation")
    mark = uuid.uuid4().hex[:8]
    names = {"customer_alias": publish(nation, f"alias_{mark}"), "customer_export": publish(nation, f"export_{mark}", materialized=f"{_folder(spark, 'export')}")}
    rows = [(label, spark.table(n).exceptAll(nation).isEmpty() and spark.table(n).count() == nation.count()) for label, n in sorted(names.items())]
    return spark.createDataFrame(rows, "name string, same boolean")


@query("SELECT 'stale' AS name, true AS found, true AS kept_in_dry_run, true AS dropped")
def stale_objects(spark, d):
    """A database with a table that no model makes: found, kept by a dry run, dropped on demand."""
    db = f"tm_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{_folder(spark, 'db')}'")
    for t in ("live", "stale"):
        table(spark, d, "region").write.saveAsTable(f"{db}.{t}")
    found = stale_tables(spark, db, {"live"})
    there = spark.catalog.tableExists(f"{db}.stale")
    stale_tables(spark, db, {"live"}, dry_run=False)
    row = (found[0], found == ["stale"], there, not spark.catalog.tableExists(f"{db}.stale") and spark.catalog.tableExists(f"{db}.live"))
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame([row], "name string, found boolean, kept_in_dry_run boolean, dropped boolean")


@query("SELECT o_orderstatus, count(*) AS n, 1 AS files FROM orders GROUP BY 1")
def partitioned_table(spark, d):
    """A table by partitions: a filter on the partition reads its folder only."""
    t = VersionedTable(spark, _folder(spark, "parts"), ["o_orderkey"], partition_by=("o_orderstatus",))
    t.replace(table(spark, d, "orders").coalesce(1))
    live = t.current()
    rows = [(s, live.where(F.col("o_orderstatus") == s).count(), len({f.rpartition("/")[0] for f in live.inputFiles() if f"o_orderstatus={s}/" in f})) for s in sorted(r[0] for r in live.select("o_orderstatus").distinct().collect())]
    return spark.createDataFrame(rows, "o_orderstatus string, n long, files int")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def text_table_round_trip(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    _, back = from_toon(to_toon("nations", rows))
    return spark.createDataFrame([tuple(r.values()) for r in back], "n_nationkey int, n_name string, r_name string")


@query("SELECT * FROM (VALUES ('prod', 'marts', 'marts'), ('dev', 'marts', 'me_marts'), ('dev', NULL, 'me'), ('dev', 'refused', 'PermissionError')) t(target, custom, found)")
def schema_routes(spark, d):
    def of(target, custom, default="me"):
        try:
            return schema_name(custom, target, default)
        except PermissionError as e:
            return type(e).__name__

    rows = [("prod", "marts", of("prod", "marts")), ("dev", "marts", of("dev", "marts")), ("dev", None, of("dev", None)), ("dev", "refused", of("dev", None, "analytics"))]
    return spark.createDataFrame(rows, "target string, custom string, found string")


# -- metrics that are refused


_REFUSED = [
    ("by_offset_leg", "offset of a ratio's leg"), ("by_ratio_leg", "revenue_share is ratio"), ("by_two_grains", "offsets of different grains"), ("both_windows", "exactly one of window and grain_to_date"),
    ("no_window", "exactly one of window and grain_to_date"), ("running_distinct", "cumulative count_distinct"), ("to_grain", "offset_to_grain"), ("unknown_grain", "grain fortnight"), ("unknown_kind", "kind conversion"),
    ("unknown_measure", "measure nothing"), ("unknown_aggregate", "aggregate percentile"), ("unknown_dimension", "dimension order__nothing"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{r.replace(chr(39), chr(39) * 2)}')" for n, r in _REFUSED) + ") t(metric, reason)")
def metric_refusal_reasons(spark, d):
    """What cannot be compiled faithfully, each with its reason; two more compile."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    measures = (Measure("total", "sum", "o_totalprice"), Measure("buyers", "count_distinct", "o_custkey"), Measure("p90", "percentile", "o_totalprice"))
    model = Model("orders", orders, {"order": "o_orderkey"}, "day", measures, {"status": "o_orderstatus"})
    of = lambda *i: tuple(i)
    c = Compiler([model], [
        Metric("revenue", measure="total", filter="{{ Dimension( 'order__status' ) }} <> 'F'"), Metric("revenue_share", "ratio", numerator="revenue", denominator="revenue"),
        Metric("by_offset_leg", "ratio", numerator="revenue", denominator="revenue", denominator_offset="1 month"), Metric("by_ratio_leg", "ratio", numerator="revenue_share", denominator="revenue"),
        Metric("by_two_grains", "derived", expr="a - b", inputs=of(("revenue", "a", "1 month"), ("revenue", "b", "1 year"))), Metric("to_grain", "derived", expr="a", inputs=of(("revenue", "a", None)), offset_to_grain="month"),
        Metric("unknown_grain", "derived", expr="a", inputs=of(("revenue", "a", "1 fortnight"))), Metric("both_windows", "cumulative", measure="total", window=7, grain_to_date="month"),
        Metric("no_window", "cumulative", measure="total"), Metric("running_distinct", "cumulative", measure="buyers", window=7), Metric("unknown_kind", "conversion"), Metric("unknown_measure", measure="nothing"),
        Metric("unknown_aggregate", measure="p90"), Metric("unknown_dimension", measure="total", filter="{{ Dimension('order__nothing') }} > 1"),
    ])
    built = c.build_all()
    if set(built) != {"revenue", "revenue_share"}:
        raise AssertionError(sorted(built))
    return spark.createDataFrame(sorted(c.skipped.items()), "metric string, reason string")


# -- quality


@query("""SELECT * FROM (SELECT 'share' AS test, (count(lang) < 0.99 * count(*))::BIGINT AS failing FROM documents UNION ALL SELECT 'where', count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 1000) FROM orders
UNION ALL SELECT 'singular', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) < 0) UNION ALL SELECT 'contributes', (SELECT count(*) FROM (VALUES ('view'), ('refund'), ('click')) t(x) WHERE x NOT IN (SELECT event_type FROM events)))""")
def quality_of_rows(spark, d):
    """A proportion, a test on some rows, a singular test (any row fails), and sources that contribute nothing."""
    orders = table(spark, d, "orders")
    tests = {
        "share": quality.not_null_share(table(spark, d, "documents"), "lang", 0.99),
        "where": quality.expression_is_true(orders.where("o_orderstatus = 'P'"), "o_totalprice >= 1000"),
        "singular": quality.singular(orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).where("v < 0")),
        "contributes": quality.contributions(table(spark, d, "events"), "event_type", ["view", "refund", "click"]).agg(F.count(F.lit(1)).alias("failing")),
    }
    return union_all([t.select(F.lit(n).alias("test"), F.col("failing").cast("long").alias("failing")) for n, t in tests.items()])


@query("""SELECT * FROM (SELECT 'contract-miss' AS finding, 'email' AS what, 0::BIGINT AS n UNION ALL SELECT 'contract-extra', 'c_acctbal', 0 UNION ALL SELECT 'null-identifier', 'c_custkey', (SELECT count(*) FROM customer WHERE c_custkey IS NULL OR c_custkey = 0)
UNION ALL SELECT 'domain-violation', 'c_mktsegment', (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')) UNION ALL SELECT 'pii-leak', 'c_name', (SELECT count(*) FROM customer WHERE regexp_matches(c_name, '[0-9]{9}'))) WHERE n > 0 OR finding LIKE 'contract%'""")
def model_eval(spark, d):
    """A model's frame against its contract: columns, identifiers, domains and columns that look like personal data."""
    c = table(spark, d, "customer").withColumn("c_custkey", F.nullif("c_custkey", F.lit(0)))
    return quality.evaluate(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "email"], identifiers=["c_custkey"], domains={"c_mktsegment": ["BUILDING", "FURNITURE"]}, personal={"c_name": "[0-9]{9}"})


@query("""SELECT * FROM (VALUES ('removed model', 'old', '', 'breaking', 1), ('removed column', 'orders', 'total', 'breaking', 2), ('type', 'orders', 'day', 'breaking', 2), ('removed column', 'notes', 'text', 'warning', 0), ('added column', 'orders', 'tax', 'info', 2))
t(kind, model, column_name, severity, reach)""")
def contract_changes(spark, d):
    before = {"orders": {"id": "long", "total": "double", "day": "date"}, "notes": {"id": "long", "text": "string"}, "old": {"id": "long"}}
    after = {"orders": {"id": "long", "day": "string", "tax": "double"}, "notes": {"id": "long"}}
    parents = {"mart": ["orders"], "report": ["mart", "old"]}
    rows = quality.breaking_changes(before, after, parents, contracted={"orders", "old"})
    return spark.createDataFrame(rows, "kind string, model string, column_name string, severity string, reach int")


@query("SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN NULL ELSE 'FY' || year(o_orderdate) END AS year FROM orders")
def range_by_calendar(spark, d):
    """A pure range join, without an equi key, against few periods."""
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    years = y.select(F.make_date("y", F.lit(1), F.lit(1)).alias("lo"), F.make_date("y", F.lit(12), F.lit(31)).alias("hi"), F.concat(F.lit("FY"), F.col("y").cast("string")).alias("year"))
    return range_lookup(table(spark, d, "orders"), years, F.to_date("o_orderdate"), "lo", "hi").select("o_orderkey", "year")
