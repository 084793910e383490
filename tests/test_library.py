import datetime as dt
import graphlib
import random

import pytest
from pyspark.sql import functions as F

from tidemill import functions as X
from tidemill.operators import as_of_join, not_in, range_lookup, union_all
from tidemill.plans import costs, graph, marts, models, quality
from tidemill.plans.metrics import Compiler, Measure, Metric, Model
from tidemill.sources import Conflict, VersionedTable, from_toon, latest_timestamp, schema_name, snapshot, table_metadata, to_toon
from tidemill.streaming import upsert_stream, windowed_counts


def test_series_and_years(spark):
    r = spark.range(1).select(X.series(F.lit(3), F.lit(1)).alias("none"), X.series(F.lit(0), F.lit(2)).alias("some"), X.year_diff(F.lit("2024-01-01"), F.lit("2023-12-31")).alias("y"), X.shifted_year(F.lit(dt.date(2024, 2, 29)), 1).alias("d"), X.initcap_words(F.lit("foo-bar baz")).alias("i")).first()
    assert (r["none"], r["some"], r.y, r.d, r.i) == ([], [0, 1, 2], 1, dt.date(2025, 2, 28), "Foo-Bar Baz")


def test_upsert_keeps_one_row_a_key_and_adds_columns(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), ["k"], protected=True)
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "k int, v string, n int"))
    assert sorted(map(tuple, t.current().select("k", "v", "n").collect()), key=str) == [(1, "a", None), (2, "c", 5), (3, "d", 6)]
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(PermissionError):
        t.replace(t.current())


def test_snapshot_versions(spark):
    at = lambda n: F.lit(dt.datetime(2024, 1, n))
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    h = snapshot(None, rows((1, "a"), (2, "b")), "k", ["v"], at(1))
    h = snapshot(h, rows((1, "x")), "k", ["v"], at(2))
    h = snapshot(h, rows((1, "x"), (2, "b")), "k", ["v"], at(3))
    got = sorted((r.k, r.v, r.is_deleted, r.valid_from.day, r.valid_to and r.valid_to.day) for r in h.collect())
    assert got == sorted([(1, "a", False, 1, 2), (1, "x", False, 2, None), (2, "b", False, 1, 2), (2, "b", True, 2, 3), (2, "b", False, 3, None)])


def test_union_drift_raises(spark):
    with pytest.raises(ValueError):
        union_all([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])


def test_missing_adapter_raises(spark):
    with pytest.raises(LookupError):
        models.conformed_union("c", [models.Connector("A", "SEK", True, ("c",))], {}, ())


def test_as_of_keeps_null_values_and_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10, 1), ("a", 5, None, 1), ("a", 5, 7, 2)], "k string, at int, v int, n int")
    got = {(r.k, r.t): r.last_v for r in as_of_join(left, right, "k", "t", "at", "v", "n").collect()}
    assert got == {("a", 5): 7, ("a", 0): None, (None, 5): None}


def test_as_of_by_spans_of_time(spark):
    """A key with most rows, spans without a right row, nulls: the same as one sweep and as the definition."""
    dice = random.Random(5)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=dice.randrange(900)) if dice.random() < 0.95 else None
    key = lambda: dice.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), day()) for i in range(300)]
    right = [(key(), day(), dice.choice([None, i]), i) for i in range(120)]
    l = spark.createDataFrame(left, "i int, k string, t timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, v int, n int")
    want = {}
    for i, k, t in left:
        before = [(at, n, v) for rk, at, v, n in right if k is not None and rk == k and at and t and at <= t]
        want[i] = max(before, key=lambda x: x[:2])[2] if before else None
    for span in (None, "month", "year"):
        out = as_of_join(l, r, "k", "t", "at", "v", "n", span=span)
        assert out.columns == ["i", "k", "t", "last_v"]
        assert {x.i: x.last_v for x in out.collect()} == want


def test_not_in_and_periods(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    found = lambda *v: sorted((r.x for r in not_in(left, "x", values(*v)).collect()), key=str)
    assert found(1) == [2] and found(1, None) == [] and found() == [1, 2, None] and found(5, 5) == [1, 2]
    periods = spark.createDataFrame([("p", dt.date(2020, 1, 15), dt.date(2021, 2, 10)), ("q", dt.date(2021, 2, 11), dt.date(2021, 2, 20)), ("empty", dt.date(2021, 3, 2), dt.date(2021, 3, 1)), ("open", dt.date(2022, 1, 1), None)], "p string, lo date, hi date")
    days = spark.createDataFrame([(dt.date(2020, 1, 14),), (dt.date(2020, 1, 15),), (dt.date(2021, 2, 10),), (dt.date(2021, 2, 11),), (dt.date(2021, 3, 1),), (None,)], "d date")
    out = range_lookup(days, periods, F.col("d"), "lo", "hi")
    assert [r.p for r in out.orderBy(F.asc_nulls_last("d")).collect()] == [None, "p", "p", "q", None, None]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_one_model_in_one_pass(spark):
    """Ratios and saved queries by conditional aggregates are those of separate legs."""
    rows = [(i, "abc"[i % 3] if i % 7 else None, dt.date(2020, 1 + i % 9, 1 + i % 28), i * 1.5) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, kind string, day date, x double")
    model = Model("m", frame, {"row": "id"}, "day", (Measure("total", "sum", "x"), Measure("n", "count", "id"), Measure("ids", "count_distinct", "id")), {"kind": "kind"})
    a, b = "{{ Dimension('row__kind') }} = 'a'", "{{ Dimension('row__kind') }} <> 'b'"
    metrics = [Metric("some", measure="total", filter=a), Metric("more", measure="n", filter=b, spine=True, fill=0), Metric("all", measure="ids"), Metric("r", "ratio", numerator="some", denominator="more"), Metric("s", "ratio", numerator="all", denominator="some")]

    def found(c, late):
        out = []
        for dims in ((), ("row__kind",)):
            for df in (c.build("r", "month", dims, late), c.build("s", "month", dims, late), c.saved(["some", "all", "more"], "month", dims, late), c.saved(["more", "some"], "month", dims, late)):
                out.append(sorted(map(repr, df.collect())))
        return out

    one, legs = Compiler([model], metrics), Compiler([model], metrics)
    legs._together = lambda metrics: False
    for late in ((), ("{{ Dimension('row__kind') }} in ('a', 'c')",)):
        assert found(one, late) == found(legs, late)
    assert "Join" not in one.saved(["some", "all"], "month", ())._jdf.queryExecution().executedPlan().toString()


def test_project_builds_only_what_is_needed(spark):
    loaded = []
    p = models.Project(spark, lambda n: loaded.append(n) or spark.range(3))
    p.model("raw", name="a")(lambda r: r.where("id > 0"))
    p.model("other", name="b")(lambda r: r)
    assert p.build("a").count() == 2 and loaded == ["raw"]


def test_graph_on_the_driver():
    with pytest.raises(graphlib.CycleError):
        graph.order({"a": ["b"], "b": ["a"]})
    assert graph.critical_path({"a": [], "b": ["a"]}, {"a": 1, "b": 2}) == (3.0, ["a", "b"])
    assert graph.chain_kind(["direct", "renamed", "union"]) == "renamed"


def test_costs(spark, tmp_path):
    card = {"source": "s", "models": {"m": {"input": 1, "output": 2, "cache_creation": 0, "cache_read": 0}}}
    (tmp_path / "t.jsonl").write_text('{"type":"assistant","sessionId":"s","message":{"model":"m","usage":{"input_tokens":1000000}}}\n\nnot json\n{"type":"user"}\n{"type":"assistant","message":{"model":"x","usage":{"output_tokens":5}}}\n')
    out = costs.cost_by(costs.priced(costs.read_traces(spark, str(tmp_path)), costs.rate_card(spark, card)), "model").collect()
    assert [(r.model, r.cost, r.unpriced) for r in out] == [("m", 1.0, 0), ("x", None, 1)]
    with pytest.raises(ValueError):
        costs.rate_card(spark, {"models": {}})
    with pytest.raises(ValueError):
        costs.rate_card(spark, {"source": "s", "models": {"m": {"input": 1}}})


def test_text_table_round_trip(spark):
    rows = [(1, "plain", None), (2, 'a, "b"', 1.5)]
    name, back = from_toon(to_toon("t", spark.createDataFrame(rows, "i int, s string, x double")))
    assert name == "t" and [tuple(r.values()) for r in back] == rows


def test_catalog(spark):
    empty = spark.createDataFrame([], "org string, at timestamp")
    assert [tuple(r) for r in table_metadata(empty, "t", "org", "at").collect()] == [("t", None, None, 0)]
    assert latest_timestamp([], spark).first().latest is None
    assert schema_name("x", "dev", "me") == "me_x" and schema_name("x", "prod", "me") == "x"
    with pytest.raises(PermissionError):
        schema_name(None, "dev", "analytics")


def test_contract():
    assert quality.contract_diff([("a", "int"), ("c", "int")], [("a", "long"), ("b", "int")]) == [("missing", "b", "int"), ("extra", "c", "int"), ("type", "a", "int for long")]
    assert quality.severity(3, 2, 5) == "warn"


def test_freshness_limits_are_exact(spark):
    """A rounded age of just the limit can be over it or not; a fraction of ``now`` and of the limits counts too."""
    utc = lambda *t: dt.datetime(*t, tzinfo=dt.timezone.utc)
    hours, us = dt.timedelta(hours=1), dt.timedelta(microseconds=1)

    def of(age, now=utc(2024, 1, 10), warn=24 * hours, error=48 * hours):
        return tuple(quality.freshness(spark.createDataFrame([(now - age,), (now - 99 * 24 * hours,)], "ts timestamp"), "ts", now, warn, error).first())

    assert [of(24 * hours), of(24 * hours + us), of(48 * hours), of(48 * hours + us), of(-hours)] == [(86400, "pass"), (86400, "warn"), (172800, "warn"), (172800, "error"), (-3600, "pass")]
    late = utc(2024, 1, 10, 0, 0, 0, 400000)
    assert [of(48 * hours, late), of(48 * hours + 400000 * us, late)] == [(172800, "warn"), (172800, "error")]
    assert of(2 * us, warn=us, error=dt.timedelta.max) == (0, "warn")
    empty = spark.createDataFrame([], "ts timestamp")
    assert tuple(quality.freshness(empty, "ts", late, hours, hours).first()) == (None, "error")


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string").coalesce(1).write.parquet(src)
    t = VersionedTable(spark, str(tmp_path / "out"), ["k"])
    q = upsert_stream(spark.readStream.schema("k int, t int, v string").parquet(src), t, "t", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in t.current().collect()) == [(1, "b"), (2, "c")]


def test_two_writers_of_a_table(spark, tmp_path):
    """A writer that comes second works on the first one's rows; a crash before the manifest leaves the old version."""
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    a, b = VersionedTable(spark, str(tmp_path), ["k"]), VersionedTable(spark, str(tmp_path), ["k"])
    a.upsert(rows((1, "a"), (None, "n")))
    real, turns = a._publish, []

    def late(df, base):
        if not turns:
            turns.append(b.upsert(rows((2, "b"))))
        return real(df, base)

    a._publish = late
    a.upsert(rows((1, "c"), (None, "m")))
    got = sorted(((r.k, r.v) for r in a.current().collect()), key=str)
    assert got == sorted([(1, "c"), (2, "b"), (None, "m")], key=str) and a.version() == 3
    with pytest.raises(Conflict):
        real(rows((9, "z")), 1)
    assert a.version() == 3 and a.current(1).count() == 2
    spark.range(3).write.parquet(f"{tmp_path}/v-lost")  # written, never published
    assert a.current().count() == 3


def test_repeated_keys_of_a_batch(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), ["k"])
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, at int, v string")
    with pytest.raises(ValueError):
        t.upsert(batch)
    t.upsert(batch, order_by="at")
    assert [r.v for r in t.current().collect()] == ["b"]


def test_lineage_of_unions(spark):
    a, b = spark.range(1).select(F.col("id").alias("x"), F.lit(1).alias("y")), spark.range(1).select((F.col("id") + 1).alias("u"), F.col("id").alias("w"))
    left, right = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "x int, z int")
    both = graph.column_lineage(left.union(right))
    assert both == [("x", "x", "union"), ("x", "x", "union"), ("y", "y", "union"), ("y", "z", "renamed")]
    assert len(graph.column_lineage(a.union(b).select((F.col("x") * 2).alias("s")))) == 2
    assert graph.chain_kind(["direct", "passthrough", "macro"]) == "macro" and graph.chain_kind(["ambiguous", "derived"]) == "ambiguous"


def test_contract_and_model_descriptions():
    assert quality.drift({"c": {"a": {"x", "y"}, "b": {"x"}}}) == [("c", "b", "y")]
    good = {"fct_o": {"kind": "fact", "grain": "order", "keys": {"k": "dim_c"}, "measures": {"m": "additive"}}, "dim_c": {"kind": "dimension", "key": "k", "attributes": ["valid_from", "valid_to"], "history": 2}}
    assert quality.dimensional_findings(good) == []
    bad = {"fct_o": {"kind": "fact", "keys": {"k": "dim_x", "f": "orders"}, "measures": {"m": "sum"}}, "orders": {"kind": "fact", "grain": "g", "keys": {"a": "dim_c"}, "measures": {"m": "none"}}, "dim_c": {"kind": "dimension", "key": "k", "attributes": ["a"], "history": 2}, "x": {"kind": "view"}}
    found = quality.dimensional_findings(bad)
    assert {("fct_o", "no grain"), ("fct_o", "key to unknown dim_x"), ("fct_o", "key to a fact: orders"), ("fct_o", "measure m without additivity"), ("orders", "name of no fact"), ("dim_c", "history without validity"), ("x", "kind view")} == set(found)


def test_model_on_mocked_rows(spark):
    """A model's rows from given rows: regions and levels of a category that is inactive, missing, or on top."""
    from pyspark.testing import assertDataFrameEqual

    tree = spark.createDataFrame([("a", "A", "b", True), ("b", "B", "c", None), ("c", "C", None, True), ("x", "X", "a", False)], "id string, name string, parent string, active boolean")
    mapping = spark.createDataFrame([("d", "1", "a"), ("d", "2", "c"), ("d", "3", "x"), ("d", "4", None), ("d", "1", "a")], "dimension string, id string, category string")
    want = spark.createDataFrame([("d", "1", "C", "B", "A"), ("d", "2", "C", "Others", "Others"), ("d", "3", "Others", "Others", "Others"), ("d", "4", "Others", "Others", "Others")], "dimension string, id string, level1 string, level2 string, level3 string")
    assertDataFrameEqual(marts.mapped_categories(mapping, tree), want)


def test_json_by_path(spark):
    rows = spark.createDataFrame([('{"a":{"b":1},"c":[{"d":"x"}],"e":null,"f":"1,5"}',), ("no json",), (None,)], "j string")
    got = rows.select(*[X.json_scalar(F.col("j"), p).alias(n) for n, p in (("obj", "$.a"), ("b", "$.a.b"), ("d", "$.c[0].d"), ("e", "$.e"))], X.json_typed(F.col("j"), "$.f", "double").alias("f")).collect()
    assert [tuple(r) for r in got] == [(None, "1", "x", None, None), (None,) * 5, (None,) * 5]


def test_late_events_as_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,CAST(id AS INT)) AS ts, 'a' AS event_type, 1.0D AS value FROM range(10)").coalesce(1).write.parquet(src)
    counts = windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
    q = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.window.start.day, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(d, 1) for d in range(1, 7)]  # the last days are still open


def test_month_series_and_ends(spark):
    r = spark.range(1).select(X.month_series(F.lit(dt.date(2024, 1, 31)), F.lit(dt.date(2024, 3, 31))).alias("m"), X.inclusive_end(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2025, 1, 1))).alias("e")).first()
    assert r.m == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)] and r.e == dt.date(2024, 12, 31)


def test_llm_folders_can_be_left_out(tmp_path):
    """The entry module without the subpackage and the pipeline; and with a subpackage that fails to import, which is no reason to leave it out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    out = run("import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)")
    assert out.stdout.split() == ["0", "False"], out.stderr
    (tmp_path / "tidemill" / "llm").mkdir()
    (tmp_path / "tidemill" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemill" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run("import __spark_entry__ as e; e.queries()").stderr
