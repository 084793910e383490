"""Data-quality tests as counts of failing rows, contracts, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().where("count > 1").agg(F.count(F.lit(1)).alias("failing"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("failing"))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(values)).alias("failing"))


def accepted_range(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col(column) < least)
    if most is not None:
        bad = bad | (F.col(column) > most)
    return df.agg(F.count_if(bad).alias("failing"))


def not_null_share(df: DataFrame, column: str, at_least: float) -> DataFrame:
    return df.agg(F.when(F.count(column) < F.count(F.lit(1)) * at_least, 1).otherwise(0).cast("long").alias("failing"))


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(F.expr(expression), F.lit(False))).alias("failing"))


def relationships(df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(to.select(F.col(key).alias(column)), column, "left_anti").agg(F.count(F.lit(1)).alias("failing"))


def severity(failing: int, warn_above: int = 0, error_above: int = 0) -> str:
    return "error" if failing > error_above else "warn" if failing > warn_above else "pass"


def freshness(df: DataFrame, loaded_at: str, now: dt.datetime, warn_after: dt.timedelta, error_after: dt.timedelta) -> DataFrame:
    """``age_seconds`` is between whole seconds, each rounded half to even as SQL casts an epoch; the status compares microseconds, which that rounding would hide."""
    at, loaded = F.unix_micros(F.lit(now)), F.unix_micros(F.max(loaded_at).cast("timestamp"))
    age = F.rint(at / 1e6).cast("long") - F.rint(loaded / 1e6).cast("long")
    older = lambda limit: loaded < at - limit / dt.timedelta(microseconds=1)
    status = F.when(loaded.isNull() | older(error_after), "error").when(older(warn_after), "warn").otherwise("pass")
    return df.agg(age.alias("age_seconds"), status.alias("status"))


def contract_diff(have: list[tuple[str, str]], want: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(kind, column, detail) for missing, extra and retyped columns."""
    h, w = dict(have), dict(want)
    return [("missing", c, t) for c, t in want if c not in h] + [("extra", c, t) for c, t in have if c not in w] + [("type", c, f"{h[c]} for {t}") for c, t in want if c in h and h[c] != t]


def contributions(df: DataFrame, source: str, enabled: list[str]) -> DataFrame:
    """Enabled sources without a row, as rows of ``source``."""
    want = df.sparkSession.createDataFrame([(e,) for e in enabled], "source string")
    return want.join(df.select(F.col(source).alias("source")), "source", "left_anti")


def singular(rows: DataFrame) -> DataFrame:
    """A test that is a query: each of its rows is a failure."""
    return rows.agg(F.count(F.lit(1)).alias("failing"))


def evaluate(df: DataFrame, contract: list[str], identifiers: list[str] = (), domains: dict[str, list] | None = None, personal: dict[str, str] | None = None) -> DataFrame:
    """``finding``, ``what``, ``n``: columns that the contract lacks or has too many, null identifiers, values outside a domain, personal data.

    The counts come from one pass over the rows.
    """
    spark = df.sparkSession
    columns = [("contract-miss", c) for c in contract if c not in df.columns] + [("contract-extra", c) for c in df.columns if c not in contract]
    counts = [("null-identifier", c, F.count_if(F.col(c).isNull())) for c in identifiers]
    counts += [("domain-violation", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(v))) for c, v in (domains or {}).items()]
    counts += [("pii-leak", c, F.count_if(F.col(c).rlike(p))) for c, p in (personal or {}).items()]
    out = spark.createDataFrame([(f, c, 0) for f, c in columns], "finding string, what string, n long")
    if counts:
        one = df.agg(F.array(*[F.struct(F.lit(f).alias("finding"), F.lit(c).alias("what"), n.alias("n")) for f, c, n in counts]).alias("rows"))
        out = out.unionByName(one.select(F.inline("rows")).where("n > 0"))
    return out


def breaking_changes(before: dict[str, dict[str, str]], after: dict[str, dict[str, str]], parents: dict[str, list[str]], contracted: set[str]) -> list[tuple[str, str, str, str, int]]:
    """(kind, model, column, severity, reach) of what changed between two sets of schemas.

    Reach is the number of models downstream. What is removed or retyped breaks if the model has a contract or is read by
    another, and is a warning if not; what is added is neither.
    """
    children: dict[str, set[str]] = {}
    for child, of in parents.items():
        for p in of:
            children.setdefault(p, set()).add(child)

    def reach(model: str) -> int:
        seen, todo = set(), [model]
        while todo:
            todo += (new := children.get(todo.pop(), set()) - seen)
            seen |= new
        return len(seen)

    found = [("removed model", m, "") for m in before if m not in after]
    for m in before.keys() & after.keys():
        old, new = before[m], after[m]
        found += [("removed column", m, c) for c in old if c not in new] + [("added column", m, c) for c in new if c not in old] + [("type", m, c) for c in old if c in new and old[c] != new[c]]
    return [(k, m, c, "info" if k == "added column" else "breaking" if m in contracted or reach(m) else "warning", reach(m)) for k, m, c in found]


def drift(adapters: dict[str, dict[str, set[str]]]) -> list[tuple[str, str, str]]:
    """(concept, source, column) for columns that other sources of a concept have and this one lacks."""
    return sorted((concept, source, c) for concept, of in adapters.items() for source, have in of.items() for c in set().union(*of.values()) - have)


#: What a dimensional model's description must say, by the kind of model.
RULES = {"fact": ("grain", "keys", "measures"), "dimension": ("key", "attributes"), "bridge": ("keys", "weight")}


def dimensional_findings(described: dict[str, dict]) -> list[tuple[str, str]]:
    """(model, finding) for descriptions that break a rule: parts missing, foreign keys to nothing, additive measures without a type, names of another kind."""
    out = []
    for name, m in described.items():
        kind = m.get("kind")
        if kind not in RULES:
            out.append((name, f"kind {kind}"))
            continue
        out += [(name, f"no {part}") for part in RULES[kind] if not m.get(part)]
        out += [(name, f"key to unknown {t}") for t in m.get("keys", {}).values() if t not in described]
        out += [(name, f"key to a fact: {t}") for t in m.get("keys", {}).values() if described.get(t, {}).get("kind") == "fact"]
        out += [(name, f"measure {c} without additivity") for c, a in m.get("measures", {}).items() if a not in ("additive", "semi", "none")] if kind == "fact" else []
        if kind == "dimension" and m.get("history") == 2 and not {"valid_from", "valid_to"} <= set(m.get("attributes", ())):
            out.append((name, "history without validity"))
        if not name.startswith({"fact": "fct_", "dimension": "dim_", "bridge": "bridge_"}[kind]):
            out.append((name, f"name of no {kind}"))
    return sorted(out)
