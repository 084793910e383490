"""Column expressions whose meaning differs between warehouses, spelled with built-in functions only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def initcap_words(c: Column) -> Column:
    """Upper case after every character that is no letter or digit, not after blanks only."""
    marked = F.regexp_replace(F.lower(c), r"([\p{L}\p{N}]+)", "\u0001$1")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def year_diff(a: Column, b: Column) -> Column:
    """Calendar-year boundaries between two dates."""
    return F.year(a) - F.year(b)


def last_day_of_year(d: Column) -> Column:
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def inclusive_end(start: Column, end: Column) -> Column:
    """An exclusive fiscal-year end as the last day: one day earlier if both stand on one day of the month."""
    return F.when(F.dayofmonth(start) == F.dayofmonth(end), F.date_sub(end, 1)).otherwise(end)


def safe_offset(array: Column, i: int) -> Column:
    return F.get(array, F.lit(i))


def regexp_first(c: Column, pattern: str, group: int = 0) -> Column:
    """Null where the pattern does not match; an empty match counts as none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def series(start: Column, stop: Column) -> Column:
    """Whole numbers from start to stop, none if start is larger."""
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def month_series(start: Column, stop: Column) -> Column:
    return F.sequence(start, stop, F.expr("interval 1 month"))


def null_if_any(f, *columns: Column) -> Column:
    """least or greatest that is null if any argument is."""
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, f(*columns))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_not_true(c: Column) -> Column:
    return ~is_true(c)


def is_not_false(c: Column) -> Column:
    return ~c.eqNullSafe(F.lit(False))


def json_scalar(c: Column, path: str) -> Column:
    """A scalar at the path as text; null for objects, arrays, JSON nulls, missing paths and text that is no JSON."""
    found = F.try_variant_get(F.try_parse_json(c), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.get_json_object(c, path))


def json_typed(c: Column, path: str, kind: str) -> Column:
    """The value at the path in a type; null if it is missing or does not convert."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def unquoted(c: Column) -> Column:
    """JSON text of a string without its quotes."""
    return F.regexp_replace(c, '^"|"$', "")


def latest_first(day: Column, as_of: dt.date) -> Column:
    """A sort key for the latest date that is not in the future; dates in the future come last."""
    return F.when(day <= F.lit(as_of), day).desc_nulls_last()


def shifted_year(d: Column, years: Column | int) -> Column:
    """The date in another year, its day no later than that month's last."""
    first = F.make_date(F.year(d) + years, F.month(d), F.lit(1))
    return F.make_date(F.year(first), F.month(first), F.least(F.dayofmonth(d), F.dayofmonth(F.last_day(first))))


def due_status(due: Column, balance: Column, sent: Column, as_of: dt.date) -> Column:
    late = F.abs(F.datediff(F.lit(as_of), due))
    out = F.when(is_not_true(sent), "NotSent").when(balance == 0, "Paid").when(due.isNull(), "NO_DUE_DATE")
    for most, label in ((15, "0-15d"), (30, "16-30d"), (45, "31-45d"), (60, "46-60d"), (90, "61-90d"), (120, "91-120d")):
        out = out.when(late <= most, label)
    return out.otherwise(">120d")


def net_unit_price(price: Column, rate: Column, vat_included: Column, vat: Column) -> Column:
    """Without VAT, in the default currency; a null flag takes the branch that strips VAT."""
    return price * rate * F.when(is_not_true(vat_included), 1 / (1 + vat / 100)).otherwise(F.lit(1.0))


def surrogate_key(*columns: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
