"""Dialect semantics as Column expressions: no Python runs per row, so all of it stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_DIGITS = r"^\s*([+-]?\d+)"


def _null_if_any(columns: list[Column], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), F.lit(None)).otherwise(value)


def idiv(a: Column, b: Column) -> Column:
    """Integer division toward zero; null on zero."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    """``%`` of integers: the sign of the dividend; null on zero."""
    return F.when(b != 0, a % F.when(b != 0, b))


def float_modulo(a: Column, b: Column) -> Column:
    """``%`` of doubles: floored; null on zero."""
    d = F.when(b != 0, b)
    return a - F.floor(a / d) * d


def mod(a: Column, b: Column) -> Column:
    """MOD(a, b): floored and whole; null on zero."""
    return float_modulo(a, b).cast("long")


def concat(*columns: Column) -> Column:
    """CONCAT skips nulls."""
    return F.concat_ws("", *[c.cast("string") for c in columns])


def pipes(*columns: Column) -> Column:
    """``||`` turns to text and gives null for null."""
    return F.concat(*[c.cast("string") for c in columns])


def greatest(*columns: Column) -> Column:
    return _null_if_any(list(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return _null_if_any(list(columns), F.least(*columns))


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half away from zero; whole numbers for no digits."""
    out = F.round(x, digits)
    return out.cast("long") if digits == 0 else out


def truncate(x: Column, digits: int = 0) -> Column:
    """Toward zero at so many digits; whole numbers for none."""
    scale = F.lit(10.0**digits)
    out = F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale))
    return out.cast("long") if digits == 0 else out / scale


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """One-based; starts before the text begin at 1, lengths below 0 are 0."""
    begin = F.greatest(start.cast("int"), F.lit(1))
    return s.substr(begin, F.greatest(length.cast("int"), F.lit(0)) if length is not None else F.length(s))


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\r\f\x0b]+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"[ \t\n\r\f\x0b]+$", "")


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def to_int(s: Column) -> Column:
    """CAST(text AS INTEGER): the leading digits, none give 0."""
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, _DIGITS, 1).try_cast("long"), F.lit(0)))


def to_double(s: Column) -> Column:
    """CAST(text AS DOUBLE): the leading number, none gives null."""
    return F.regexp_extract(s, _NUMBER, 1).try_cast("double")


def type_name(column: Column, data_type: str) -> Column:
    """TYPEOF by the column's Spark type."""
    kind = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "FLOAT", "double": "FLOAT"}.get(data_type, "VARCHAR")
    return F.when(column.isNull(), "NULL").otherwise(kind)


def case_value(subject: Column, arms: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Simple CASE in which a null subject meets a null WHEN."""
    out = reduce(lambda acc, arm: acc.when(subject.eqNullSafe(arm[0]), arm[1]), arms[1:], F.when(subject.eqNullSafe(arms[0][0]), arms[0][1]))
    return out.otherwise(otherwise) if otherwise is not None else out


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a regular expression: ``%`` and ``_`` are wild, other operators stay; it is searched for anywhere."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        else:
            out.append({"%": ".*", "_": "."}.get(c, c))
        i += 1
    return "".join(out)


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    return s.rlike(similar_pattern(pattern, escape))


def add_months(d: Column, n: Column | int) -> Column:
    """Dates clamp to the end of the month."""
    return F.add_months(d, n)


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def as_flag(c: Column) -> Column:
    """A predicate in a select list: 1, 0 or null."""
    return c.cast("int")


def last(*columns: Column) -> list[Column]:
    """ORDER BY keys ascending, nulls last."""
    return [c.asc_nulls_last() for c in columns]


def last_desc(*columns: Column) -> list[Column]:
    return [c.desc_nulls_last() for c in columns]
