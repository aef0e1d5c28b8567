"""Sources and sinks: Parquet tables, VALUES, range scans, scripts, and the aligned text grid."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The Parquet tables of a folder, as attributes: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """``VALUES (..), (..)`` with a schema string."""
    return spark.createDataFrame(rows, columns)


def range_scan(df: DataFrame, column: str, low=None, high=None, low_open: bool = False, high_open: bool = False, residual: Column | None = None) -> DataFrame:
    """An index range scan: bounds that Parquet statistics prune by, and a residual predicate."""
    c = F.col(column)
    if low is not None:
        df = df.where(c > low if low_open else c >= low)
    if high is not None:
        df = df.where(c < high if high_open else c <= high)
    return df if residual is None else df.where(residual)


def one_row(spark: SparkSession, *columns: Column) -> DataFrame:
    """A select without FROM."""
    return spark.range(1).select(*columns)


def statements(script: str) -> Iterator[str]:
    """Statements of a script: split at semicolons outside quotes, comments and BEGIN ... END bodies."""
    out, i, depth, n = [], 0, 0, len(script)
    word = ""
    while i < n:
        c = script[i]
        if c in "'\"`":
            j = i + 1
            while j < n and script[j] != c:
                j += 2 if script[j] == "\\" and c == "'" else 1
            out.append(script[i : j + 1])
            i = j + 1
            continue
        if script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else n
            continue
        if script.startswith("/*", i):
            end = script.find("*/", i)
            i = n if end < 0 else end + 2
            continue
        if c.isalpha() or c == "_":
            j = i
            while j < n and (script[j].isalnum() or script[j] == "_"):
                j += 1
            word = script[i:j].upper()
            head = "".join(out).strip().upper()
            if head.startswith(("CREATE PROCEDURE", "CREATE FUNCTION", "CREATE TRIGGER", "CREATE OR REPLACE")) or depth:
                if word in ("BEGIN", "CASE", "LOOP", "REPEAT", "WHILE") or word == "IF" and depth:
                    before = head.rsplit(None, 1)[-1] if head else ""
                    if before != "END":
                        depth += 1
                elif word == "END":
                    depth -= 1
            out.append(script[i:j])
            i = j
            continue
        if c == ";" and depth <= 0:
            if text := "".join(out).strip():
                yield text
            out, depth = [], 0
        else:
            out.append(c)
        i += 1
    if text := "".join(out).strip():
        yield text


def show_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def grid(df: DataFrame, limit: int = 1000) -> str:
    """An aligned text table of at most ``limit`` rows and the number shown; it says so if there are more."""
    rows = [[show_value(v) for v in r] for r in df.limit(limit + 1).collect()]
    first, rows = "first " * (len(rows) > limit), rows[:limit]
    widths = [max([len(c), *(len(r[k]) for r in rows)]) for k, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows), f"({first}{len(rows)} row{'s' * (len(rows) != 1)})"])
