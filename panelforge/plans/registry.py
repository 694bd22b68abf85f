"""Registered queries: a Spark function, the columns it returns, and the same query in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}



def nearby(c: str) -> Column:
    """A double to 6 places, half away from zero, without the decimal text that round() goes by: for results of very many rows."""
    scaled = (F.col(c).cast("double") + 3e-9) * 1e6
    whole = F.floor(F.abs(scaled) + 0.5)
    return F.when(F.abs(scaled) < 2.0**51, F.signum(scaled) * whole / 1e6).otherwise(SPARK["d"](c)) + 0.0


#: Column kinds: l long, d double to 6 places, f the same in arithmetic alone, m double to 2 places, s string, t date, z timestamp, b boolean.
SPARK = {
    "l": lambda c: F.col(c).cast("long"),
    "d": lambda c: F.round(F.col(c).cast("double") + 3e-9, 6) + 0.0,
    "f": nearby,
    "m": lambda c: F.round(F.col(c).cast("double") + 3e-5, 2) + 0.0,
    "s": lambda c: F.col(c).cast("string"),
    "t": lambda c: F.col(c).cast("date"),
    "z": lambda c: F.col(c).cast("timestamp_ntz"),
    "b": lambda c: F.col(c).cast("boolean"),
}
SQL = {
    "l": "CAST({0} AS BIGINT) AS {0}",
    "d": "round(CAST({0} AS DOUBLE) + 3e-9, 6) + 0.0 AS {0}",
    "f": "round(CAST({0} AS DOUBLE) + 3e-9, 6) + 0.0 AS {0}",
    "m": "round(CAST({0} AS DOUBLE) + 3e-5, 2) + 0.0 AS {0}",
    "s": "CAST({0} AS VARCHAR) AS {0}",
    "t": "CAST({0} AS DATE) AS {0}",
    "z": "CAST({0} AS TIMESTAMP) AS {0}",
    "b": "CAST({0} AS BOOLEAN) AS {0}",
}


def columns_of(spec: str) -> list[tuple[str, str]]:
    """"l: a b, d: x" -> [(a, l), (b, l), (x, d)]."""
    out = []
    for part in spec.split(","):
        kind, _, names = part.strip().partition(":")
        out += [(n, kind.strip()) for n in names.split()]
    return out


def query(spec: str, sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir); both sides are brought to the spec's types and rounding."""
    cols = columns_of(spec)

    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query exists: {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*(SPARK[k](c).alias(c) for c, k in cols))

        run.__name__ = key
        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            lead, body = ("", sql.strip())
            if body.upper().startswith("WITH"):
                cut = split_with(body)
                lead, body = body[:cut], body[cut:]
            ORACLE[key] = f"{lead} SELECT {', '.join(SQL[k].format(c) for c, k in cols)} FROM ({body}) q_"
        return f

    return register


def split_with(sql: str) -> int:
    """Where the final SELECT of a WITH statement starts: the first at depth 0 after its definitions."""
    depth = 0
    for i, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and sql[i : i + 6].upper() == "SELECT" and (i == 0 or not sql[i - 1].isalnum()):
            return i
    raise ValueError("no SELECT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
