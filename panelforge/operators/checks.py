"""Cardinality and schema checks, and joins that assert them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def known_unique(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the optimiser can prove that keys don't repeat, as after an aggregate by them: no job is run."""
    sets = df._jdf.queryExecution().optimizedPlan().distinctKeys().iterator()
    while sets.hasNext():
        names, attributes = set(), sets.next().iterator()
        while attributes.hasNext():
            names.add(attributes.next().name())
        if names and names <= set(keys):
            return True
    return False


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raises on a key that occurs twice; runs a job, which looks for one such key only, unless the plan proves it can't be."""
    require_columns(df, keys)
    if not known_unique(df, keys) and df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    for x, y, side in ((a, b, "left"), (b, a, "right")):
        if x.join(y, list(keys), "left_anti").limit(1).count():
            raise ValueError(f"keys of the {side} side have no partner")


def merge_blocks(base: DataFrame, *blocks: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left joins of blocks that have one row a key and no column of the base or each other."""
    assert_unique(base, on)
    seen = set(base.columns)
    for block in blocks:
        assert_unique(block, on)
        clash = seen & set(block.columns) - set(on)
        if clash:
            raise ValueError(f"columns occur twice: {sorted(clash)}")
        seen |= set(block.columns)
    return reduce(lambda left, right: left.join(right, list(on), "left"), blocks, base)


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str = "m:1", how: str = "left") -> DataFrame:
    """A join that asserts 1:1, m:1, 1:m or m:m first."""
    a, b = validate.split(":")
    if a == "1":
        assert_unique(left, on)
    if b == "1":
        assert_unique(right, on)
    return left.join(right, list(on), how)


def join_exact(left: DataFrame, right: DataFrame, on: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Inner 1:1 join of sides whose key sets are equal; `drop` columns of the right side stay out."""
    assert_unique(left, on)
    assert_unique(right, on)
    assert_same_keys(left, right, on)
    return left.join(right.drop(*drop), list(on), "inner")


def attach_missing(df: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds only the columns that df lacks, never overwriting; the dimension has one row a key."""
    new = [c for c in dimension.columns if c not in df.columns]
    return join_checked(df, dimension.select(*on, *new), on, "m:1") if new else df


def rename_known(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns that go by one of several known names, compared without accents, case or punctuation, get the first name.

    The first alias that is there wins; a column that is there under its own name stays; unknown columns stay as they are.
    """
    plain = lambda c: re.sub("[^a-z0-9]+", "_", unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()).strip("_")
    have = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    found = {}
    for name, others in aliases.items():
        old = next((have[plain(a)] for a in others if plain(a) in have), None)
        if name not in df.columns and old is not None:
            found[old] = name
    return df.withColumnsRenamed(found)


def drop_empty(df: DataFrame, keep: Sequence[str] = (), constant: bool = False) -> DataFrame:
    """Without columns that are all NULL (or constant too), found in one aggregate pass."""
    others = [c for c in df.columns if c not in keep]
    if not others:
        return df
    measure = F.count_distinct if constant else F.count
    row = df.agg(*(measure(F.col(c)).alias(c) for c in others)).first()
    return df.drop(*(c for c in others if row[c] <= (1 if constant else 0)))


def numeric_with_data(df: DataFrame, suffix: str = "", prefix: str = "") -> list[str]:
    """Numeric columns by name that hold any value."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    names = [n for n in names if n.endswith(suffix) and n.startswith(prefix)]
    row = df.agg(*(F.count(n).alias(n) for n in names)).first() if names else {}
    return [n for n in names if row[n]]
