"""The feature-table build as one plan: blocks, checked merge, pruning, contract, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import checks, contract, panel, temporal
from panelforge.operators.filters import in_period
from panelforge.operators.recipes import FeatureRecipe, apply_recipe
from panelforge.sources.writers import write_projections


@dataclass(frozen=True)
class PanelSpec:
    """One longitudinal source: its columns, the closed period and months to use, and the prefix of its features."""

    prefix: str
    key: str
    sensor: str
    date: str
    cloud: str
    variables: Sequence[str]
    start: str
    end: str
    months: Sequence[int] = ()
    mode: str = "competition"
    recipes: Sequence[FeatureRecipe] = field(default_factory=tuple)


def panel_blocks(df: DataFrame, spec: PanelSpec) -> list[DataFrame]:
    """Summary, coverage and recipe blocks of a source, each with one row a key. One scan of the distinct sensors fixes the schema."""
    rows = df.where(in_period(spec.date, spec.start, spec.end, spec.months))
    sensors = panel.levels(rows, spec.sensor)
    blocks = [
        panel.period_summary(rows, spec.key, spec.sensor, spec.variables, sensors, spec.prefix),
        panel.coverage(rows, spec.key, spec.sensor, spec.date, spec.cloud, spec.variables, sensors, f"{spec.prefix}_cov"),
        temporal.coverage_gaps(rows, [spec.key], spec.date, spec.cloud, months=False).select(spec.key, *(F.col(c).alias(f"{spec.prefix}__{c}") for c in ("n_unique_dates", "span_days", "median_gap_days", "max_gap_days"))),
    ]
    return blocks + [apply_recipe(rows, r) for r in spec.recipes]


def records(block: DataFrame, key: str, family: str, mode: str, inputs: Sequence[str]) -> list[dict]:
    return [{"column": c, "family": family, "mode": mode, "inputs": list(inputs), "formula": c.rpartition("__")[2], "meaning": f"{family} feature"} for c in block.columns if c != key]


def build(base: DataFrame, key: str, panels: Mapping[str, tuple[DataFrame, PanelSpec]], blocks: Sequence[tuple[DataFrame, str, str]] = ()) -> tuple[DataFrame, list[dict]]:
    """(table, manifest records): base left-joined with all blocks, columns without data dropped, contract asserted.

    blocks: further tables as (table, family, mode). Raises on repeated keys, clashing columns and values that are not finite.
    """
    parts, notes = [], []
    for family, (df, spec) in panels.items():
        for b in panel_blocks(df, spec):
            parts.append(b)
            notes += records(b, key, family, spec.mode, spec.variables)
    for b, family, mode in blocks:
        parts.append(b)
        notes += records(b, key, family, mode, [])
    table = checks.drop_empty(checks.merge_blocks(base, *parts, on=[key]), keep=base.columns)
    doubles = [f.name for f in table.schema if f.dataType.typeName() in ("double", "float")]
    broken = contract.feature_contract(table, key, doubles).where("status <> 'ok'").collect()
    if broken:
        raise ValueError(f"feature table breaks its contract: {[(r['name'], r['observed']) for r in broken]}")
    kept = set(table.columns)
    return table, [n for n in notes if n["column"] in kept]


def publish(table: DataFrame, notes: list[dict], folder: str, key: str) -> None:
    """All, clean and competition projections with the manifest."""
    write_projections(table, folder, key, notes)
