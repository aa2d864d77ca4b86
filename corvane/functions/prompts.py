"""Prompts as columns. Only fields that don't name the unit go in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PERMITTED

QUERY_VERSION = "1"
LABEL_VERSION = "1"


def blind(units: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """units reduced to what a generator may see, and the columns to keep beside it."""
    have = set(units.columns)
    context = {c: F.col(f"context.{c}") for c in ("class_name", "module_docstring", "imports", "parent_methods") if "context" in have}
    return units.select(*keep, *[(context[c] if c in context and c not in have else F.col(c)).alias(c) for c in PERMITTED])


def assert_blind(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> None:
    """Refuse a table that holds anything but the permitted columns."""
    if {*df.columns} - {*keep} != {*PERMITTED}:
        raise ValueError(f"columns beside the permitted ones: {sorted({*df.columns} - {*keep} ^ {*PERMITTED})}")


def _line(title: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{title}: "), value))


def context_block() -> Column:
    """What surrounds a unit; parts that are empty are left out."""
    return F.concat_ws("\n", _line("Class", F.col("class_name")), _line("Module", F.col("module_docstring")), _line("Imports", F.array_join("imports", ", ")), _line("Other methods", F.array_join("parent_methods", ", ")), _line("Documentation", F.col("docstring")))


def query_prompt() -> Column:
    ask = "Write one search request that this code answers. Don't use its names, files or addresses. Give JSON with query, query_style (natural, technical, verbose or concise) and query_intent."
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Kind: "), F.col("symbol_type")), F.nullif(context_block(), F.lit("")), F.concat(F.lit("```python\n"), F.col("source_code"), F.lit("\n```")))


def label_prompt() -> Column:
    ask = "Describe what this code does. Give JSON with description (20 to 256 words), summary, concepts (two or more), input_types, output_type and side_effects."
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Kind: "), F.col("symbol_type")), F.nullif(context_block(), F.lit("")), F.concat(F.lit("```python\n"), F.col("source_code"), F.lit("\n```")))
