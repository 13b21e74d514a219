"""Everything that the first steps of a cleaning run must know about the raw cells, in one scan.

Which text columns become numbers, what the string steps change, which of the repaired columns
hold decorated numbers or boolean words, and how many cells are null: all of it depends on single
cells only, so one grouped aggregate over the long form answers for every step beforehand. What a
later step does not need, because an earlier one has made the column numeric, is not used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.names import cell
from burnish.functions.numbers import num_whole
from burnish.operators.coerce import MAJORITY, boolean_number, decorated_number
from burnish.operators.typing import LOAD_SHARE, ROW_ORDER, data_columns, is_text, present
from burnish.plans.fused import column_aggregates

#: The string steps for one column: from a cell to the repaired cell.
Repair = Callable[[Column], Column]


@dataclass(frozen=True)
class ColumnFacts:
    """Counts of one column; all but the first two are of text columns only."""

    rows: int
    filled: int
    numbers: int = 0
    changed: int = 0
    kept: int = 0
    decorated: int = 0
    booleans: int = 0


@dataclass(frozen=True)
class TypedTable:
    """The table after null tokens, types, string steps and coercion, with what they did."""

    df: DataFrame
    rows: int
    nulls: int
    changed: int
    coerced: int


def raw_facts(df: DataFrame, repairs: dict[str, tuple[str, Repair]]) -> dict[str, ColumnFacts]:
    """One scan; columns with the same string steps (by name) share an aggregate."""
    columns = data_columns(df)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(repairs[c][0] if c in repairs else "", []).append(c)
    out: dict[str, ColumnFacts] = {}
    for members in groups.values():
        repair = next((repairs[c][1] for c in members if c in repairs), None)

        def counts(v: Column, repair: Repair | None = repair) -> dict[str, Column]:
            found = {"n": F.count(v), "rows": F.count(F.lit(1))}
            if repair is None:
                return found
            after, blank = repair(v), F.lit("")
            return found | {
                "numbers": F.count(num_whole(v)),
                "changed": F.count_if(F.coalesce(v, blank) != F.coalesce(after, blank)),
                "kept": F.count(after),
                "decorated": F.count(decorated_number(after)),
                "booleans": F.count(boolean_number(after)),
            }

        values = {
            c: present(df, c) if c in repairs else F.when(present(df, c).isNotNull(), F.lit(""))
            for c in members
        }
        for c, f in column_aggregates(df, values, counts).items():
            f = {k: v or 0 for k, v in f.items()}
            out[c] = ColumnFacts(f.pop("rows"), f.pop("n"), **f)
    return out


def typed_table(
    df: DataFrame, repairs: dict[str, tuple[str, Repair]], numbers: bool = True,
    booleans: bool = True, share: float = LOAD_SHARE,
) -> TypedTable:
    """Null tokens, inferred types, string steps and coercion as one projection of the raw table.

    ``repairs`` has a name and the string steps for every text column.
    """
    facts = raw_facts(df, repairs)
    rows = max((f.rows for f in facts.values()), default=0) if facts else df.count()
    changed = coerced = 0
    out = []
    for c in df.columns:
        if c == ROW_ORDER:
            out.append(cell(c))
            continue
        f, v = facts[c], present(df, c)
        if is_text(df.schema[c].dataType):
            if f.numbers >= share * f.filled:
                v = num_whole(v)
            else:
                changed += f.changed
                v = repairs[c][1](v)
                if numbers and f.decorated > int(f.kept * MAJORITY):
                    v, coerced = decorated_number(v), coerced + f.decorated
                elif booleans and f.kept and f.booleans == f.kept:
                    v, coerced = boolean_number(v), coerced + f.booleans
        out.append(v.alias(c))
    nulls = sum(f.rows - f.filled for f in facts.values())
    return TypedTable(df.select(*out), rows, nulls, changed, coerced)
