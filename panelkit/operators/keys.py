"""What joins and groups ask of their keys: NULL keys match each other, repeated ones are refused.

The checks are part of the aggregations that the results need anyway, so they travel with the job and
raise in the task that meets the offending key; no table is read a second time for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.numbering import null_safe_join

# Words of 64 bits in which the years of a group are marked.
YEAR_WORDS = 4


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys of ``left`` stay, those of ``right`` go.

    ``how`` is ``inner``, ``left`` or ``left_semi``. Columns besides the keys must have different names.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash and how != "left_semi":
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    return null_safe_join(left, right, keys, how)


def refuse(df: DataFrame, wrong: Column, message: str, keys: Sequence[str]) -> DataFrame:
    """``df``; a row for which ``wrong`` holds raises an error with the message and its keys."""
    shown = F.to_json(F.struct(*[_named(k) for k in keys]), {"ignoreNullFields": "false"})
    error = F.raise_error(F.concat(F.lit(f"{message}: "), shown))
    return df.where(F.when(wrong, error.cast("boolean")).otherwise(True))


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows of a lookup table, one per key; a repeated key, NULL keys included, raises an error."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*[_named(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.first(_named(c)).alias(c) for c in rest]
    )
    return refuse(counted, F.col("_rows") > 1, f"{what} repeat a key", keys).drop("_rows")


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], what: str, how: str = "left"
) -> DataFrame:
    """:func:`match_keys` with a table that has one row per key, which is checked."""
    return match_keys(left, unique_rows(right, keys, what), keys, how)


def full_by_key(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full join of any number of tables that have one row per key, as one aggregation.

    The rows of all tables are put below each other and grouped by the keys, so there is one exchange
    whatever the number of tables, and NULL keys meet. Each table's rows are counted in the same
    aggregation: a key that a table repeats raises an error. Columns besides the keys must differ.
    """
    owner: dict[str, int] = {}
    for i, table in enumerate(tables):
        for c in table.columns:
            if c not in keys and owner.setdefault(c, i) != i:
                raise ValueError(f"column of two tables: {c}")
    types = {c: tables[i].schema[c].dataType for c, i in owner.items()}
    sides = [
        t.select(
            *[_named(k) for k in keys],
            F.lit(i).alias("_side"),
            *[(_named(c) if owner[c] == i else F.lit(None).cast(types[c])).alias(c) for c in owner],
        )
        for i, t in enumerate(tables)
    ]
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    counts = [F.count(F.when(F.col("_side") == i, 1)).alias(f"_rows_{i}") for i in range(len(tables))]
    found = every.groupBy(*[_named(k) for k in keys]).agg(
        *counts, *[F.first(_named(c), ignorenulls=True).alias(c) for c in owner]
    )
    repeated = F.lit(False)
    for i in range(len(tables)):
        repeated = repeated | (F.col(f"_rows_{i}") > 1)
    checked = refuse(found, repeated, "a table repeats a key", keys)
    return checked.select(*[_named(k) for k in keys], *[_named(c) for c in owner])


def year_marks(year: Column, rows: Column, base: int) -> list[Column]:
    """Aggregates ``_year_0, ...`` that mark the years of the rows where ``rows`` holds, a bit for each."""
    slot = F.pmod(year - base, F.lit(64 * YEAR_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    return [
        F.bit_or(F.when(rows & (F.floor(slot / 64) == i), bit)).alias(f"_year_{i}") for i in range(YEAR_WORDS)
    ]


def marked_years() -> Column:
    """How many different years :func:`year_marks` saw, exact for spans of less than 256 years."""
    words = [F.bit_count(F.coalesce(f"_year_{i}", F.lit(0).cast("bigint"))) for i in range(YEAR_WORDS)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total
