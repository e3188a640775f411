"""Relational algebra with set semantics over DataFrames.

Relation values have a heading of distinct names; results are sets. Positional operators number columns from 0.
Zero-column relations are supported: they hold one empty row (unit, true) or none (false).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..values import RelationError, same_kinds

MAX_HEADING = 65_535


def heading(df: DataFrame) -> list[str]:
    """Names in canonical order; duplicates are an error."""
    if len(set(df.columns)) != len(df.columns):
        raise RelationError("E_HEADING", "a column is named twice")
    if len(df.columns) > MAX_HEADING:
        raise RelationError("E_HEADING", "too many columns")
    return sorted(df.columns)


def relation(df: DataFrame) -> DataFrame:
    """df as a relation value: columns in canonical order, a set of rows."""
    return df.select(*(F.col(f"`{c}`") for c in heading(df))).distinct()


def unit(spark, present: bool = True) -> DataFrame:
    return spark.range(1 if present else 0).select()


def _holds(df: DataFrame) -> bool:
    return not df.isEmpty()


def positional(df: DataFrame, prefix: str = "c") -> DataFrame:
    return df.toDF(*(f"{prefix}{i}" for i in range(len(df.columns))))


def project(df: DataFrame, *names: str) -> DataFrame:
    """By name, a set. No names: whether there are rows."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise RelationError("E_HEADING", f"no column {missing[0]}")
    if not names:
        return unit(df.sparkSession, _holds(df))
    return relation(df.select(*(F.col(f"`{n}`") for n in dict.fromkeys(names))))


def project_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """By position, which may repeat and reorder; a set with columns c0, c1, ..."""
    if not positions:
        return unit(df.sparkSession, _holds(df))
    own = positional(df)
    _check_positions(own, positions)
    return own.select(*(F.col(f"c{p}").alias(f"c{i}") for i, p in enumerate(positions))).distinct()


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    out = df.withColumnsRenamed(names)
    heading(out)
    return out


def _check_positions(df: DataFrame, positions: Sequence[int]) -> None:
    if any(not 0 <= p < len(df.columns) for p in positions):
        raise RelationError("E_ARITY", "a position is beyond the arity")


def _sides(left: DataFrame, right: DataFrame, left_at: Sequence[int], right_at: Sequence[int]):
    if len(left_at) != len(right_at):
        raise RelationError("E_ARITY", "key lists differ in length")
    a, b = positional(left, "l"), positional(right, "r")
    _check_positions(a, left_at)
    _check_positions(b, right_at)
    on = None
    for i, j in zip(left_at, right_at, strict=True):
        same_kinds(a.schema[i].dataType, b.schema[j].dataType, "a join key")
        term = a[f"l{i}"] == b[f"r{j}"]
        on = term if on is None else on & term
    return a, b, on


def join_eq(left: DataFrame, right: DataFrame, left_at: Sequence[int], right_at: Sequence[int]) -> DataFrame:
    """Equi-join by positions: all columns of both, c0, c1, ...; no keys: the product. Sets in, a set out."""
    a, b, on = _sides(left, right, left_at, right_at)
    joined = a.crossJoin(b) if on is None else a.join(b, on)
    return positional(joined)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    return join_eq(left, right, [], [])


def _filtered(left: DataFrame, right: DataFrame, left_at, right_at, how: str) -> DataFrame:
    a, b, on = _sides(left, right, left_at, right_at)
    if on is None:
        keep = _holds(right) == (how == "left_semi")
        return left if keep else left.limit(0)
    keys = b.select(*(F.col(f"r{j}") for j in dict.fromkeys(right_at)))
    return a.join(keys, on, how).toDF(*left.columns)


def semi_join(left: DataFrame, right: DataFrame, left_at: Sequence[int], right_at: Sequence[int]) -> DataFrame:
    """Rows of left with a match."""
    return _filtered(left, right, left_at, right_at, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_at: Sequence[int], right_at: Sequence[int]) -> DataFrame:
    """Rows of left without one."""
    return _filtered(left, right, left_at, right_at, "left_anti")


def _aligned(left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    if heading(left) != heading(right):
        raise RelationError("E_HEADING", f"{what} of relations with different headings")
    for c in left.columns:
        same_kinds(left.schema[c].dataType, right.schema[c].dataType, what)
    return right.select(*(F.col(f"`{c}`") for c in left.columns))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    other = _aligned(left, right, "union")
    if not left.columns:
        return unit(left.sparkSession, _holds(left) or _holds(right))
    return relation(left.union(other))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    other = _aligned(left, right, "difference")
    if not left.columns:
        return unit(left.sparkSession, _holds(left) and not _holds(right))
    return relation(left.subtract(other))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    other = _aligned(left, right, "intersection")
    if not left.columns:
        return unit(left.sparkSession, _holds(left) and _holds(right))
    return relation(left.intersect(other))


def union_at(left: DataFrame, right: DataFrame) -> DataFrame:
    """By position."""
    if len(left.columns) != len(right.columns):
        raise RelationError("E_ARITY", "union of different arities")
    return union(positional(left), positional(right))


def difference_at(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise RelationError("E_ARITY", "difference of different arities")
    return difference(positional(left), positional(right))


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """On all shared names, which come once; none shared: the product. Equal headings: the intersection."""
    shared = [c for c in heading(left) if c in heading(right)]
    for c in shared:
        same_kinds(left.schema[c].dataType, right.schema[c].dataType, "a natural join")
    if not left.columns:
        return right if _holds(left) else right.limit(0)
    if not right.columns:
        return left if _holds(right) else left.limit(0)
    if shared == heading(left) == heading(right):
        return intersect(left, right)
    return relation(left.join(right, shared) if shared else left.crossJoin(right))
