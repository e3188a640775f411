"""Pattern queries: R(?x, 3, _) over a relation, and the reads that expect one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..values import RelationError, kind_of, literal_kind, same_kinds
from .algebra import positional, unit


@dataclass(frozen=True)
class Var:
    """A free variable; it names a column of the result. One that occurs twice must match equal cells."""

    name: str


class _Any:
    """Matches anything and is dropped."""

    def __repr__(self) -> str:
        return "_"


ANY = _Any()


def bound(df: DataFrame, *terms: object) -> DataFrame:
    """The rows that match, with all columns. Constants and repeated variables reach the scan as filters."""
    if len(terms) != len(df.columns):
        raise RelationError("E_ARITY", f"{len(terms)} terms for {len(df.columns)} columns")
    own, seen = positional(df), {}
    for i, term in enumerate(terms):
        c = F.col(f"c{i}")
        if term is ANY:
            continue
        if isinstance(term, Var):
            if term.name in seen:
                j = seen[term.name]
                same_kinds(own.schema[j].dataType, own.schema[i].dataType, f"?{term.name}")
                own = own.filter(F.col(f"c{j}") == c)
            else:
                seen[term.name] = i
        elif kind_of(own.schema[i].dataType) == literal_kind(term) or literal_kind(term) not in ("bool", "int", "float", "string", "bytes"):
            own = own.filter(c == F.lit(term))
        else:
            own = own.filter(F.lit(False))  # constants of another kind are never equal
    return own.toDF(*df.columns)


def query(df: DataFrame, *terms: object) -> DataFrame:
    """The free variables of the pattern as a relation. Without any: whether a row matches, as unit or nothing."""
    rows = positional(bound(df, *terms))
    names = {}
    for i, term in enumerate(terms):
        if isinstance(term, Var):
            names.setdefault(term.name, i)
    if not names:
        return unit(df.sparkSession, not rows.isEmpty())
    return rows.select(*(F.col(f"c{i}").alias(n) for n, i in names.items())).distinct()


def exists(df: DataFrame, *terms: object) -> bool:
    """Whether a row matches; the scan stops at the first."""
    return not bound(df, *terms).isEmpty()


def visit(df: DataFrame, accept, *terms: object) -> None:
    """Hands rows to accept until it returns False; partitions that come later aren't read."""
    for row in bound(df, *(terms or [ANY] * len(df.columns))).toLocalIterator():
        if accept(row) is False:
            return


def exactly(df: DataFrame, *terms: object) -> Row:
    """The one row that matches, else E_CARDINALITY."""
    found = query(df, *terms).limit(2).collect()
    if len(found) != 1:
        raise RelationError("E_CARDINALITY", f"expected one row, found {'none' if not found else 'several'}")
    return found[0]


def at_most_one(df: DataFrame, *terms: object) -> Row | None:
    """The row that matches or None; E_CARDINALITY for several."""
    found = query(df, *terms).limit(2).collect()
    if len(found) > 1:
        raise RelationError("E_CARDINALITY", "expected at most one row, found several")
    return found[0] if found else None


def dot(df: DataFrame, *key: object):
    """The value of a functional relation whose last column it is: #k.name."""
    return exactly(df, *key, Var("value"))["value"]
