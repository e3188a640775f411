"""Programmatic plans: the logical operators, built into one DataFrame that Catalyst optimizes as a whole."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import algebra
from ..operators.pattern import ANY, bound
from ..values import RelationError

Reader = Mapping[str, DataFrame] | Callable[[str], DataFrame]


class Plan:
    """Columns of a result are c0, c1, ..."""

    def to_df(self, read: Reader) -> DataFrame:
        raise NotImplementedError

    def project(self, *positions: int) -> Plan:
        return Project(self, positions)

    def join(self, right: Plan, left_at: Sequence[int], right_at: Sequence[int]) -> Plan:
        return JoinEq(self, right, tuple(left_at), tuple(right_at))

    def semi_join(self, right: Plan, left_at: Sequence[int], right_at: Sequence[int]) -> Plan:
        return SemiJoin(self, right, tuple(left_at), tuple(right_at))

    def anti_join(self, right: Plan, left_at: Sequence[int], right_at: Sequence[int]) -> Plan:
        return AntiJoin(self, right, tuple(left_at), tuple(right_at))

    def union(self, right: Plan) -> Plan:
        return Union(self, right)

    def difference(self, right: Plan) -> Plan:
        return Difference(self, right)


@dataclass(frozen=True)
class Scan(Plan):
    """bindings: a constant for each position, or ANY."""

    relation: str
    bindings: tuple = ()

    def to_df(self, read: Reader) -> DataFrame:
        try:
            df = read(self.relation) if callable(read) else read[self.relation]
        except KeyError:
            raise RelationError("E_RELATION", f"no relation {self.relation}") from None
        return algebra.positional(bound(df, *(self.bindings or [ANY] * len(df.columns))))


@dataclass(frozen=True)
class Input(Plan):
    """A relation value as a plan's input."""

    value: DataFrame

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.positional(self.value)


@dataclass(frozen=True)
class Project(Plan):
    source: Plan
    positions: tuple[int, ...]

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.project_at(self.source.to_df(read), self.positions)


@dataclass(frozen=True)
class JoinEq(Plan):
    left: Plan
    right: Plan
    left_at: tuple[int, ...]
    right_at: tuple[int, ...]

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.join_eq(self.left.to_df(read), self.right.to_df(read), self.left_at, self.right_at)


@dataclass(frozen=True)
class SemiJoin(Plan):
    left: Plan
    right: Plan
    left_at: tuple[int, ...]
    right_at: tuple[int, ...]

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.semi_join(self.left.to_df(read), self.right.to_df(read), self.left_at, self.right_at)


@dataclass(frozen=True)
class AntiJoin(Plan):
    left: Plan
    right: Plan
    left_at: tuple[int, ...]
    right_at: tuple[int, ...]

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.anti_join(self.left.to_df(read), self.right.to_df(read), self.left_at, self.right_at)


@dataclass(frozen=True)
class Union(Plan):
    left: Plan
    right: Plan

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.union_at(self.left.to_df(read), self.right.to_df(read))


@dataclass(frozen=True)
class Difference(Plan):
    left: Plan
    right: Plan

    def to_df(self, read: Reader) -> DataFrame:
        return algebra.difference_at(self.left.to_df(read), self.right.to_df(read))
