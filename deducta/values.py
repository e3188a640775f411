"""The value domain of relations: checks on write, the two equalities, and arithmetic.

Integers are 56-bit signed, floats finite binary32, and there is no NULL. Joins, set operations and constants compare
canonically: kinds never mix, 1 is not 1.0. Guards and comparison expressions compare numbers by value, exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(1 << 55), (1 << 55) - 1
FLOAT_MAX = float.fromhex("0x1.fffffep+127")


class RelationError(Exception):
    """A rule or relation was used against its declaration. code: the language's error code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def fail(code: str, message: str, kind: str) -> Column:
    """An expression that raises when it is evaluated."""
    return F.raise_error(F.lit(f"{code}: {message}")).cast(kind)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FloatType | T.DoubleType)


def kind_of(t: T.DataType) -> str:
    """The kind of a column's values; equal kinds may be joined."""
    if is_integer(t):
        return "int"
    if is_float(t):
        return "float"
    for cls, kind in ((T.BooleanType, "bool"), (T.StringType, "string"), (T.BinaryType, "bytes"), (T.ArrayType, "list"), (T.StructType, "struct")):
        if isinstance(t, cls):
            return kind
    return t.simpleString()  # dates, timestamps and decimals: carried as Spark has them


def same_kinds(left: T.DataType, right: T.DataType, what: str) -> None:
    """Canonical equality never holds across kinds; Spark would coerce them instead."""
    if kind_of(left) != kind_of(right):
        raise RelationError("E_TYPE", f"{what} compares {kind_of(left)} with {kind_of(right)}")


def literal_kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, bytes):
        return "bytes"
    if isinstance(value, str):
        return "string"
    return "list" if isinstance(value, list | tuple) else type(value).__name__


def checked_int(c: Column) -> Column:
    """c as a 56-bit integer; E_ARITH beyond."""
    x = c.cast("long")
    return F.when(x.between(INT_MIN, INT_MAX), x).otherwise(fail("E_ARITH", "integer out of range", "long"))


def checked_float(c: Column) -> Column:
    """c as a finite binary32, -0 as 0; E_ARITH for others."""
    x = c.cast("float")
    return F.when(F.isnan(x) | (F.abs(x) > F.lit(FLOAT_MAX)), fail("E_ARITH", "float out of range", "float")).otherwise(x + F.lit(0.0).cast("float"))


def persistable(df: DataFrame) -> DataFrame:
    """df with its cells checked: no NULL, integers of 56 bits, finite floats. Maps must come as sorted arrays of entries."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            raise RelationError("E_TYPE", f"column {f.name}: a map has no equality; use canonical_map()")
        if isinstance(f.dataType, T.LongType):
            c = F.when(c.between(INT_MIN, INT_MAX), c).otherwise(F.when(c.isNull(), c).otherwise(fail("E_RANGE", f"{f.name}: integer out of range", "long")))
        elif is_float(f.dataType):
            kind = f.dataType.simpleString()
            c = F.when(F.isnan(c) | c.isin(math.inf, -math.inf), fail("E_RANGE", f"{f.name}: float isn't finite", kind)).otherwise(c + F.lit(0.0).cast(kind))
        if f.nullable:
            c = F.when(c.isNull(), fail("E_TYPE", f"{f.name} is null", f.dataType.simpleString())).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def canonical_map(keys: Column, values: Column) -> Column:
    """A map as entries sorted by key, of equal keys the last: it can be joined and deduplicated."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: F.coalesce(F.array_position(F.slice(F.transform(pairs, lambda y: y["k"]), i + 2, F.size(pairs)), x["k"]), F.lit(0)) == 0)
    return F.array_sort(last)


def _exact(op: str, i: Column, f: Column) -> Column:
    """int op float without rounding either. A float beyond the integers decides by its sign."""
    x = f.cast("double")
    whole = F.floor(x)
    rest = x - whole  # in [0, 1)
    inside = (x >= F.lit(float(INT_MIN))) & (x < F.lit(float(INT_MAX + 1)))
    # -1, 0, 1 as i is less than, equal to or greater than f
    order = F.when(~inside, F.when(x > 0, -1).otherwise(1)).otherwise(F.when(i.cast("long") < whole.cast("long"), -1).when(i.cast("long") > whole.cast("long"), 1).when(rest > 0, -1).otherwise(0))
    return {"=": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]


FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def compare(op: str, left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """Numeric comparison: numbers by value, exactly; other kinds by their order, kinds before values."""
    if is_integer(left_type) and is_float(right_type):
        return _exact(op, left, right)
    if is_float(left_type) and is_integer(right_type):
        return _exact(FLIP[op], right, left)
    if kind_of(left_type) != kind_of(right_type):
        order = ("bool", "int", "float", "identity", "symbol", "error_code", "string", "bytes", "list", "map", "range", "struct")
        a, b = (order.index(k) if k in order else len(order) for k in (kind_of(left_type), kind_of(right_type)))
        return F.lit({"=": False, "!=": True, "<": a < b, "<=": a < b, ">": a > b, ">=": a > b}[op])
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def arithmetic(op: str, left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """+ - * %: integers stay integers with a range check, anything with a float is binary32. % takes the dividend's sign."""
    if is_integer(left_type) and is_integer(right_type):
        a, b = left.cast("long"), right.cast("long")
        if op == "*":
            exact = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
            return F.when(exact.between(F.lit(INT_MIN), F.lit(INT_MAX)), exact.cast("long")).otherwise(fail("E_ARITH", "integer out of range", "long"))
        if op == "%":
            return F.when(b == 0, fail("E_DIV", "division by zero", "long")).otherwise(a % F.nullif(b, F.lit(0)))
        return checked_int({"+": a + b, "-": a - b}[op])
    a, b = left.cast("float"), right.cast("float")
    if op == "%":
        return F.when(b == 0, fail("E_DIV", "division by zero", "float")).otherwise(checked_float(a % F.nullif(b, F.lit(0.0).cast("float"))))
    return checked_float({"+": a + b, "-": a - b, "*": a * b}[op])


def divide(left: Column, right: Column) -> Column:
    """Integers over integers: struct(whole long, real float), whole where the division is exact and real where it isn't."""
    a, b = left.cast("long"), right.cast("long")
    safe = F.when(b == 0, fail("E_DIV", "division by zero", "long")).otherwise(b)
    exact = a % safe == 0
    return F.struct(F.when(exact, F.call_function("div", a, safe)).alias("whole"), F.when(~exact, checked_float(a.cast("float") / safe.cast("float"))).alias("real"))


def negate(c: Column, t: T.DataType) -> Column:
    return checked_int(-c.cast("long")) if is_integer(t) else checked_float(-c)
