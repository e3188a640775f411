"""Scalar builtins as Column expressions; a pandas UDF only where a small state machine is needed (words, from_literal)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..values import FLOAT_MAX, INT_MAX, INT_MIN, fail


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def string_len(s) -> Column:
    return F.char_length(_c(s))


def string_chars(s) -> Column:
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def string_slice(s, start, end) -> Column:
    """Characters start .. end, from 0 and without end; E_INDEX outside the text."""
    s, a, b = _c(s), F.lit(start) if isinstance(start, int) else start, F.lit(end) if isinstance(end, int) else end
    return F.when((a < 0) | (b < a) | (b > F.char_length(s)), fail("E_INDEX", "slice out of range", "string")).otherwise(F.substring(s, a + 1, b - a))


def string_from_chars(chars) -> Column:
    c = _c(chars)
    return F.when(F.exists(c, lambda x: F.char_length(x) != 1), fail("E_TYPE", "not single characters", "string")).otherwise(F.array_join(c, ""))


def string_concat(*parts) -> Column:
    return F.concat(*map(_c, parts))


def string_join(parts, separator: str) -> Column:
    return F.array_join(_c(parts), separator)


def string_starts_with(s, prefix) -> Column:
    return _c(s).startswith(prefix)


def string_contains(s, part) -> Column:
    return _c(s).contains(part)


def string_equal_fold(a, b) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


def lower(s) -> Column:
    return F.lower(_c(s))


def split_words(text: str) -> list[str]:
    """Words parted by white space; double quotes keep it, a backslash takes the next character as it is."""
    out, word, quoted = [], "", False
    chars = iter(text)
    for ch in chars:
        if ch == "\\":
            word += next(chars, "\\")
        elif ch == '"':
            quoted = not quoted
        elif ch.isspace() and not quoted:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word] if word else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else split_words(x))


def words(s) -> Column:
    """Without quotes and backslashes a split does; only other texts go to Python."""
    s = _c(s)
    plain = F.filter(F.split(F.regexp_replace(s, r"(?U)\s+", " "), " "), lambda x: x != "")
    return F.when(s.contains('"') | s.contains("\\"), _words(s)).otherwise(plain)


def edit_distance(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


#: Ordinal words.
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17,
    "eighteenth": 18, "nineteenth": 19, "twenty": 20, "twentieth": 20, "thirty": 30, "thirtieth": 30, "forty": 40, "fortieth": 40,
    "fifty": 50, "fiftieth": 50, "sixty": 60, "sixtieth": 60, "seventy": 70, "seventieth": 70, "eighty": 80, "eightieth": 80,
    "ninety": 90, "ninetieth": 90,
}


def parse_ordinal(s) -> Column:
    """"3rd", "21." and "twenty-first" as a positive integer; null where the text is none."""
    text = F.lower(F.trim(_c(s)))
    digits = F.regexp_extract(text, r"^\+?0*([0-9]{1,18})(?:st|nd|rd|th|\.)?$", 1)
    table = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    values = F.transform(F.split(text, "-"), lambda w: F.try_element_at(table, w))
    named = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.when(digits != "", F.nullif(digits.cast("long"), F.lit(0).cast("long"))).when(text != "", named.cast("long"))


def url_encode_component(s) -> Column:
    """RFC 3986: all but letters, digits and -_.~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(_c(s)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode_component(s) -> Column:
    """Undoes url_encode_component; + is a blank. E_TYPE for escapes that aren't whole, or bytes that aren't UTF-8."""
    s = _c(s)
    bad = F.lit("E_TYPE: not an encoded component")
    escaped = F.regexp_extract_all(F.lower(s), F.lit("((?:%[0-9a-f]{2})+)"), 1)
    whole = ~F.regexp_replace(s, "%[0-9A-Fa-f]{2}", "").contains("%") & ~F.exists(escaped, lambda x: ~F.is_valid_utf8(F.unhex(F.replace(x, F.lit("%"), F.lit(""))).cast("string")))
    return F.when(whole, F.url_decode(s)).when(s.isNotNull(), F.raise_error(bad))


def sort(values) -> Column:
    return F.array_sort(_c(values))


def to_symbol(s) -> Column:
    s = _c(s)
    return F.when(s == "", fail("E_TYPE", "an empty symbol", "string")).otherwise(s)


def to_literal(c) -> Column:
    """A value as the text of a literal, by its type."""
    return F.to_json(F.array(_c(c))).substr(F.lit(2), F.char_length(F.to_json(F.array(_c(c)))) - 2)


@F.pandas_udf(T.BooleanType())
def _one_json(s: pd.Series) -> pd.Series:
    def ok(x):
        try:
            json.loads(x)
        except (ValueError, RecursionError):
            return False
        return True

    return s.map(lambda x: x is not None and ok(x))


def from_literal(s, kind: str) -> Column:
    """A literal's value as a kind: a Spark type, arrays and maps of text among them; "symbol" for a colon and a name; "identity" for # and a
    number. E_TYPE for other text, and for text with more than one value. Literals of numbers and words need no Python."""
    s = _c(s)
    if kind == "symbol":
        name = F.regexp_extract(s, r"\A\s*:([A-Za-z_][A-Za-z0-9_]*)\s*\z", 1)
        return F.when(name != "", name).when(s.isNotNull(), fail("E_TYPE", "not a symbol", "string"))
    if kind == "identity":
        number = F.regexp_extract(s, r"\A\s*#([0-9]{1,17})\s*\z", 1)
        return F.when(number != "", number.cast("long")).when(s.isNotNull(), fail("E_TYPE", "not an identity", "long"))
    found = F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), f"struct<v:{kind}>", {"mode": "PERMISSIVE"}).getField("v")
    plain = s.rlike(r"\A\s*(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false)\s*\z")
    good = found.isNotNull() & F.when(plain, True).otherwise(_one_json(s))
    return F.when(good, found).otherwise(fail("E_TYPE", "not a literal of this kind", kind))


def map_pairs(m) -> Column:
    return F.map_entries(_c(m))


def index(values, at) -> Column:
    """values[at] of a list, from 0; E_INDEX where there is none."""
    return F.coalesce(F.get(_c(values), at if isinstance(at, Column) else F.lit(at)), F.raise_error(F.lit("E_INDEX: no such index")))


def index_or(values, at, default) -> Column:
    """values[at] of a list, or default."""
    return F.coalesce(F.get(_c(values), at if isinstance(at, Column) else F.lit(at)), default if isinstance(default, Column) else F.lit(default))


def map_get(m, key) -> Column:
    return F.coalesce(F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key)), F.raise_error(F.lit("E_INDEX: no such key")))


def map_get_or(m, key, default) -> Column:
    return F.coalesce(F.try_element_at(_c(m), key if isinstance(key, Column) else F.lit(key)), default if isinstance(default, Column) else F.lit(default))


def list_slice(values, first: int, last: int | None = None) -> Column:
    """values[first..last], both included, from 0, or to the end; E_INDEX outside and for positions below 0 or out of order."""
    v = _c(values)
    if first < 0 or last is not None and last < first:
        return F.when(v.isNull(), v).otherwise(F.raise_error(F.lit("E_INDEX: no such range")).cast("void"))
    end = F.size(v) if last is None else F.lit(last + 1)
    return F.when((end > F.size(v)) | (F.size(v) < first), F.raise_error(F.lit("E_INDEX: range out of the list"))).otherwise(F.slice(v, F.lit(first + 1), F.greatest(end - first, F.lit(0))))


def list_set(values, at: int, value) -> Column:
    x = value if isinstance(value, Column) else F.lit(value)
    v = _c(values)
    return F.when(F.lit(at < 0) | (F.size(v) <= at), F.raise_error(F.lit("E_INDEX: no such index"))).otherwise(F.transform(v, lambda y, i: F.when(i == at, x).otherwise(y)))


def truthy(c, t: T.DataType) -> Column:
    """Truth of a value: of a boolean its own, of a list or a set of rows whether there is anything in it; all else is true, 0 and the
    empty string too."""
    c = _c(c)
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.size(c) > 0 if isinstance(t, T.ArrayType) else F.lit(True)


def map_set(m, key, value) -> Column:
    k, x = key if isinstance(key, Column) else F.lit(key), value if isinstance(value, Column) else F.lit(value)
    return F.map_concat(F.map_filter(_c(m), lambda a, _: a != k), F.create_map(k, x))


def json_encode(c) -> Column:
    return F.to_json(_c(c), {"ignoreNullFields": "false"})


def json_decode(s, schema: str) -> Column:
    """A JSON text as a schema; E_JSON for text that isn't JSON."""
    s = _c(s)
    return F.when(json_valid(s), F.from_json(s, schema)).otherwise(F.raise_error(F.lit("E_JSON: not JSON")))


@F.pandas_udf(T.BooleanType())
def _json_valid(s: pd.Series) -> pd.Series:
    def ok(x):
        def whole(t):
            if not INT_MIN <= int(t) <= INT_MAX:
                raise ValueError
        def real(t):
            if not abs(float(t)) <= FLOAT_MAX:
                raise ValueError
        def never(_):
            raise ValueError
        try:
            json.loads(x, parse_int=whole, parse_float=real, parse_constant=never)
        except (ValueError, RecursionError):
            return False
        return True

    return s.map(lambda x: x is not None and ok(x))


def json_valid(s) -> Column:
    """Whether a text is one JSON value with integers of 56 bits and finite binary32 numbers."""
    return _json_valid(_c(s))


def json_is_null(s, path: str = "$") -> Column:
    """Whether a path of a JSON text holds null or nothing."""
    return F.get_json_object(_c(s), path).isNull()


#: Buckets of the deterministic text embedding.
EMBEDDING_SIZE = 8


def embed_text(s) -> Column:
    """Eight buckets; each character adds one to bucket (code point + place) mod 8; scaled to length 1."""
    digits = F.array_join(F.transform(string_chars(s), lambda x, i: F.pmod(F.ascii(x) + i, F.lit(EMBEDDING_SIZE)).cast("string")), "")
    of = lambda d, b: (F.char_length(d) - F.char_length(F.replace(d, F.lit(str(b)), F.lit("")))).cast("double")
    counts = F.element_at(F.transform(F.array(digits), lambda d: F.array(*[of(d, b) for b in range(EMBEDDING_SIZE)])), 1)  # the digits are made once
    scaled = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1.0)))
    return F.element_at(F.transform(F.array(counts), scaled), 1)  # counts are 0, or their length is 1 at least


def frob(delegate, payload) -> Column:
    return F.struct(_c(delegate).alias("delegate"), _c(payload).alias("payload"))


def frob_delegate(f) -> Column:
    return _c(f).getField("delegate")


def frob_value(f) -> Column:
    return _c(f).getField("payload")


def is_frob(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == ["delegate", "payload"]
