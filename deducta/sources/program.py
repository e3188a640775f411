"""Programs as text: relations and rules, read and written.

    relation Edge(from long, to long)
    relation Label(id long, name string) key 0
    relation Seen(id long) event_append volatile
    Reach(x, y) :- Edge(x, y)
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from ..values import RelationError

if TYPE_CHECKING:
    from .catalog import Catalog

_RELATION = re.compile(r"relation\s+(\w+)\s*\((.*)\)\s*((?:key\s+\d+(?:\s*,\s*\d+)*|index\s+\d+(?:\s*,\s*\d+)*|volatile|event_append|\s)*)$")


def load_text(catalog: Catalog, text: str) -> list[int]:
    """Declares a text's relations and installs its rules; returns the rules' numbers."""
    rules = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare.startswith("relation "):
            rules.append(line)
            continue
        m = _RELATION.match(bare)
        if not m:
            raise RelationError("E_SYNTAX", f"not a declaration: {bare}")
        name, schema, more = m.groups()
        numbers = lambda s: tuple(map(int, s.split(",")))
        key = numbers(k[1]) if (k := re.search(r"key\s+([\d\s,]+)", more)) else ()
        catalog.make_relation(name, schema, key=key, policy="functional" if key else "event_append" if "event_append" in more else "set", durability="volatile" if "volatile" in more else "durable", indexes=tuple(numbers(i) for i in re.findall(r"index\s+([\d\s,]+)", more)))
    return catalog.install("\n".join(rules))


def program_text(catalog: Catalog) -> str:
    """A text that declares a catalogue's relations and its active rules."""
    from ..plans.rules import show

    out = []
    for r in catalog.relations.values():
        more = [f"key {', '.join(map(str, r.key))}"] if r.key else ["event_append"] if r.policy == "event_append" else []
        more += [f"index {', '.join(map(str, i))}" for i in r.indexes] + ["volatile"] * (r.durability == "volatile")
        out.append(" ".join([f"relation {r.name}({r.schema})", *more]))
    return "\n".join([*out, *map(show, catalog.active())]) + "\n"


def file_in(spark: SparkSession, catalog: Catalog, path: str) -> list[int]:
    return load_text(catalog, "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def file_out(spark: SparkSession, catalog: Catalog, path: str) -> None:
    spark.createDataFrame([(program_text(catalog).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
