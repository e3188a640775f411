"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits. Every run of LEAST tokens of a benchmark item is a seed; documents
are joined with the seeds by hash, and an item that shares enough of them with a document is tiled over it: running
Karp-Rabin finds the common runs, the longest that is still free is marked in both again and again and never used
twice, down to LEAST tokens; what a tile leaves of another match stands in line again. The share of an item's tokens
under tiles is its coverage; since tiles may lie in any order, reordered passages are found too.

The benchmark's distinct texts are sent to the tasks in blocks of bounded size, one pass over the documents for each
block; the ids of an item's copies are joined to what was found.

Defined results: null and empty texts match nothing; an item of fewer than LEAST tokens is one seed; repeated items
and documents are judged each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, grams, key_schema, table, text_or_empty, word_hashes

LEAST, COVERAGE = 5, 0.6
#: Characters of benchmark items that are sent at once; one item may be longer.
BLOCK_CHARS = 4_000_000
_TOKEN = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _windows(x: list[int], free: list[bool], size: int):
    """Start and Karp-Rabin hash of each run of free values of a size, rolled on from the one before."""
    lead = pow(_BASE, size - 1, _MOD)
    h = run = 0
    for i, v in enumerate(x):
        if not free[i]:
            h = run = 0
            continue
        if run == size:
            h -= x[i - size] % _MOD * lead
            run -= 1
        h = (h * _BASE + v) % _MOD
        run += 1
        if run == size:
            yield i - size + 1, h


def common_runs(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in pattern, place in text) of at least a length. Only pairs of places whose preceding values
    differ begin one, so repeated values make as many runs as places, not as pairs of places."""
    places: dict = defaultdict(lambda: (defaultdict(list), defaultdict(list)))
    for side, x in enumerate((pattern, text)):
        for i, h in _windows(x, [v >= 0 for v in x], least):
            before = x[i - 1] if i else -1
            places[h][side][before if before >= 0 else ~side - 1].append(i)  # nothing before, on neither side, is equal to nothing
    ps, ts = [], []
    for by_p, by_t in places.values():
        for before, own in by_p.items():
            others = np.array([j for b, js in by_t.items() if b != before for j in js], dtype=np.int64)
            if len(others):
                ps.append(np.repeat(np.array(own, dtype=np.int64), len(others)))
                ts.append(np.tile(others, len(own)))
    if not ps:
        return []
    p, t = np.concatenate(ps), np.concatenate(ts)
    # how far each pair goes on: numbers of all runs of 1, 2, 4 ... values are compared, the longest first
    z = np.array([*pattern, -1, *text, -1], dtype=np.int64)
    z = np.where(z < 0, ~np.arange(len(z)), z)  # these match nothing
    levels = [np.unique(z, return_inverse=True)[1]]
    for k in range(len(pattern).bit_length() - 1):
        after = np.zeros(len(z), dtype=np.int64)
        after[: -(1 << k)] = levels[-1][1 << k :]
        levels.append(np.unique(levels[-1] * len(z) + after, return_inverse=True)[1])
    at, n = t + len(pattern) + 1, np.zeros(len(p), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][np.minimum(p + n, len(pattern))] == levels[k][np.minimum(at + n, len(z) - 1)]).astype(np.int64) << k
    good = n >= least
    return list(zip(n[good].tolist(), p[good].tolist(), t[good].tolist(), strict=True))


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (place in pattern, place in text, length) of at least a length. Negative values match nothing."""
    free_p, free_t = np.array([v >= 0 for v in pattern], dtype=bool), np.array([v >= 0 for v in text], dtype=bool)
    out: list[tuple[int, int, int]] = []
    queue = [(-n, p, t) for n, p, t in common_runs(pattern, text, least)]
    heapify(queue)
    left = int(free_p.sum())
    while queue and left >= least:
        n, p, t = heappop(queue)
        n = -n
        free = free_p[p : p + n] & free_t[t : t + n]
        if free.all():
            free_p[p : p + n], free_t[t : t + n] = False, False
            left -= n
            out.append((p, t, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # what longer tiles left of it
            if b - a >= least:
                heappush(queue, (a - b, p + a, t + a))
    return out


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in runs of a size."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return np.cumsum(marks[:n]) > 0


@dataclass
class Benchmark:
    """A block of items: their token hashes, and by seed length the sorted seeds and the items that hold each."""

    ids: list
    items: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list, texts: list[str], least: int) -> Benchmark:
        seen: dict = {}
        out = cls(ids, [word_hashes(tokens(t), seen) for t in texts])
        by_length = defaultdict(list)
        for n, item in enumerate(out.items):
            if len(item):
                size = min(least, len(item))
                found = grams(item, size)
                by_length[size].append((found, np.full(len(found), n), np.arange(len(found))))
        for size, parts in by_length.items():
            h, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            keys, starts = np.unique(h[order], return_index=True)
            out.seeds[size] = keys, np.append(starts, len(h)), n[order], p[order]
        return out

    def matches(self, hashes: np.ndarray, coverage: float) -> list[tuple[int, float, int]]:
        """Items that a document covers enough of: index, coverage, number of tiles."""
        out = []
        for size, (keys, starts, items, places) in self.seeds.items():
            found = grams(hashes, size)
            if not len(found):
                continue
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == found)
            if not len(hits):
                continue
            seen, which = np.unique(at[hits], return_inverse=True)
            count = starts[seen + 1] - starts[seen]
            entry = np.repeat(starts[seen] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            of_seed = np.repeat(np.arange(len(seen)), count)
            order = np.argsort(items[entry], kind="stable")
            numbers, cuts = np.unique(items[entry][order], return_index=True)
            for n, own in zip(numbers.tolist(), np.split(order, cuts[1:]), strict=True):
                item = self.items[n]
                if _covered(places[entry[own]], size, len(item)).sum() < coverage * len(item):
                    continue
                wanted = np.zeros(len(seen), dtype=bool)
                wanted[of_seed[own]] = True
                used = _covered(hits[wanted[which]], size, len(hashes))
                codes = {h: c for c, h in enumerate(dict.fromkeys(item.tolist()))}
                text, last = [], -2
                for i in np.flatnonzero(used).tolist():  # the document's shared runs, kept apart
                    if i != last + 1:
                        text.append(-1)
                    text.append(codes.get(int(hashes[i]), -1))
                    last = i
                found_tiles = tiles([codes[h] for h in item.tolist()], text, size)
                share = sum(x[2] for x in found_tiles) / len(item)
                if share >= coverage:
                    out.append((n, share, len(found_tiles)))
        return sorted(out)


def _distinct(benchmark: DataFrame, text: str) -> DataFrame:
    return benchmark.select(text_or_empty(f"`{text}`").alias("body")).distinct().select(F.unhex(F.md5("body")).alias("tid"), "body")


def _blocks(benchmark: DataFrame, text: str, least: int):
    """Blocks of the distinct texts, in turn; the driver holds one, and a partition of the texts."""
    ids, bodies, size = [], [], 0
    for r in _distinct(benchmark, text).toLocalIterator():
        if ids and size + len(r["body"]) > BLOCK_CHARS:
            yield Benchmark.of(ids, bodies, least)
            ids, bodies, size = [], [], 0
        ids.append(bytes(r["tid"]))
        bodies.append(r["body"])
        size += len(r["body"])
    if ids:
        yield Benchmark.of(ids, bodies, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """key, item_id, coverage double, tiles int: a row for each document and item that it covers enough of."""
    schema = T.StructType([*key_schema(docs, [key]), *T._parse_datatype_string("__tid binary, coverage double, tiles int").fields])
    arrow = arrow_schema(schema)
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`"), text_or_empty(f"`{text}`").alias("__body"))
    parts = []
    for block in _blocks(benchmark, item_text, least):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            own, seen = shipped.value, {}
            for batch in batches:
                bodies, out = batch.column("__body"), []
                for i in range(batch.num_rows):
                    found = own.matches(word_hashes(tokens(bodies[i].as_py()), seen), coverage)
                    if found:
                        doc = batch.column(key)[i].as_py()
                        out += [(doc, own.ids[n], share, count) for n, share, count in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        parts.append(source.mapInArrow(run, schema))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    named = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.unhex(F.md5(text_or_empty(f"`{item_text}`"))).alias("__tid"))
    return found.join(named, "__tid").select(found[key], "item_id", "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that cover no item enough."""
    arrow = arrow_schema(docs.schema)
    out = docs
    for block in _blocks(benchmark, item_text, least):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            own, seen = shipped.value, {}
            for batch in batches:
                bodies = batch.column(text)
                keep = pa.array([not own.matches(word_hashes(tokens(bodies[i].as_py() or ""), seen), coverage) for i in range(batch.num_rows)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], schema=arrow)

        out = out.mapInArrow(run, docs.schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
