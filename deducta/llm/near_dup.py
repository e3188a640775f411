"""Near duplicates by order MinHash, verified by banded alignment.

A text's five-word shingles are labelled by their occurrence, which makes each unique in its text. Every sample takes
the LENGTH smallest labelled shingles under a hash of its own and keeps their order in the text; two texts meet in a
bucket if a sample agrees in shingles and order. Of texts with few shingles shorter samples are taken too.

Two texts that meet are near duplicates if their edit similarity, 1 - d / n, is 0.8 or more: d words are inserted, deleted or
replaced in an alignment, and n is the longer text's number of words. d is exact: bit-parallel alignment in a band as
wide as 0.8 allows, tried narrow first.

Equal texts are one node. In a first round every bucket's texts are verified against its most central text, which joins
a group of copies by a link each. In buckets that still hold several components, the texts outside the bucket's largest
component are compared with all others of the bucket that they are apart from, in blocks of bounded size; texts of the
largest component aren't compared with each other. A task returns links that join something, not pairs.

Defined results: null and empty texts are one group; a text of fewer than five words is one shingle, so such texts are
near duplicates if their words are equal; a class is named by its smallest doc_id, and by null if it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, grams, mix, staged, table, text_or_empty, word_hashes

SHINGLE = 5
#: Samples and shingles of each, for all texts and, besides, for those with up to MOST_SHORT shingles.
LONG, SHORT = (40, 2), (12, 1)
MOST_SHORT = 16
#: A text may have one word in so many edited.
SLACK = 5
BLOCK_TEXTS, BLOCK_WORDS = 1024, 400_000
#: Places of the histograms that a pair's alignment is bounded by.
BINS = 64
#: A round of the components has a task for so many links; few links need no more files.
LINKS_PER_TASK = 250_000

_ODD = mix(np.arange(1, LONG[0] + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the labelled shingles of a text's words, in order."""
    found = grams(words, SHINGLE) if len(words) >= SHINGLE else grams(words, len(words)) if len(words) else mix(np.zeros(1, dtype=np.uint64))
    order = np.argsort(found, kind="stable")
    sorted_ = found[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    if fresh.all():
        return found
    starts = np.maximum.accumulate(np.where(fresh, np.arange(len(found)), 0))
    occurrence = np.empty(len(found), dtype=np.uint64)
    occurrence[order] = (np.arange(len(found)) - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(occurrence == 0, found, mix(found + occurrence * np.uint64(0x9E3779B97F4A7C15)))


def sample(found: np.ndarray, count: int, length: int, kind: int) -> np.ndarray:
    """A key for each sample: its shingles in text order."""
    n = len(found)
    with np.errstate(over="ignore"):
        if n <= length:
            places = np.broadcast_to(np.arange(n), (count, n))
        else:
            places = np.empty((count, length), dtype=np.int64)
            step = max(1, 4_000_000 // n)
            for i in range(0, count, step):
                hashed = found[None] * _ODD[i : min(i + step, count), None]
                places[i : i + step] = _smallest(hashed, length)
            places = np.sort(places, axis=1)
        keys = mix(np.arange(count, dtype=np.uint64) + np.uint64(kind << 32))
        for i in range(places.shape[1]):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + found[places[:, i]])
    return keys.view(np.int64)


def _smallest(hashed: np.ndarray, length: int) -> np.ndarray:
    """Places of the smallest values of each row."""
    n = hashed.shape[1]
    if n < 96:
        return np.argpartition(hashed, length - 1, axis=1)[:, :length]
    rows, columns = np.nonzero(hashed < np.uint64(int(min(0.99, 3.5 * length / n) * 2**64)))
    counts = np.bincount(rows, minlength=len(hashed))
    order = np.lexsort((hashed[rows, columns], rows))
    starts = np.cumsum(counts) - counts
    good = counts >= length
    out = np.empty((len(hashed), length), dtype=np.int64)
    out[good] = columns[order[starts[good][:, None] + np.arange(length)]]
    if not good.all():
        out[~good] = np.argpartition(hashed[~good], length - 1, axis=1)[:, :length]
    return out


def distance(a: list[int], b: list[int], k: int) -> int:
    """Edit distance of two lists, or k + 1 if it is larger, by bit-parallel alignment in a band of 2 k + 1 diagonals (Hyyro 2003). The
    first list is at least as long as the other, and by no more than k."""
    width = 2 * k + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down, cost, start = mask & ~((1 << (width - k - 1)) - 1), 0, k, k + 1 - width
    most, last = k + len(b) - (len(a) - k), len(a) - k  # from there on the last row is followed
    across, low, places = top >> 1, start - width - 1, {}
    for i, x in enumerate(b):
        if start - low > width:  # where each word is, in the next stretch of the band only
            low, places = start, {}
            for j in range(max(low, 0), min(low + 2 * width, len(a))):
                places[a[j]] = places.get(a[j], 0) | 1 << (j - low)
        at = places.get(x, 0) >> (start - low) & mask
        level = (((at & up) + up) ^ up) & mask | at | down
        plus, minus = (down | ~(level | up)) & mask, level & up
        if i < last:
            cost += not level & top
        else:
            cost += bool(plus & across) - bool(minus & across)
            across >>= 1
        if cost > most:
            return k + 1
        level >>= 1
        up, down, start = (minus | ~(level | plus)) & mask, level & plus, start + 1
    return min(cost, k + 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit similarity of two lists of words is 0.8 or more."""
    if len(a) < len(b):
        a, b = b, a
    most = len(a) // SLACK
    if len(a) - len(b) > most:
        return False
    apart = np.flatnonzero(a[: len(b)] != b)
    cut = int(apart[0]) if len(apart) else len(b)
    a, b = a[cut:], b[cut:]
    apart = np.flatnonzero(a[len(a) - len(b) :][::-1] != b[::-1])
    cut = int(apart[0]) if len(apart) else len(b)
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not len(b):
        return len(a) <= most
    words, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(codes[: len(a)], minlength=len(words)) - np.bincount(codes[len(a) :], minlength=len(words))
    least = int(np.maximum(more, 0).sum())  # words that must go, whatever the order
    if least > most:
        return False
    x, y, k = codes[: len(a)].tolist(), codes[len(a) :].tolist(), max(8, 2 * least)
    while k < most:
        if distance(x, y, k) <= k:
            return True
        k *= 4
    return distance(x, y, most) <= most if most else not least and x == y


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """tid binary, first_id, n int (words), keys array<long> (long samples, then short ones, null where not taken): a row for each
    distinct text."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), text_or_empty(f"`{text}`").alias("body")).select(F.unhex(F.md5("body")).alias("tid"), "id", "body")
    schema = f"tid binary, id {rows.schema['id'].dataType.simpleString()}, n int, keys array<bigint>"
    arrow = arrow_schema(schema)

    def run(batches):
        seen, done = {}, set()
        none_short = [None] * SHORT[0]
        for batch in batches:
            bodies, sizes, keys = batch.column("body"), [], []
            for i, tid in enumerate(batch.column("tid").to_pylist()):
                if tid in done:  # a copy needs no second sketch
                    sizes.append(None)
                    keys.append(None)
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(tid)
                words = word_hashes(WORD.findall(bodies[i].as_py()), seen)
                found = shingles(words)
                sizes.append(len(words))
                keys.append(sample(found, *LONG, 0).tolist() + (sample(found, *SHORT, 1).tolist() if len(found) <= MOST_SHORT else none_short))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("id"), pa.array(sizes, type=pa.int32()), pa.array(keys, type=arrow.field("keys").type)], schema=arrow)

    return rows.mapInArrow(run, schema).groupBy("tid").agg(F.min("id").alias("first_id"), F.max("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys"))


def aligned(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of pairs whose texts are near duplicates. lists: tid, words binary."""
    left = lists.select(F.col("tid").alias("a"), F.col("words").alias("x"))
    right = lists.select(F.col("tid").alias("b"), F.col("words").alias("y"))
    schema = "a binary, b binary"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            mask = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=arrow)

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for links (a, b), by large and small stars."""
    edges = staged(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small.coalesce(1 + before[0] // LINKS_PER_TASK), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """tid binary (of a text's bytes), first_id (the smallest key of a document with that text) and class_id: a row for each
    distinct text."""
    nodes = staged(sketch(docs, key, text), "sketches")
    entries = nodes.select("tid", "n", F.explode("keys").alias("bucket")).filter("bucket is not null")
    # staged, so that the join below is a plain one and Spark can split a hot bucket's rows
    crowded = staged(entries.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("n").alias("load")).filter("texts > 1"), "crowded")
    members = staged(entries.join(crowded, "bucket"), "members")

    bodies = docs.select(F.unhex(F.md5(text_or_empty(f"`{text}`"))).alias("tid"), F.col(f"`{key}`").alias("first_id"), text_or_empty(f"`{text}`").alias("body"))
    wanted = members.select("tid").distinct().join(nodes.select("tid", "first_id"), "tid")
    on = (bodies.tid == wanted.tid) & bodies.first_id.eqNullSafe(wanted.first_id)
    schema = "tid binary, words binary"
    arrow = arrow_schema(schema)

    def listed(batches):
        seen: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([word_hashes(WORD.findall(x.as_py()), seen).tobytes() for x in batch.column("body")], type=pa.binary())], schema=arrow)

    lists = staged(bodies.join(wanted, on, "left_semi").select("tid", "body").mapInArrow(listed, schema).dropDuplicates(["tid"]), "words")

    central = members.groupBy("tid").agg(F.sum("texts").alias("central"))
    pivots = members.join(central, "tid").groupBy("bucket").agg(F.max(F.struct("central", "tid")).getField("tid").alias("b"))
    stars = members.select("bucket", F.col("tid").alias("a")).join(pivots, "bucket").filter("a != b").select("a", "b").distinct()
    links = staged(aligned(stars, lists), "stars")

    rest = second_round(members, lists, nodes, components(links))
    found = components(links.union(rest))
    named = nodes.join(found, nodes.tid == found.node, "left").select("tid", "first_id", F.coalesce("component", "tid").alias("component"))
    # staged, so that the join is a plain one and Spark can split the rows of a large component
    named = staged(named, "named")
    classes = staged(named.groupBy("component").agg(F.min("first_id").alias("class_id")), "classes")
    return named.join(classes, "component").select("tid", "first_id", "class_id")


def second_round(members: DataFrame, lists: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Links between texts of a bucket that the first round left in several components."""
    placed = staged(members.join(found, members.tid == found.node, "left").select("bucket", "tid", "texts", "load", F.coalesce("component", "tid").alias("c")), "placed")
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("size"))
    major = sizes.groupBy("bucket").agg(F.max(F.struct("size", "c")).getField("c").alias("major"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "major")
    count = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("load") / BLOCK_WORDS)).cast("long")
    info = nodes.select("tid", "keys").join(lists, "tid")
    loaded = placed.join(major, "bucket").join(info, "tid").withColumn("largest", F.col("c") == F.col("major")).withColumn("block", F.pmod(F.xxhash64("tid"), count))
    blocked = staged(loaded.groupBy("bucket", "largest", "block").agg(F.collect_list(F.struct("tid", "c", "keys", "words")).alias("rows")), "blocks")
    schema = "a binary, b binary"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                left = _unpacked(batch.column("rows")[r].values)
                alone = batch.column("rows2")[r].values is None
                out = compare(batch.column("bucket")[r].as_py(), left, left if alone else _unpacked(batch.column("rows2")[r].values), alone)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type=pa.binary()), pa.array([y for _, y in out], type=pa.binary())], schema=arrow)

    apart = blocked.filter("not largest")  # blocks of what is outside the largest component
    alone = apart.select("bucket", "rows", F.lit(None).cast(blocked.schema["rows"].dataType).alias("rows2")).mapInArrow(run, schema)
    others = blocked.select("bucket", F.col("largest").alias("largest2"), F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    pairs = apart.select("bucket", "block", "rows").join(others, "bucket").filter("largest2 or block < block2")
    return alone.union(pairs.select("bucket", "rows", "rows2").mapInArrow(run, schema))


def _unpacked(rows: pa.StructArray):
    tids, comps = rows.field("tid").to_pylist(), rows.field("c").to_pylist()
    flat = rows.field("keys").flatten()
    width = LONG[0] + SHORT[0]
    words = [np.frombuffer(x, dtype=np.uint64) for x in rows.field("words").to_pylist()]
    bins = np.array([np.bincount((x & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) for x in words], dtype=np.int32).reshape(-1, BINS)
    return tids, comps, flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width), ~np.asarray(flat.is_null()).reshape(-1, width), words, bins


def compare(bucket: int, left, right, same: bool) -> list[tuple[bytes, bytes]]:
    """Links that join components. A pair is compared in the first bucket that it shares."""
    parent: dict[bytes, bytes] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tids, comps, keys, taken, words, bins = left
    tids2, comps2, keys2, taken2, words2, bins2 = right
    size, size2 = np.array([len(x) for x in words]), np.array([len(x) for x in words2])
    number = {c: n for n, c in enumerate(dict.fromkeys([*comps, *comps2]))}
    of2 = np.array([number[c] for c in comps2])
    out = []
    for i in range(len(tids)):
        most = np.maximum(size2, size[i]) // SLACK
        fits = (np.abs(size2 - size[i]) <= most) & (of2 != number[comps[i]])
        if same:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        at = at[np.abs(bins2[at] - bins[i]).sum(axis=1) <= 2 * most[at]]  # an edit moves two words at most
        if not len(at):
            continue
        equal = (keys2[at] == keys[i]) & taken2[at] & taken[i]
        for j in at[keys[i][equal.argmax(axis=1)] == bucket].tolist():
            a, b = root(comps[i]), root(comps2[j])
            if a != b and similar(words[i], words2[j]):
                parent[a] = b
                out.append((tids[i], tids2[j]))
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates: that with the smallest key, the least text by digest if it has several, and
    one of repeated rows."""
    found = near_duplicates(docs, key, text).filter(F.col("first_id").eqNullSafe(F.col("class_id")))
    kept = found.groupBy("class_id").agg(F.min("tid").alias("__tid"))
    rows = docs.withColumn("__tid", F.unhex(F.md5(text_or_empty(f"`{text}`"))))
    on = (rows["__tid"] == kept["__tid"]) & rows[key].eqNullSafe(kept["class_id"])
    return rows.join(kept, on, "left_semi").dropDuplicates(["__tid", key]).drop("__tid")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id", F.unhex(F.md5(text_or_empty())).alias("tid"))
    found = near_duplicates(docs.select("doc_id", "text"))
    return ids.join(found, "tid").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
