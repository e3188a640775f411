"""Substring dedup: suffix automata of reference shards, streamed for matching statistics.

A window is WINDOW consecutive words of one document. It is a repeat if its words also start in a document with a
smaller id. Two cheap passes narrow down where repeats can be:

* Anchors: of the runs of ANCHOR words inside each window the one with the least hash. Two equal windows have the same
  anchor, so only windows around anchors that two different texts hold can be repeats. One place in thirteen is one.
* Windows around those anchors are hashed; of each hash the smallest document is the window's reference.

Reference passages, consecutive windows of their reference, are dealt into shards of about SHARD_WINDOWS windows, and the
other documents' runs of windows go to the shards of their references. There they are streamed through the suffix
automaton of the shard; a place where the matching statistic reaches WINDOW ends a repeat, and the maximal spans are
removed. A shard with many runs is split: each part has RUN_WORDS words or so to stream and an automaton of its own,
so a passage in very many documents is sent once a part. Equal texts are judged once: a copy of a text with a smaller
id is a repeat from end to end.

Defined results: a null text has no words; a row with a null id is kept whole and is no reference; rows with one id
are one document, whatever their texts; ties and repeated rows are judged alike; other columns stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, grams, staged, table, text_or_empty, word_hashes

WINDOW, ANCHOR = 50, 25
#: Windows of a shard's reference passages, and words that are streamed through one automaton.
SHARD_WINDOWS, RUN_WORDS = 50_000, 400_000


class SuffixAutomaton:
    """Of a list of hashable tokens; None parts passages, so that no match runs over its place."""

    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for token in tokens:
            if token is None:
                last = 0
                continue
            last = self._add(last, token)

    def _new(self, nexts: dict, link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token) -> int:
        """A state for the strings of q that end a step after p."""
        clone = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, token) -> int:
        q = self.next[last].get(token)
        if q is not None:  # after a parting the string may be there already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        state, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return state

    def statistics(self, tokens):
        """For each place the length of the longest string that ends there and is in the automaton."""
        state = size = 0
        nexts, link, length = self.next, self.link, self.length
        for token in tokens:
            while state and token not in nexts[state]:
                state = link[state]
                size = length[state]
            got = nexts[state].get(token)
            if got is None:
                state = size = 0
            else:
                state, size = got, size + 1
            yield size


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the anchors of a text."""
    if len(hashes) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    short = grams(hashes, ANCHOR)
    wide = np.lib.stride_tricks.sliding_window_view(short, WINDOW - ANCHOR + 1)
    return np.unique(short[np.unique(wide.argmin(axis=1) + np.arange(len(wide)))])


def windows_at(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold one of the wanted anchors."""
    short = grams(hashes, ANCHOR)
    at = np.flatnonzero(np.isin(short, wanted))
    n = len(hashes) - WINDOW + 1
    if n <= 0 or not len(at):
        return np.empty(0, dtype=np.int64)
    marks = np.zeros(len(hashes) + 2, dtype=np.int64)
    np.add.at(marks, np.maximum(0, at - (WINDOW - ANCHOR)), 1)
    np.add.at(marks, at + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[:n] > 0)


def merged(starts: np.ndarray, width: int, gap: int | None = None) -> list[tuple[int, int]]:
    """Half-open spans that windows of a width cover, as few as can be; with a gap, of windows whose starts are no further apart."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > (width if gap is None else gap)) + 1
    return [(int(x[0]), int(x[-1]) + width) for x in np.split(starts, cut)]


def kept_words(words: list[str], starts: list[int], ends: list[int]) -> list[str]:
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out += words[at:a]
        at = b
    return out + words[at:]


def _id(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, tid binary (a text's digest), t long (a part of it), body."""
    return docs.select(F.col(f"`{key}`").alias("id"), text_or_empty(f"`{text}`").alias("body")).withColumn("tid", F.unhex(F.md5("body"))).withColumn("t", F.conv(F.substring(F.md5("body"), 1, 15), 16, 10).cast("long"))


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tid, t, n_words int, whole_sha256 string and anchors array<long>, which only one of a partition's copies has: a row for each document."""
    schema = f"id {_id(docs, key)}, tid binary, t bigint, n_words int, whole_sha256 string, anchors array<bigint>"
    arrow = arrow_schema(schema)

    def run(batches):
        seen, done = {}, {}
        for batch in batches:
            bodies, out = batch.column("body"), []
            for i, tid in enumerate(batch.column("tid").to_pylist()):
                old = done.get(tid)
                if old is None:
                    words = WORD.findall(bodies[i].as_py())
                    if len(done) > 200_000:
                        done.clear()
                    old = done[tid] = (len(words), hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
                    out.append((*old, anchors(word_hashes(words, seen)).view(np.int64).tolist()))
                else:
                    out.append((*old, None))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "tid", "t")), *(pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[3:], strict=True))], schema=arrow)

    return _keyed(docs, key, text).mapInArrow(run, schema)


def repeats(docs: DataFrame, profiled: DataFrame, firsts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Spans of repeated words: id, tid, starts array<int>, ends array<int> (in words, apart, in order), a row for each text that holds
    some and isn't a copy; and the texts that were looked at: id, tid, body. firsts: tid, first_id."""
    id_type = _id(docs, key)
    held = profiled.select("t", F.explode("anchors").alias("h"))
    # staged, so that the joins below are plain ones and Spark can split a hot key's rows
    shared = staged(held.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("h"), "shared-anchors")
    lists = held.join(shared, "h").groupBy("t").agg(F.collect_set("h").alias("hs"))  # no more than a text's anchors
    wanted = firsts.withColumn("t", F.conv(F.substring(F.lower(F.hex("tid")), 1, 15), 16, 10).cast("long")).join(lists, "t").select("tid", F.col("first_id").alias("id"), "hs")
    near = staged(_keyed(docs, key, text).drop("t").filter("id is not null").join(wanted, ["tid", "id"]).dropDuplicates(["tid", "id"]), "near-repeats")

    def dense(batches):
        seen: dict = {}
        for batch in batches:
            bodies, sets = batch.column("body"), batch.column("hs")
            for i in range(batch.num_rows):
                hashes = word_hashes(WORD.findall(bodies[i].as_py()), seen)
                at = windows_at(hashes, sets[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                if len(at):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.full(n, i))), batch.column("tid").take(pa.array(np.full(n, i))), pa.array(grams(hashes, WINDOW)[at].view(np.int64)), pa.array(at.astype(np.int32))], schema=windows_arrow)

    windows_schema = f"id {id_type}, tid binary, w bigint, p int"
    windows_arrow = arrow_schema(windows_schema)
    windows = staged(near.select("id", "tid", "body", "hs").mapInArrow(dense, windows_schema), "windows")
    several = staged(windows.groupBy("w").agg(F.min("id").alias("ref"), F.max("id").alias("last")).filter("ref < last").select("w", "ref"), "shared-windows")

    def by_text(shards: int) -> DataFrame:
        entry = F.struct("p", "ref", F.pmod(F.xxhash64("ref"), F.lit(shards)).alias("shard"))
        return windows.join(several, "w").groupBy("id", "tid").agg(F.sort_array(F.collect_list(entry)).alias("at"))  # no more than a text's words


    shards = -(-several.count() // SHARD_WINDOWS) or 1

    def passages(batches):
        for batch in batches:
            bodies, lists_ = batch.column("body"), batch.column("at")
            for i in range(batch.num_rows):
                own, tid, words = batch.column("id")[i].as_py(), batch.column("tid")[i].as_py(), WORD.findall(bodies[i].as_py())
                found: dict = {}
                for x in lists_[i].as_py():
                    found.setdefault((x["shard"], x["ref"] == own), []).append(x["p"])
                # only consecutive windows, so that each window of a passage has its reference there
                rows = [(shard, mine, tid, own, a, b - a, " ".join(words[a:b])) for (shard, mine), at in found.items() for a, b in merged(np.array(at, dtype=np.int64), WINDOW, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), passages_arrow, strict=True)], schema=passages_arrow)

    passages_schema = f"shard bigint, mine boolean, tid binary, id {id_type}, p int, n int, words string"
    passages_arrow = arrow_schema(passages_schema)
    cut = staged(near.join(by_text(shards), ["id", "tid"]).select("id", "tid", "body", "at").mapInArrow(passages, passages_schema), "passages")
    parts = cut.filter("not mine").groupBy("shard").agg(F.ceil(F.sum("n") / RUN_WORDS).cast("int").alias("parts"))
    references = cut.filter("mine").join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "words").toDF("to_shard", "to_part", "words")
    runs = cut.filter("not mine").join(parts, "shard").select("shard", F.pmod(F.xxhash64("id", "tid", "p"), "parts").cast("int").alias("part"), "id", "tid", "p", "words").toDF("shard", "part", "id", "tid", "p", "words")

    def stream(runs: pa.Table, references: pa.Table) -> pa.Table:
        tokens: list = []
        for passage in references.column("words").to_pylist():
            tokens += [*passage.split(" "), None]
        automaton, out = SuffixAutomaton(tokens), []
        for tid, own, p, words in zip(*(runs.column(c).to_pylist() for c in ("tid", "id", "p", "words")), strict=True):
            ends = np.array([e for e, n in enumerate(automaton.statistics(words.split(" ")), 1) if n >= WINDOW], dtype=np.int64)
            out += [(own, tid, p + a, p + b) for a, b in merged(ends - WINDOW, WINDOW)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), spans_arrow, strict=True)], schema=spans_arrow) if out else spans_arrow.empty_table()

    spans_schema = f"id {id_type}, tid binary, a int, b int"
    spans_arrow = arrow_schema(spans_schema)
    spans = runs.groupBy("shard", "part").cogroup(references.groupBy("to_shard", "to_part")).applyInArrow(stream, spans_schema)
    gathered = spans.groupBy("id", "tid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))  # no more than a text's words
    # overlapping spans become one
    joined = F.aggregate("s", F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))))
    found = gathered.select("id", "tid", joined.alias("s")).select("id", "tid", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))
    return staged(found, "spans"), near.select("id", "tid", "body")


def _prepared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    profiled = staged(profile(docs, key, text), "profiles")
    # staged, so that joins with it are plain ones and Spark can split the rows of a text with very many copies
    firsts = staged(profiled.groupBy("tid").agg(F.min("id").alias("first_id")), "firsts")
    return profiled, firsts, *repeats(docs, profiled, firsts, key, text)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each text without its repeated words (the kept ones joined by one space; a text with none is left as it was), and
    n_words, n_removed long."""
    profiled, firsts, spans, _ = _prepared(docs, key, text)
    base = docs.drop("n_words", "n_removed")
    tid = F.unhex(F.md5(text_or_empty(f"`{text}`")))
    known = profiled.groupBy("tid").agg(F.max("n_words").alias("__n")).join(firsts, "tid").withColumnsRenamed({"tid": "__tid", "first_id": "__first"})
    spans = spans.select(F.col("id").alias("__id"), F.col("tid").alias("__tid2"), "starts", "ends")
    rows = base.withColumn("__tid", tid).join(known, "__tid").join(spans, (F.col(f"`{key}`") == F.col("__id")) & (F.col("__tid") == F.col("__tid2")), "left")
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    copy = (F.col(f"`{key}`") > F.col("__first")) & (F.col("__n") >= WINDOW)
    # kept pieces lie between the spans
    befores, afters = F.concat(F.array(F.lit(0)), F.col("ends")), F.concat(F.col("starts"), F.array(F.col("__n")))
    pieces = F.flatten(F.transform(F.arrays_zip(befores.alias("a"), afters.alias("b")), lambda x: F.slice(words, x["a"] + 1, x["b"] - x["a"])))
    removed = F.when(copy, F.col("__n")).otherwise(F.coalesce(F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0), lambda x, y: x + y), F.lit(0))).cast("long")
    kept = F.when(copy, F.lit("")).when(F.col("starts").isNotNull(), F.array_join(pieces, " ")).otherwise(F.col(f"`{text}`"))
    return rows.select(*(kept.alias(c) if c == text else F.col(f"`{c}`") for c in base.columns), F.col("__n").cast("long").alias("n_words"), removed.alias("n_removed"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    profiled, firsts, spans, near = _prepared(docs, "doc_id", "text")
    schema = f"id {_id(docs, 'doc_id')}, tid binary, removed bigint, sha string"
    arrow = arrow_schema(schema)

    def digest(batches):
        for batch in batches:
            out = []
            for body, a, b in zip(*(batch.column(c).to_pylist() for c in ("body", "starts", "ends")), strict=True):
                out.append((sum(b) - sum(a), hashlib.sha256(" ".join(kept_words(WORD.findall(body), a, b)).encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), *(pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[2:], strict=True))], schema=arrow)

    cut = near.join(spans, ["id", "tid"]).select("id", "tid", "body", "starts", "ends").mapInArrow(digest, schema)
    rows = profiled.select("id", "tid", "n_words", "whole_sha256").join(firsts, "tid").join(cut, ["id", "tid"], "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
    )


#: Every window of every document, by the contract's definition; rows with null ids have no window that counts.
ORACLE = r"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select r, doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as k from (select r, doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w)
), dup as (
  select r, p from win join (select k, min(doc_id) as m from win group by k) using (k) where doc_id > m
), gone as (
  select distinct r, p + i as q from dup, range(50) t(i)
), kept as (
  select r, string_agg(x, ' ' order by q) as body from (select r, unnest(ws) as x, generate_subscripts(ws, 1) as q from w) anti join gone using (r, q) group by r
), lost as (select r, count(*) as n from gone group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256
from w left join kept using (r) left join lost using (r)
"""
