"""LM scoring by a hierarchical Pitman-Yor model of words.

Restaurants: one for each context, which is the whole preceding word (known by a 48-bit number: its last byte and 40 bits
of its hash; two of a thousand million words share one at odds of one in 30,000); one for each last byte of contexts, their shared parent; one root, of words without context; a uniform base
over the V words seen and one for all others. Contexts grow with the vocabulary: what a word's seating needs besides the
word's own counts are the totals of its contexts, which lie in tables dealt by context.

* Blocks of documents number their distinct words, and send each with its contexts and training counts to the bucket
  of the word. A bucket merges them: a word in every document is one entry per block, so no key is hot.
* After a round each bucket sends its tables of every context to the bucket of the context, which adds up and answers
  with the totals. Which contexts these are, and their customers, is written once, by the context's bucket. Only the
  totals of the parents and the root are sent to all.
* Seating is sampled by blocked Gibbs: all customers of a dish in a restaurant are seated anew, one after another,
  given the tables elsewhere; past the first 128, in steps of 1/32 of those seated (a binomial draw each), which is an
  approximation. A table is a customer of the parent. Totals of restaurants are those of the round before.
* Predictive probabilities are averaged over SAMPLES seatings, each with its own exact totals, so that they sum to
  one over all words; they go back to the blocks, which add up their documents.

Defined results: a null text is its end token alone; a null id counts as an empty one (training); with nothing to
learn from every probability is 1; repeated rows are scored each, and learned from each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, arrow_schema, buckets_for, key_schema, pack, pack_all, pack_bytes, staged, table, text_or_empty, unpack, unpack_all, unpack_bytes

BLOCK_CHARS = 16_000_000
PARENTS, PER_PARENT = 256, 1 << 40
ROUNDS, BURN_IN, SAMPLES = 2, 2, 3
STRENGTH = (1.0, 1.0, 1.0)  # of the root, parents and contexts
#: Scores of tokens travel as whole millionths.
UNIT = 1e6


def contexts_of(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The contexts that words of these sizes are for the next; the empty word is a text's start."""
    import xxhash

    last = np.where(sizes > 0, np.frombuffer(b"\0" + b"".join(words), dtype=np.uint8)[np.cumsum(sizes)], 0).astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return last * PER_PARENT + (hashes % np.uint64(PER_PARENT)).astype(np.int64)


def context_of(word: bytes) -> int:
    return int(contexts_of([word], np.array([len(word)]))[0])


def reseat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers one by one. pull: (strength + discount * tables in the restaurant) * the parent's probability."""
    tables = (customers > 0).astype(np.int64)
    left = np.flatnonzero(customers > 1)
    seated = 1
    c, a, t = customers[left], pull[left], np.ones(len(left), dtype=np.int64)
    while len(left):
        step = 1 if seated < 128 else seated // 32
        more = np.minimum(step, c - seated)
        p = a / np.maximum(seated - discount * t + a, 1e-300)
        t += rng.random(len(t)) < p if step == 1 else rng.binomial(more, np.clip(p, 0, 1))
        seated += step
        done = c <= seated
        if done.any():
            tables[left[done]] = t[done]
            left, c, a, t = left[~done], c[~done], a[~done], t[~done]
    return tables


class Column:
    """Values of restaurants that are looked up by their numbers; others have 0."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values

    def __getitem__(self, at):
        if not len(self.ids):
            return np.zeros(np.shape(at))
        i = np.minimum(np.searchsorted(self.ids, at), len(self.ids) - 1)
        return np.where(self.ids[i] == at, self.values[i], 0.0)


class Totals:
    """Customers and tables of all restaurants, but of contexts only a seating's own, in its order."""

    def __init__(self, contexts=(None, None), parents=None, root=(0.0, 0.0)):
        self.contexts, self.parents, self.root = contexts, np.zeros((2, PARENTS)) if parents is None else parents, root

    def with_contexts(self, ids: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> Totals:
        return Totals((Column(ids, customers), Column(ids, tables)), self.parents, self.root)


class Seating:
    """The words of a bucket: counts by word and context, sorted, and tables at each level. ids: the contexts, sorted, with those that
    are only asked for; at: where in ids those of counts are."""

    def __init__(self, words: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, ids: np.ndarray | None = None, at: np.ndarray | None = None):
        self.n, self.word, self.count = words, word, count
        self.ids = np.unique(context) if ids is None else ids
        self.at = np.searchsorted(self.ids, context) if at is None else at
        pairs = word * PARENTS + context // PER_PARENT  # sorted as well
        new = np.diff(pairs, prepend=-1) > 0
        pairs, self.up = pairs[new], np.cumsum(new) - 1
        self.word1, self.parent = pairs // PARENTS, pairs % PARENTS
        self.tables = np.ones(len(word), dtype=np.int64)
        self.lift()
        self.tables1 = np.minimum(self.count1, 1)
        self.lift()
        self.tables0 = np.minimum(self.count0, 1)

    def put(self, tables: np.ndarray, tables1: np.ndarray, tables0: np.ndarray) -> None:
        self.tables, self.tables1, self.tables0 = tables, tables1, tables0
        self.lift()

    def lift(self) -> None:
        """Tables are the parents' customers."""
        self.count1 = np.bincount(self.up, weights=self.tables, minlength=len(self.word1)).astype(np.int64)
        if hasattr(self, "tables1"):
            self.count0 = np.bincount(self.word1, weights=self.tables1, minlength=self.n).astype(np.int64)

    def totals(self) -> Totals:
        count = lambda at, x, n: np.bincount(at, weights=x, minlength=n)
        parents = np.stack([count(self.parent, self.count1, PARENTS), count(self.parent, self.tables1, PARENTS)])
        contexts = (Column(self.ids, count(self.at, x, len(self.ids))) for x in (self.count, self.tables))
        return Totals(tuple(contexts), parents, (float(self.count0.sum()), float(self.tables0.sum())))

    def p0(self, t: Totals, d, base: float) -> np.ndarray:
        return (self.count0 - d[0] * self.tables0 + (STRENGTH[0] + d[0] * t.root[1]) * base) / (STRENGTH[0] + t.root[0])

    def p1(self, t: Totals, d, p0: np.ndarray) -> np.ndarray:
        j = self.parent
        return (self.count1 - d[1] * self.tables1 + (STRENGTH[1] + d[1] * t.parents[1][j]) * p0[self.word1]) / (STRENGTH[1] + t.parents[0][j])

    def sweep(self, t: Totals, d, base: float, rng: np.random.Generator) -> None:
        p0 = self.p0(t, d, base)
        p1 = self.p1(t, d, p0)
        self.tables = reseat(self.count, (STRENGTH[2] + d[2] * t.contexts[1].values[self.at]) * p1[self.up], d[2], rng)
        self.lift()
        self.tables1 = reseat(self.count1, (STRENGTH[1] + d[1] * t.parents[1][self.parent]) * p0[self.word1], d[1], rng)
        self.lift()
        self.tables0 = reseat(self.count0, np.full(self.n, (STRENGTH[0] + d[0] * t.root[1]) * base), d[0], rng)

    def find(self, word: np.ndarray, context: np.ndarray):
        """Where words in contexts are, seen there or not: the words, parents, contexts, and their entries and whether there are any."""

        def entry(pairs: np.ndarray, wanted: np.ndarray):
            if not len(pairs):
                return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
            at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            return at, pairs[at] == wanted

        parent = context // PER_PARENT
        at, known = entry(self.ids, context)
        upper = entry(self.word1 * PARENTS + self.parent, word * PARENTS + parent)
        own = entry(self.word * (len(self.ids) + 1) + self.at, word * (len(self.ids) + 1) + np.where(known, at, len(self.ids)))
        return word, parent, (at, known), upper, own

    def predict_at(self, t: Totals, d, base: float, places) -> np.ndarray:
        """Probabilities at places that were found."""
        word, parent, context, upper, own = places
        take = lambda x, place: np.where(place[1], x[place[0]], 0) if len(x) else np.zeros(len(word))
        p0 = self.p0(t, d, base)
        p1 = (take(self.count1 - d[1] * self.tables1, upper) + (STRENGTH[1] + d[1] * t.parents[1][parent]) * p0[word]) / (STRENGTH[1] + t.parents[0][parent])
        customers, tables = (take(x.values, context) for x in t.contexts)
        return (take(self.count - d[2] * self.tables, own) + (STRENGTH[2] + d[2] * tables) * p1) / (STRENGTH[2] + customers)

    def predict(self, t: Totals, d, base: float, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.predict_at(t, d, base, self.find(word, context))


def chain(seating: Seating, bucket: int, round_: int, totals: Totals, discounts, base: float):
    """Seatings of a round: after each of SAMPLES sweeps that follow BURN_IN. Equal arguments give equal seatings."""
    rng = np.random.default_rng([bucket, round_])
    for i in range(BURN_IN + SAMPLES - 1):
        seating.sweep(totals, discounts, base, rng)
        if i >= BURN_IN - 1:
            yield seating


def _split(docs: DataFrame, keys: list[str], text: str, train: str, n_buckets: int, block_chars: int) -> DataFrame:
    """Blocks: a row for each document (its words' codes) and one for each bucket of its words."""
    kept = key_schema(docs, keys)
    schema = T.StructType([*T._parse_datatype_string("block long, bucket int").fields, *kept, *T._parse_datatype_string("train boolean, data binary, words binary, slots binary").fields])
    arrow = arrow_schema(schema)
    source = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(train).alias("__train"), text_or_empty(f"`{text}`").cast("binary").alias("__body"))

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        block, chars, codes, rows = TaskContext.get().partitionId() << 32, 0, Codes(), []

        def flush():
            sizes = np.array([len(f) for _, _, f in rows], dtype=np.int64)
            tokens = np.concatenate([f for _, _, f in rows])
            frequency = np.bincount(tokens, minlength=len(codes))
            order = np.argsort(-frequency, kind="stable")
            rank = np.empty(len(codes), dtype=np.int64)
            rank[order] = np.arange(len(codes))
            words = list(codes)
            words = [words[i] for i in order.tolist()]
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            tokens = rank[tokens]
            pairs, inverse = np.unique(_pairs(tokens, len(words)), return_inverse=True)
            counts = np.bincount(inverse, weights=np.repeat([t for _, t, _ in rows], sizes), minlength=len(pairs)).astype(np.int64)
            after = pairs // len(words)
            contexts = contexts_of(words, lengths)[pairs - after * len(words)]
            per_word = np.bincount(after, minlength=len(words))
            firsts = np.cumsum(per_word) - per_word
            of = np.fromiter(map(xxhash.xxh32_intdigest, words), dtype=np.int64, count=len(words)) % n_buckets
            by = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[by], np.arange(n_buckets + 1))
            ends = np.cumsum(sizes)
            out = [(block, None, *key, t, pack(tokens[e - n : e]), None, None) for (key, t, _), e, n in zip(rows, ends.tolist(), sizes.tolist(), strict=True)]
            for b in np.unique(of):
                slots = by[cuts[b] : cuts[b + 1]]
                own = [words[i] for i in slots.tolist()]
                n = per_word[slots]
                at = np.repeat(firsts[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ids, of_ids = np.unique(contexts[at], return_inverse=True)
                out.append((block, int(b), *[None] * len(keys), None, pack_all(lengths[slots], n, of_ids, counts[at], np.diff(ids, prepend=0)), pack_bytes(b"".join(own)), pack(np.diff(slots, prepend=0))))
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[i : i + 4096], strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            bodies, train_ = batch.column("__body"), batch.column("__train")
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                if rows and chars + len(body) > block_chars:
                    yield from flush()
                    block, chars, codes, rows = block + 1, 0, Codes(), []
                chars += len(body)
                found = body.lower().split()  # at bytes 32 and 9 to 13
                found.append(b"")  # the end
                rows.append((tuple(batch.column(k)[i].as_py() for k in keys), bool(train_[i].as_py()), np.fromiter(map(codes.__getitem__, found), dtype=np.int32, count=len(found))))
        if rows:
            yield from flush()

    return source.mapInArrow(run, schema)


def _pairs(tokens: np.ndarray, words: int) -> np.ndarray:
    """Each token with the one before it; the end of one text is the start of the next."""
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before[0] = tokens[-1]
    return tokens * words + before


def _merge(group: pa.Table) -> tuple[bytes, list]:
    """A bucket's words with their contexts and counts (0: only asked for), and what each block asks for: words, and which of their
    contexts."""
    order = np.argsort(group.column("block").to_numpy(), kind="stable")
    rows = list(zip(*(group.column(c).to_pylist() for c in ("block", "data", "words", "slots")), strict=True))
    index, found = Codes(), []
    for i in order.tolist():
        block, data, words, slots = rows[i]
        sizes, n, context, count, ids = (x.astype(np.int64) for x in unpack_all(data))
        flat, ends = unpack_bytes(words), np.cumsum(sizes)
        cut = (flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        found.append((block, np.fromiter(map(index.__getitem__, cut), dtype=np.int64, count=len(sizes)), n, context, count, np.cumsum(ids), slots))
    ids = np.unique(np.concatenate([f[5] for f in found]))
    keys = [np.repeat(mine, n) * len(ids) + np.searchsorted(ids, own)[context] for _, mine, n, context, _, own, _ in found]
    pairs, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([f[4] for f in found]), minlength=len(pairs)).astype(np.int64)
    word = pairs // len(ids)
    firsts = np.searchsorted(word, np.arange(len(index)))
    asked, end = [], 0
    for block, mine, n, context, _, _, slots in found:
        end += len(context)
        asked.append((block, pack_all(mine, n, inverse[end - len(context) : end] - np.repeat(firsts[mine], n)), slots))
    return pack_all(np.array([len(index)]), np.diff(word, prepend=0), pairs - word * len(ids), total, np.diff(ids, prepend=0)), asked


def _entries(model: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words; words, contexts and counts of all entries, and the numbers of contexts."""
    n, word, context, count, ids = (x.astype(np.int64) for x in unpack_all(model))
    return int(n[0]), np.cumsum(word), context, count, np.cumsum(ids)


def _seating(model: bytes) -> Seating:
    n, word, context, count, ids = _entries(model)
    seen = count > 0
    at = context[seen]
    return Seating(n, word[seen], ids[at], count[seen], ids, at)


def _answers(seating: Seating, model: bytes, asked: list[tuple], each: list[Totals], kept: list[tuple], discounts, base: float) -> list[tuple]:
    """Scores for the blocks that asked. However many blocks ask for an entry, it is predicted once for each sample."""
    words, word, context, count, ids = _entries(model)
    places, total = seating.find(word, ids[context]), 0
    for t, tables in zip(each, kept, strict=True):
        seating.put(*tables)
        total = total + seating.predict_at(t, discounts, base, places)
    scores = np.rint(np.clip(-np.log10(total / len(each)), 0, 300) * UNIT).astype(np.int64)
    known = np.bincount(word, weights=count, minlength=words).astype(np.int64)
    firsts, out = np.searchsorted(word, np.arange(words)), []
    for block, data, slots in asked:
        mine, n, which = (x.astype(np.int64) for x in unpack_all(data))
        out.append((block, pack_all(known[mine], n, scores[np.repeat(firsts[mine], n) + which]), slots))
    return out


#: What a bucket gives out in a round: sums that all get (parents and root, at a place), parts of contexts' totals for the bucket that
#: adds these up (target), and its seatings.
ROUND = "bucket int, kind string, sample int, at int, customers double, tables double, target int, data binary"
_ROUND = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("sample", pa.int32()), ("at", pa.int32()), ("customers", pa.float64()), ("tables", pa.float64()), ("target", pa.int32()), ("data", pa.binary())])


def _dealt(ids: np.ndarray, n: int):
    """Which contexts go to each of n buckets."""
    to = ids % PER_PARENT % n
    by = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by], np.arange(n + 1)).tolist()
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, by[cuts[b] : cuts[b + 1]]


def _given(bucket: int, seating: Seating, samples: list[Totals], n_buckets: int, more=(), data: bytes | None = None) -> pa.Table:
    """Rows of ROUND of a bucket's own totals, one for each sample."""
    sums = [x for i, t in enumerate(samples) for x in (("parents", i, *t.parents), ("root", i, [t.root[0]], [t.root[1]]))]
    rows = []
    for kind, i, customers, tables in [*sums, *more]:
        customers, tables = np.asarray(customers, dtype=float), np.asarray(tables, dtype=float)
        rows += [(bucket, kind, i, int(k), float(customers[k]), float(tables[k]), None, None) for k in np.flatnonzero(customers + tables)]
    columns = [t.contexts[1].values.astype(np.int64) for t in samples]
    for b, own in _dealt(seating.ids, n_buckets):
        rows.append((bucket, "contexts", None, None, None, None, b, pack_all(*(c[own] for c in columns))))
    if data is not None:
        rows.append((bucket, "seatings", None, None, None, None, None, data))
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ROUND, strict=True)], schema=_ROUND)


REPLY = "bucket int, kind string, target int, data binary"
INDEX = "bucket int, target int, contexts binary"
_INDEX = pa.schema([("bucket", pa.int32()), ("target", pa.int32()), ("contexts", pa.binary())])


def _index(models: DataFrame, n_buckets: int) -> DataFrame:
    """Each bucket's contexts and their customers there, for the bucket that adds them up."""

    def run(batches):
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("model").to_pylist(), strict=True):
                _, _, context, count, ids = (x.astype(np.int64) for x in unpack_all(data))
                ids = np.cumsum(ids)
                customers = np.bincount(context, weights=count, minlength=len(ids)).astype(np.int64)
                rows = [(bucket, b, pack_all(np.diff(ids[own], prepend=0), customers[own])) for b, own in _dealt(ids, n_buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)

    return models.mapInArrow(run, INDEX)


def _replies(given: DataFrame, index: DataFrame) -> DataFrame:
    """The totals of contexts over all buckets, for each bucket in the order of what it gave."""
    arrow = arrow_schema(REPLY)

    def add_up(rows: pa.Table, listed: pa.Table) -> pa.Table:
        known = dict(zip(listed.column("bucket").to_pylist(), listed.column("contexts").to_pylist(), strict=True))
        parts = []
        for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("data").to_pylist(), strict=True):
            ids, customers = (x.astype(np.int64) for x in unpack_all(known[bucket]))
            parts.append((np.cumsum(ids), customers, *(x.astype(np.int64) for x in unpack_all(data))))
        if not parts:
            return arrow.empty_table()
        _, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([p[k] for p in parts])).astype(np.int64)[inverse] for k in range(1, len(parts[0]))]
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        data = [pack_all(*(x[e - len(p[0]) : e] for x in sums)) for p, e in zip(parts, ends, strict=True)]
        return pa.Table.from_arrays([rows.column("bucket"), rows.column("kind"), rows.column("target"), pa.chunked_array([pa.array(data, type=pa.binary())])], schema=arrow)

    sent = given.filter("kind = 'contexts'").select("bucket", "kind", "target", "data")
    return sent.groupBy("target").cogroup(index.groupBy("target")).applyInArrow(add_up, REPLY)


def _answered(seating: Seating, replies: pa.Table, n_buckets: int, shared: list[Totals]) -> list[Totals]:
    """The totals of each sample, with those of the seating's contexts."""
    places = dict(_dealt(seating.ids, n_buckets))
    columns = np.zeros((len(shared) + 1, len(seating.ids)))
    for kind, target, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "target", "data")), strict=True):
        if kind == "contexts":
            columns[:, places[target]] = unpack_all(data)
    return [t.with_contexts(seating.ids, columns[0], tables) for t, tables in zip(shared, columns[1:], strict=True)]


def _gathered(given: DataFrame) -> tuple[list, list[Totals]]:
    """Sums that all get: the rows, as many as parents and samples, and as totals of each sample."""
    rows = given.filter("at is not null").groupBy("kind", "sample", "at").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).collect()
    out = [Totals() for _ in range(1 + max((r["sample"] for r in rows), default=0))]
    for r in rows:
        if r["kind"] == "root":
            out[r["sample"]].root = (r["customers"], r["tables"])
        elif r["kind"] == "parents":
            out[r["sample"]].parents[:, r["at"]] = r["customers"], r["tables"]
    return rows, out


def _first(bucket: int, s: Seating, n_buckets: int) -> pa.Table:
    known = np.zeros(s.n, dtype=np.int64)
    np.add.at(known, s.word, s.count)
    more = [("words", 0, [known.sum()], [(known > 0).sum()])]
    more.append(("ones", 0, *([(c == x).sum() for c in (s.count0, s.count1, s.count)] for x in (1, 2))))
    return _given(bucket, s, [s.totals()], n_buckets, more)


def score(docs: DataFrame, train: str, keys: list[str], text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keys of docs, and n_tokens, n_known, train_tokens long, base_score, score double of each whole text. train: a boolean column
    that marks the documents to learn from."""
    n_buckets = buckets_for(docs)
    parts = staged(_split(docs, keys, text, train, n_buckets, block_chars), "lm-blocks", by="block")
    state_schema = "bucket int, model binary, asked array<struct<block:bigint,data:binary,slots:binary>>"
    state_arrow = arrow_schema(state_schema)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        model, asked = _merge(group)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], type=pa.int32()), pa.array([model], type=pa.binary()), pa.array([[dict(zip(("block", "data", "slots"), a, strict=True)) for a in asked]], type=state_arrow.field("asked").type)], schema=state_arrow)

    merged = parts.filter("bucket >= 0").select("bucket", "block", "data", "words", "slots").groupBy("bucket").applyInArrow(merge, state_schema)
    model = staged(merged, "lm-model", by="bucket")
    models = model.select("bucket", "model")

    def first(batches):
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("model").to_pylist(), strict=True):
                yield from _first(bucket, _seating(data), n_buckets).to_batches()

    index = staged(_index(models, n_buckets), "lm-contexts", by="target")
    given = staged(models.mapInArrow(first, ROUND), "lm-round")
    rows, shared = _gathered(given)
    tokens, words = next(((r["customers"], r["tables"]) for r in rows if r["kind"] == "words"), (0.0, 0.0))
    once = {r["at"]: (r["customers"], r["tables"]) for r in rows if r["kind"] == "ones"}
    discounts = [float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in (once.get(i, (0.0, 0.0)) for i in range(3))]
    base = 1 / (words + 1)

    def sweeps(round_: int, shared: list[Totals]):
        def sweep(models: pa.Table, replies: pa.Table) -> pa.Table:
            out = []
            for bucket, data in zip(models.column("bucket").to_pylist(), models.column("model").to_pylist(), strict=True):
                seating = _seating(data)
                (totals,) = _answered(seating, replies, n_buckets, shared)
                each, kept = [], []
                for own in chain(seating, bucket, round_, totals, discounts, base):
                    each.append(own.totals())
                    kept += [own.tables, own.tables1, own.tables0]
                last = round_ == ROUNDS
                out.append(_given(bucket, seating, each if last else each[-1:], n_buckets, data=pack_all(*kept) if last else None))
            return pa.concat_tables(out) if out else _ROUND.empty_table()

        return sweep

    for round_ in range(1, ROUNDS + 1):
        given = staged(models.groupBy("bucket").cogroup(_replies(given, index).groupBy("bucket")).applyInArrow(sweeps(round_, shared), ROUND), "lm-round")
        _, shared = _gathered(given)
    if len(shared) < SAMPLES:
        shared = [*shared, *[Totals()] * (SAMPLES - len(shared))]

    answer_schema = "block bigint, data binary, slots binary"
    answer_arrow = arrow_schema(answer_schema)

    def answer(models: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for r in range(models.num_rows):
            seating = _seating(models.column("model")[r].as_py())
            each = _answered(seating, replies, n_buckets, shared)
            kept = next(d for k, d in zip(replies.column("kind").to_pylist(), replies.column("data").to_pylist(), strict=True) if k == "seatings")
            kept = [x.astype(np.int64) for x in unpack_all(kept)]
            asked = [(a["block"], a["data"], a["slots"]) for a in models.column("asked")[r].as_py()]
            out += _answers(seating, models.column("model")[r].as_py(), asked, each, [kept[i : i + 3] for i in range(0, len(kept), 3)], discounts, base)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), answer_arrow, strict=True)], schema=answer_arrow) if out else answer_arrow.empty_table()

    back = _replies(given, index).unionByName(given.filter("kind = 'seatings'").select("bucket", "kind", "target", "data"))
    answers = model.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(answer, answer_schema)
    kept = key_schema(docs, keys)
    out_schema = T.StructType([*kept, *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    out_arrow = arrow_schema(out_schema)
    n_train, n_words = int(tokens), int(words)

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = [unpack(data).astype(np.int64) for data in rows.column("data").to_pylist()]
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        tokens = np.concatenate(own)
        words = int(tokens.max()) + 1
        pairs, inverse = np.unique(_pairs(tokens, words), return_inverse=True)
        per_word = np.bincount(pairs // words, minlength=words)
        firsts = np.cumsum(per_word) - per_word
        count, value = np.zeros(words, dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
        for data, slots in zip(answers.column("data").to_pylist(), answers.column("slots").to_pylist(), strict=True):
            known, n, scores = unpack_all(data)
            at, n = np.cumsum(unpack(slots).astype(np.int64)), n.astype(np.int64)
            count[at] = known
            value[np.repeat(firsts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = scores
        starts = np.cumsum(sizes) - sizes
        base_of = np.log10((count + 0.5) / (n_train + 0.5 * (n_words + 1)))
        sums = [np.add.reduceat(x, starts) for x in ((count[tokens] > 0).astype(np.int64), base_of[tokens], value[inverse])]
        return pa.Table.from_arrays([*(rows.column(k.name).combine_chunks() for k in kept), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(own), n_train, dtype=np.int64)), pa.array(sums[1]), pa.array(-sums[2] / UNIT)], schema=out_arrow)

    rows = parts.filter("bucket is null").select("block", *keys, "data")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, out_schema)


def perplexity(scored: DataFrame, *by: str) -> DataFrame:
    """Perplexities per token of scored documents, by columns: perplexity and base_perplexity."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy(*by).agg(ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"), (~held).alias("train"))
    return score(docs, "train", ["doc_id", "held_out"])
