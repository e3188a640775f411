"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover the whole of it. Filters of WIDTH bytes, one weight for
each byte value and place, slide over each chunk byte by byte; a chunk keeps each filter's largest response; the mean
and the maximum of those over the chunks feed a logistic output. Filters and output are learned together from a bounded,
class-balanced sample of labelled documents: SAMPLE_PER_LABEL of each label, in the order of a hash, short and long
ones; a text of over SAMPLE_BYTES is learned from by SPREAD chunks, evenly spread over the whole of it. Scores are of all
chunks always. The class balance of all labelled documents sets the output's offset.

Defined results: a null text is an empty one and has one chunk of padding; rows with equal texts have equal scores;
labels that are null, or of documents that are not there, teach nothing; of several labels of a doc_id the least holds,
of several texts the least; without both labels every score is 0.5, or 0.99 or 0.01 if there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, key_schema, table, text_or_empty

CHUNK, OVERLAP, WIDTH, FILTERS = 256, 16, 6, 16
#: The bound of the training sample: documents of each label, the longest of which all chunks are taken, and how many of longer ones.
SAMPLE_PER_LABEL, SAMPLE_BYTES, SPREAD = 1600, 12_000, 48
LEAST_STEPS = 350
THRESHOLD = 0.7
SYMBOLS = 257  # bytes and padding


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, padded, and how many each text has. Their overlap holds every window of WIDTH bytes whole."""
    hop = CHUNK - OVERLAP
    counts = np.array([max(1, -(-max(0, len(t) - OVERLAP) // hop)) for t in texts], dtype=np.int64)
    out = np.full((int(counts.sum()), CHUNK), SYMBOLS - 1, dtype=np.int16)
    row = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        x = np.full(hop * (n - 1) + CHUNK, SYMBOLS - 1, dtype=np.int16)
        x[: len(t)] = np.frombuffer(t, dtype=np.uint8)
        out[row : row + n] = np.lib.stride_tricks.sliding_window_view(x, CHUNK)[::hop]
        row += n
    return out, counts


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = (rng.normal(size=(WIDTH, SYMBOLS, FILTERS)) * 0.3).astype(np.float32)
        self.filters[:, -1] = 0
        self.out = np.zeros(2 * FILTERS, dtype=np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.offset = 0.0

    def respond(self, chunks: np.ndarray, want_place: bool = False):
        """Each filter's largest response in each chunk, squashed, and where it is."""
        best, place = np.empty((len(chunks), FILTERS), dtype=np.float32), None
        if want_place:
            place = np.empty((len(chunks), FILTERS), dtype=np.int64)
        n = CHUNK - WIDTH + 1
        for i in range(0, len(chunks), 192):
            x = chunks[i : i + 192]
            total = np.take(self.filters[0], x[:, :n], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.filters[j], x[:, j : j + n], axis=0)
            if want_place:
                place[i : i + 192] = total.argmax(axis=1)
            best[i : i + 192] = total.max(axis=1)
        return np.tanh(0.5 * best), place

    @staticmethod
    def pooled(responses: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        return np.concatenate([np.add.reduceat(responses, starts) / counts[:, None], np.maximum.reduceat(responses, starts)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        chunks, counts = chunked(texts)
        h = self.pooled(self.respond(chunks)[0], counts)
        # one text at a time, so that a score can't depend on the batch's shape
        logits = np.array([float(np.dot(row.astype(np.float64), self.out.astype(np.float64))) for row in h]) + float(self.bias[0]) + self.offset
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def gradients(self, x: np.ndarray, n: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss of documents of n chunks each, by filters, output and bias. They reach a filter only where its response
        was largest."""
        r, place = self.respond(x, True)
        h = self.pooled(r, n)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias[0], -30, 30)))
        d = ((p - labels) / len(n)).astype(np.float32)
        d_h = d[:, None] * self.out[None]
        doc = np.repeat(np.arange(len(n)), n)
        is_top = r == h[doc, FILTERS:]
        d_r = d_h[doc, :FILTERS] / n[doc, None] + d_h[doc, FILTERS:] * is_top
        d_z = d_r * 0.5 * (1 - r * r)
        by_filter, k = np.zeros_like(self.filters), np.arange(FILTERS)[None]
        for j in range(WIDTH):
            np.add.at(by_filter[j], (x[np.arange(len(x))[:, None], place + j], np.broadcast_to(k, place.shape)), d_z)
        return [by_filter, h.T @ d, np.array([d.sum()], dtype=np.float32)]

    def train(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Network:
        """Adam on the log loss; a text is a list of pieces. A small sample is gone through more often, so that there are LEAST_STEPS steps."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
        rng = np.random.default_rng(seed)
        chunks, counts = chunked([piece for t in texts for piece in t])
        pieces = np.array([len(t) for t in texts])
        counts = np.add.reduceat(counts, np.cumsum(pieces) - pieces)
        starts = np.cumsum(counts) - counts
        weights = [self.filters, self.out, self.bias]
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                n = counts[own]
                rows = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                grads = self.gradients(chunks[rows], n, labels[own])
                grads[1] = grads[1] + 1e-4 * self.out
                t += 1
                step = rate * (0.3 if epoch >= epochs - 2 else 1)
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Network:
    """A network from labels (key, label); held-out rows must have been left out of them already."""
    clean = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("__label"))
    balance = {r["__label"]: r["count"] for r in clean.groupBy("__label").count().collect()}
    net = Network()
    if len(balance) < 2:
        net.offset = {0: -4.6, 1: 4.6}[next(iter(balance))] if balance else 0.0
        return net
    there = docs.select(key).join(clean, key).groupBy(key).agg(F.min("__label").alias("__label"))
    order = [F.xxhash64(key), F.col(key)]
    chosen = {r[key]: r["__label"] for r in there.filter("__label = 0").orderBy(*order).limit(SAMPLE_PER_LABEL).union(there.filter("__label = 1").orderBy(*order).limit(SAMPLE_PER_LABEL)).collect()}
    # a few texts, picked out of the scan; no text is shuffled but those, and of long ones only pieces
    raw = text_or_empty(text).cast("binary")
    size = F.octet_length(raw).cast("long")
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")), lambda i: F.substr(raw, (F.floor(i * (size - CHUNK) / (SPREAD - 1)) + 1).cast("int"), F.lit(CHUNK)))
    body = docs.filter(F.col(key).isin(list(chosen))).select(key, F.when(size <= SAMPLE_BYTES, F.array(raw)).otherwise(spread).alias("__pieces"))
    sample = [([bytes(p) for p in r["__pieces"]], chosen[r[key]]) for r in body.groupBy(key).agg(F.min("__pieces").alias("__pieces")).orderBy(*order).collect()]
    found = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    if not all(found):
        return net
    net.train([x for x, _ in sample], np.array([y for _, y in sample], dtype=np.float32))
    net.offset = float(np.log(balance[1] / balance[0]) - np.log(found[0] / found[1]))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text."""
    keys = [c for c in docs.columns if c not in (text, column)]
    schema = T.StructType([*key_schema(docs, keys), T.StructField(text, T.StringType()), T.StructField(column, T.DoubleType())])
    arrow = arrow_schema(schema)
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB, whatever the corpus

    def run(batches):
        own = shipped.value
        for batch in batches:
            texts = batch.column(text)
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < 1 << 20):
                    part.append((texts[at + len(part)].as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(part[-1])
                n = len(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in keys), texts.slice(at, n), pa.array(own.scores(part), type=pa.float64())], schema=arrow)
                at += n

    return docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def fold(key: str, of: int) -> F.Column:
    """crc32 of a key as text, modulo of; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Network:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 4) != 2)
    return fit(table(spark, sf_dir, "documents") if docs is None else docs, labels)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(spark, sf_dir)).drop("text")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
