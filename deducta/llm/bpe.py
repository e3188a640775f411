"""Byte-level BPE encoding and decoding.

Pre-tokens are exploded in blocks: a block of whole documents keeps, for each document, the block's code of the
pre-token at every position, and sends each of its distinct pre-tokens once to the bucket of that pre-token. A bucket
sees every pre-token of the corpus that hashes to it and encodes each distinct one once. The ids go back to the
blocks, which put them together by position. A pre-token in every document is one entry per block, so no key is hot.

Defined results: a null text is an empty one and has no ids; repeated rows are encoded each; a null id is decoded as
no id; an empty table gives an empty one. Ids outside the vocabulary raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, arrow_schema, buckets_for, key_schema, pack, pack_bytes, staged, table, text_or_empty, unpack, unpack_bytes

#: Characters in a block of documents (one document may be longer); bounds what a task holds.
BLOCK_CHARS = 16_000_000
#: Largest vocabulary file that is sent to all executors.
MAX_VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str) -> bytes:
    """A rank file's bytes. A vocabulary is fixed, not a product of the corpus; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_made: dict = {}


def _word_encoder(data: bytes, pattern: str):
    key = ("encoder", hashlib.md5(data).digest(), pattern)
    if key not in _made:
        import tiktoken

        _made[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})._core_bpe.encode_single_piece
    return _made[key]


class TokenBytes:
    """The token-byte table as flat arrays, for joins by id."""

    def __init__(self, entries: list[bytes], present: np.ndarray):
        self.sizes = np.array([len(x) for x in entries], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if entries else np.zeros(0, dtype=np.int64)
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.present = present

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if int(ids.min()) < 0 or int(ids.max()) >= len(self.sizes) or not self.present[ids].all():
            raise ValueError("an id is not in the vocabulary")
        out = []
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            take = np.repeat(self.starts[part] - (ends - sizes), sizes) + np.arange(ends[-1])
            out.append(self.flat[take].tobytes())
        return b"".join(out)


def _tables(data: bytes) -> tuple[TokenBytes, TokenBytes]:
    """By id: its bytes, and its decimal number with a space."""
    key = ("tables", hashlib.md5(data).digest())
    if key not in _made:
        ranks = parse_ranks(data)
        n = max(ranks.values(), default=-1) + 1
        entries, present = [b""] * n, np.zeros(n, dtype=bool)
        for piece, i in ranks.items():
            entries[i], present[i] = piece, True
        _made[key] = TokenBytes(entries, present), TokenBytes([b"%d " % i for i in range(n)], np.ones(n, dtype=bool))
    return _made[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keys: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keys of docs (all columns but text by default) and ids array<int>, the tokens of each whole text."""
    spark = docs.sparkSession
    keys = [c for c in docs.columns if c != text] if keys is None else keys
    n_buckets = buckets_for(docs)
    kept = key_schema(docs, keys)
    renamed = [T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(kept)]
    source = docs.select(*[F.col(f"`{f.name}`").alias(r.name) for f, r in zip(kept, renamed, strict=True)], text_or_empty(f"`{text}`").alias("body"))
    block_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), *renamed, T.StructField("data", T.BinaryType()), T.StructField("slots", T.BinaryType())])
    names, arrow = [r.name for r in renamed], arrow_schema(block_schema)

    def blocks(batches):
        import regex
        import xxhash
        from pyspark import TaskContext

        find, hashed = regex.compile(pattern).findall, xxhash.xxh32_intdigest
        block, chars, codes, rows = TaskContext.get().partitionId() << 32, 0, Codes(), []

        def flush():
            # codes by frequency: most positions then take one byte, and the rest compress well
            counts = np.bincount(np.concatenate([found for _, found in rows]), minlength=len(codes))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(codes), dtype=np.int32)
            rank[order] = np.arange(len(codes), dtype=np.int32)
            words = list(codes)
            words = [words[i] for i in order.tolist()]
            of = np.fromiter((hashed(w.encode("utf-8", "surrogatepass")) % n_buckets for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(n_buckets + 1))
            out = [(block, None, *key, pack(rank[found]), None) for key, found in rows]
            for b in np.unique(of):
                slots = order[cuts[b] : cuts[b + 1]]
                pieces = [words[i].encode("utf-8", "surrogatepass") for i in slots]
                sizes = np.array([len(p) for p in pieces], dtype=np.int64)
                out.append((block, int(b), *[None] * len(names), pack_bytes(b"".join(pieces)), len(p := pack(sizes)).to_bytes(4, "little") + p + pack(np.diff(slots, prepend=0))))
            for i in range(0, len(out), 4096):
                part = list(zip(*out[i : i + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(part, arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = [batch.column(n) for n in names]
            bodies = batch.column("body")
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                if rows and chars + len(body) > block_chars:
                    yield from flush()
                    block, chars, codes, rows = block + 1, 0, Codes(), []
                chars += len(body)
                found = np.array(list(map(codes.__getitem__, find(body))), dtype=np.int32)
                rows.append((tuple(c[i].as_py() for c in columns), found))
        if rows:
            yield from flush()

    parts = staged(source.mapInArrow(blocks, block_schema), "bpe-blocks", by="block")
    back_schema = "block long, data binary, slots binary"
    back_arrow = arrow_schema(back_schema)
    shipped = spark.sparkContext.broadcast(ranks)

    def encode_bucket(group: pa.Table) -> pa.Table:
        one = _word_encoder(shipped.value, pattern)
        known: dict[bytes, tuple[bytes, int]] = {}
        out = []
        for block, data, slots in zip(*(group.column(n).to_pylist() for n in ("block", "data", "slots")), strict=True):
            cut = 4 + int.from_bytes(slots[:4], "little")
            sizes, flat, at, ids, counts = unpack(slots[4:cut]), unpack_bytes(data), 0, [], []
            for size in sizes.tolist():
                piece = flat[at : at + size]
                at += size
                got = known.get(piece)
                if got is None:
                    found = one(piece)
                    got = known[piece] = (np.array(found, dtype=np.int32).tobytes(), len(found))
                ids.append(got[0])
                counts.append(got[1])
            joined = pack(np.frombuffer(b"".join(ids), dtype=np.int32))
            out.append((block, len(joined).to_bytes(4, "little") + joined + pack(np.array(counts, dtype=np.int64)), slots[cut:]))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), back_arrow, strict=True)], schema=back_arrow)

    back = parts.filter("bucket is not null").groupBy("bucket").applyInArrow(encode_bucket, back_schema)
    out_schema = T.StructType([*renamed, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out_arrow = arrow_schema(out_schema)

    def reassemble(rows: pa.Table, words: pa.Table) -> pa.Table:
        flats, base = [], 0
        pieces = []
        for data, slots in zip(words.column("data").to_pylist(), words.column("slots").to_pylist(), strict=True):
            cut = 4 + int.from_bytes(data[:4], "little")
            pieces.append((unpack(data[4:cut]).astype(np.int32), unpack(data[cut:]).astype(np.int64), np.cumsum(unpack(slots).astype(np.int64))))
        total = sum(len(s) for _, _, s in pieces)
        sizes, starts = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
        for ids, counts, slots in pieces:
            sizes[slots] = counts
            starts[slots] = base + np.cumsum(counts) - counts
            base += len(ids)
            flats.append(ids)
        flat = np.concatenate(flats) if flats else np.zeros(0, dtype=np.int32)
        found, offsets = [], [0]
        for data in rows.column("data").to_pylist():
            codes = unpack(data)
            n = sizes[codes]
            ends = np.cumsum(n, dtype=np.int32)
            if len(codes):
                found.append(flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)])
            offsets.append(offsets[-1] + (int(ends[-1]) if len(codes) else 0))
        values = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=pa.int32()))
        columns = [rows.column(n).combine_chunks() for n in names]
        return pa.Table.from_arrays([*columns, ids.cast(out_arrow.field("ids").type)], schema=out_arrow)

    rows = parts.filter("bucket is null").select("block", *names, "data")
    joined = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(reassemble, out_schema)
    return joined.select(*[F.col(r.name).alias(f.name) for f, r in zip(kept, renamed, strict=True)], "ids")


def decode(encoded: DataFrame, ranks: bytes, ids: str = "ids", digests: bool = False) -> DataFrame:
    """Adds decoded binary: the bytes of the ids, from a join with the token-byte table. With digests: instead n_tokens,
    ids_sha256 (decimal ids joined by one space) and decoded_sha256, so that the bytes needn't leave the task."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    keys = [c for c in encoded.columns if c != ids]
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField(ids, encoded.schema[ids].dataType), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([*key_schema(encoded, keys), *extra])
    arrow = arrow_schema(schema)

    def run(batches):
        pieces, numbers = _tables(shipped.value)
        for batch in batches:
            lists = batch.column(ids)
            out = []
            for i in range(batch.num_rows):
                values = lists[i].values
                found = np.zeros(0, dtype=np.int64) if values is None else values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                data = pieces.join(found)
                out.append((len(found), hashlib.sha256(numbers.join(found)[:-1]).hexdigest(), hashlib.sha256(data).hexdigest()) if digests else (data,))
            made = [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[-len(out[0]) :], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *([] if digests else [lists]), *made], schema=arrow)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers as public

    ranks = load_ranks(vocabulary or public.path("byte_bpe_50k.tiktoken"))
    return decode(encode(docs, ranks, public.PATTERN, keys=["doc_id"]), ranks, digests=True)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
