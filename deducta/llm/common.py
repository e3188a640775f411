"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import staged as staged

#: A word of a text: a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes of what df reads, as the planner knows them of its sources; joins don't inflate them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # more is the planner's mark for unknown


def buckets_for(df: DataFrame, mb: int = 16) -> int:
    """Number of hash buckets for what is gathered from df: one for each mb of what it reads, and the shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, input_bytes(df) // (mb << 20))


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def key_schema(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType, True) for k in keys]


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_PRESS, _OPEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the least width that holds them, one plane for each byte, compressed."""
    values = np.ascontiguousarray(values)
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + _PRESS.compress(raw)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(_OPEN.decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{width}")


def pack_bytes(data: bytes) -> bytes:
    return _PRESS.compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return _OPEN.decompress(data)


class Codes(dict):
    """Numbers its keys from 0 in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def word_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; seen remembers them for a task and is emptied when large."""
    import xxhash

    if len(seen) > 500_000:
        seen.clear()
    out = np.empty(len(words), dtype=np.uint64)
    get, digest = seen.get, xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = seen[w] = digest(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if n <= 8:
            for j in range(n):
                total = total * _MIX + hashes[j : j + m]
            return mix(total)
        # rolling polynomial: sum h[i] * M^i up to i, times the inverse of M^i, modulo 2^64 (M is odd)
        inverse = pow(int(_MIX), -1, 1 << 64)
        up = np.ones(len(hashes), dtype=np.uint64)
        up[1:] = _MIX
        up = np.multiply.accumulate(up)
        down = np.ones(m, dtype=np.uint64)
        down[1:] = np.uint64(inverse)
        down = np.multiply.accumulate(down)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(hashes * up)])
        total = (sums[n : n + m] - sums[:m]) * down
    return mix(total)


def pack_all(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_all(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : end]))
        at = end
    return out
