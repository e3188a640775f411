"""Sharding: Hilbert-curve ordering of several metadata dimensions, cut into runs.

Each dimension is quantised to a few bits; a row's place on the Hilbert curve through those cells orders the table, so
that rows of one shard are near each other in every dimension and files can be pruned by any of them. Ties on the
curve are broken by the key, so one crowded cell is cut across partitions and shards like any other run. The law is
`rows`: counts of shards differ by one at most.

Defined results: null dimensions are cell 0, a null text has size 8 and checksum 0; repeated rows take a slot each, in
any order among themselves; an empty table gives an empty one; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARDS = 24


def hilbert_states(dims: int) -> tuple[list[int], list[int]]:
    """For state (entry corner, direction) and the bits of one level: the curve's digit, and the next state."""
    size, mask = 1 << dims, (1 << dims) - 1
    rotate = lambda x, k: (x >> k % dims | x << (dims - k % dims)) & mask  # noqa: E731  to the right
    gray = lambda i: i ^ i >> 1
    back = {gray(i): i for i in range(size)}
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  ones at the end of i
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    along = lambda i: 0 if i == 0 else trailing(i - 1) % dims if i % 2 == 0 else trailing(i) % dims
    digits, states = [], []
    for e in range(size):
        for d in range(dims):
            for bits in range(size):
                w = back[rotate(bits ^ e, d + 1)]
                digits.append(w)
                left = rotate(entry(w), dims - (d + 1) % dims)
                states.append((e ^ left) * dims + (d + along(w) + 1) % dims)
    return digits, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The place of a cell on the curve: `bits` levels, a table look-up each."""
    dims = len(cells)
    digits, states = hilbert_states(dims)
    level = lambda k: sum((F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1)) * F.lit(1 << (dims - 1 - i)) for i, c in enumerate(cells)), F.lit(0))
    digit_of, state_of = F.array(*map(F.lit, digits)), F.array(*map(F.lit, states))
    levels = F.array(*[level(k).cast("int") for k in reversed(range(bits))])

    def step(acc, x):
        at = acc["state"] * F.lit(1 << dims) + x
        return F.struct((acc["h"] * F.lit(1 << dims) + F.get(digit_of, at)).alias("h"), F.get(state_of, at).alias("state"))

    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state")), step, lambda acc: acc["h"])


def log_cell(value: Column, bits: int, steps_per_octave: int = 8) -> Column:
    """Quantises a count by its logarithm."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(1)).cast("double")) * steps_per_octave)).cast("int")


def hash_cell(value: Column, bits: int) -> Column:
    """Quantises a category by its checksum; equal values share a cell."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(1 << bits))).cast("int")


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, str, str]:
    """df, staged in order, with its row's rank from 0 and the number of rows; no task holds more than a range of it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = staged(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "hilbert")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").count()
    all_parts = Window.orderBy("__part")  # a row for each partition of the range exchange
    offsets = counts.select("__part", (F.sum("count").over(all_parts) - F.col("count")).alias("__before"), F.sum("count").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__rows"))
    joined = placed.join(F.broadcast(offsets), "__part")  # at most n rows are sent
    return joined.withColumn("__rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before"), "__rank", "__rows"


def shard(df: DataFrame, cells: dict[str, Column], bits: int, key: list[str], shards: int = SHARDS) -> DataFrame:
    """Adds hilbert long, shard int and slot long. cells: the quantised dimensions; key breaks ties."""
    base = df.drop("hilbert", "shard", "slot").withColumn("hilbert", hilbert_index(list(cells.values()), bits))
    out, rank, rows = ranked(base, ["hilbert", *key])
    cut = F.expr(f"{rank} * {shards} div {rows}")
    return out.withColumn("shard", cut.cast("int")).withColumn("slot", F.expr(f"{rank} - (shard * {rows} + {shards - 1}) div {shards}")).drop(rank, rows)


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "lang", "source")
    cells = {"size": log_cell(F.col("size"), 8), "lang": hash_cell(F.col("lang"), 8), "source": hash_cell(F.col("source"), 8)}
    out = shard(rows, cells, 8, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
