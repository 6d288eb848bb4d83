"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds a run of documents in ascending doc_id order: their ids concatenated (16 bits each where the vocabulary
allows, else 32) and two non-decreasing sequences, document boundaries and doc_ids, in Elias-Fano form. An Elias-Fano
sequence of n values up to u takes n * (2 + ceil(log2(u / n))) bits: the low bits packed, the high bits as a unary bit
vector. A directory of every `STEP`-th one's place, 32 bits each, stands in the file too: n / 8 bits. `EliasFano.select`
finds the i-th value from one entry and a count of ones from there, so an offset is read without a table of offsets.

Shards lie in Parquet files as a binary column, so any store that Spark writes can hold them and a lost task's shard is
written again by Spark's own commit. `shard` alone is a complete file: `parse` reads its bytes from anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import scratch_path, table, token_ids

MAGIC = b"FFTOK2\x00\x00"
#: A shard is closed when it has this many ids or documents.
SHARD_IDS, SHARD_DOCS = 2_000_000, 50_000
#: Documents that a range partition is meant to hold at most, where the shuffle setting gives fewer partitions.
PART_DOCS = 20_000
#: Ones of the high bit vector between two entries of the select directory.
STEP = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        #: The bit that each STEP-th one is.
        self.directory = directory
        self._bits = memoryview(high)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        high_bits = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        if len(high_bits) >= 1 << 32:
            raise ValueError("too many values for a directory of 32-bit places")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high_bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(high_bits, bitorder="little"), ones[::STEP].astype("<u4"))

    def _low_at(self, i: int) -> int:
        if not self.low_bits:
            return 0
        bit = i * self.low_bits
        chunk = self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3].tobytes()
        return (int.from_bytes(chunk, "little") >> (bit & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from one directory entry on, ones are counted eight bytes at a time."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        entry, left = divmod(i, STEP)
        place = int(self.directory[entry])
        byte = place >> 3
        word = int.from_bytes(self._bits[byte : byte + 8], "little") >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self._bits[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low_at(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.universe, self.low_bits, len(self.low), len(self.high)) + self.directory.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, low_bits, a, b = struct.unpack_from("<QQQQQ", raw, at)
        at += 40
        entries = -(-n // STEP)
        directory = np.frombuffer(raw, "<u4", entries, at)
        at += 4 * entries
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, universe, low_bits, low, high, directory), at + a + b


def shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one shard. doc_ids ascend, nulls first; ids: each document's ids as little-endian 32-bit integers."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([0, *[len(b) // 4 for b in ids]])
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    body = flat.astype(f"<u{width}").tobytes()
    head = MAGIC + struct.pack("<QqIIQ", nulls, least, width, len(doc_ids), len(body))
    offsets = (known.astype(object) - least).astype(np.uint64) if len(known) else np.zeros(0, np.uint64)
    return head + EliasFano.of(ends).to_bytes() + EliasFano.of(offsets).to_bytes() + body


class Shard:
    """A parsed shard: `doc_id(i)`, `bounds(i)` and `ids(i)` of its i-th document, found by select."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.nulls, self.least, self.width, self.n_docs, size = struct.unpack_from("<QqIIQ", raw, 8)
        self.ends, at = EliasFano.from_bytes(raw, 40)
        self.keys, at = EliasFano.from_bytes(raw, at)
        self.flat = np.frombuffer(raw, f"<u{self.width}", size // self.width, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i), self.ends.select(i + 1)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.flat[start:end]


SHARDS = "part INT, shard INT, n_ids BIGINT, payload BINARY"


def _shards_of(batches: Iterable[pa.RecordBatch], end_id: int, path: str | None) -> Iterator[pa.RecordBatch]:
    """Shards of one sorted partition. A shard's number is its place in the partition."""
    from pyspark import TaskContext

    encoder, part, number = token_ids(path), TaskContext.get().partitionId(), 0
    end = struct.pack("<I", end_id)
    docs: list[int | None] = []
    ids: list[bytes] = []
    held = 0

    def closed():
        return pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([shard(docs, ids)], pa.binary())}
        )

    for batch in batches:
        texts = batch.column("text").to_pylist()
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            coded = encoder.encode([text or ""])[0] + end
            docs.append(doc)
            ids.append(coded)
            held += len(coded) // 4
            if held >= SHARD_IDS or len(docs) >= SHARD_DOCS:
                yield closed()
                docs, ids, held, number = [], [], 0, number + 1
    if docs:
        yield closed()


def write(docs: DataFrame, location: str, end_id: int = 0, tokenizer: str | None = None) -> None:
    """Encode `docs` (doc_id, text) and write shards in ascending doc_id order to `location`.

    Documents are range-partitioned by doc_id; within a partition they are sorted and cut into shards of bounded size.
    Null texts are empty and still get the end id. Null doc_ids come first. Rows that repeat a doc_id stay, in the order
    of their text's hash. Other columns are not read. An empty table writes an empty directory of Parquet files.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // PART_DOCS))
    # the range's second key splits ids that many rows share
    dealt = narrow.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(lambda b: _shards_of(b, end_id, tokenizer), SHARDS).write.parquet(location)


READ = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"


def _read_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, base in zip(batch.column("payload"), batch.column("base").to_pylist(), strict=True):
            s = Shard(payload.as_py())
            bounds = [s.ends.select(i) for i in range(s.n_docs + 1)]
            flat = s.flat.astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([s.doc_id(i) for i in range(s.n_docs)], pa.int64()),
                    "start": pa.array([base + a for a in bounds[:-1]], pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64()),
                }
            )


def read(spark: SparkSession, location: str) -> DataFrame:
    """Every document of the shards at `location`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard's start is a sum over the sizes of those before it: sums within the parts first, then over one row per part.
    """
    shards = spark.read.schema(SHARDS).parquet(location)
    sizes = shards.select("part", "shard", "n_ids")
    from pyspark.sql import Window

    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_total"))
    # one row per range partition: their number is the shuffle's, not the data's
    before = parts.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_before"))
    within = sizes.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("_within"))
    bases = within.join(before, "part").select("part", "shard", (F.col("_before") + F.col("_within")).alias("base"))
    return shards.join(bases, ["part", "shard"]).select("base", "payload").mapInArrow(_read_shards, READ)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = scratch_path(spark, "token-shards")
    write(table(spark, sf_dir, "documents"), location)
    return read(spark, location)
