"""Bounded-space online best-fit packing of token documents into sequences.

A packer holds a fixed number of open sequences in stacks keyed by free space; a bitset has a bit for each free space
that some open sequence has. An item goes to the open sequence with the least free space that still holds it: the
lowest set bit at or above its length. If none holds it, a sequence is opened, and if too many are open then the
fullest closes first.

Packing needs only lengths. A document of at most the sequence's length is one item; a longer one is cut into full
pieces, which are sequences of their own, and a shorter first piece. Items are dealt to packers by a hash of the
document, so any number of packers work side by side, and what a packer leaves open is packed once more with what the
others left.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import stored, table, token_ids

#: Items that a packer is meant to get.
GROUP = 4096
OPEN = 256


class BestFit:
    """Online best-fit with at most `most` open bins of `size`.

    `add(length)` returns (bin number, offset in it). Bins are numbered in the order in which they are opened.
    """

    def __init__(self, size: int, most: int = OPEN):
        self.size, self.most = size, most
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.n_open, self.opened = 0, 0, 0

    def add(self, length: int) -> tuple[int, int]:
        if not 0 <= length <= self.size:
            raise ValueError(f"{length} is no length of at most {self.size}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.size, self.opened
            self.opened += 1
        if free > length:
            self.stacks[free - length].append(b)
            self.bits |= 1 << (free - length)
            self.n_open += 1
        return b, self.size - free

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def left(self) -> list[tuple[int, int]]:
        """(bin, free space) of the bins that are still open."""
        return [(b, free) for free, stack in enumerate(self.stacks) for b in stack]


PIECES = "doc_id BIGINT, copy BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def _pieces_of(batches: Iterable[pa.RecordBatch], size: int, end_id: int, path: str | None) -> Iterator[pa.RecordBatch]:
    encoder, end = token_ids(path), struct.pack("<I", end_id)
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("doc_id", "copy", "piece", "start", "length", "ids_crc32")}
        coded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
        for doc, copy, ids in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), coded, strict=True):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, v in (("doc_id", doc), ("copy", copy), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[4 * a : 4 * b]))):
                    cols[name].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in cols.items()})


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, copy, piece, start, length, ids_crc32. `copy` tells rows that repeat a doc_id apart."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return narrow.mapInArrow(lambda b: _pieces_of(b, size, end_id, tokenizer), PIECES)


def _packed(table_: pa.Table, size: int, most: int) -> pa.Table:
    """One group's items, in a fixed pseudo-random order, each with its bin, its offset and whether its bin stays open."""
    order = table_.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("copy", "ascending")])
    packer = BestFit(size, most)
    placed = [packer.add(n) for n in order.column("length").to_pylist()]
    free = dict(packer.left())
    return pa.table(
        {
            "group": order.column("group"),
            "doc_id": order.column("doc_id"),
            "copy": order.column("copy"),
            "bin": pa.array([b for b, _ in placed], pa.int64()),
            "offset": pa.array([o for _, o in placed], pa.int64()),
            "free": pa.array([free.get(b, 0) for b, _ in placed], pa.int64()),
        }
    )


def _merged(table_: pa.Table, size: int, most: int) -> pa.Table:
    """Open bins of several groups, each packed as one item of its filled length."""
    order = table_.sort_by([("filled", "descending"), ("group", "ascending"), ("bin", "ascending")])
    packer = BestFit(size, most)
    placed = [packer.add(n) for n in order.column("filled").to_pylist()]
    return pa.table(
        {
            "super": order.column("super"),
            "group": order.column("group"),
            "bin": order.column("bin"),
            "to_bin": pa.array([b for b, _ in placed], pa.int64()),
            "shift": pa.array([o for _, o in placed], pa.int64()),
        }
    )


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2, most: int = OPEN, tokenizer: str | None = None) -> DataFrame:
    """Pack `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Null texts are empty and hold only the end id. Rows that repeat a doc_id are packed each by themselves. A null
    doc_id stays null. Other columns are not read; an empty table packs to an empty table. The pieces are written once
    and packed from there, so a packer that is lost packs the same rows in the same order again.
    """
    all_pieces = stored(pieces(docs, size, end_id, tokenizer), "pieces")
    full = all_pieces.where(F.col("length") == size)
    short = all_pieces.where(F.col("length") < size)
    n_groups = max(1, -(-short.count() // GROUP))
    mix = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "copy")
    items = short.select("doc_id", "copy", "length", F.pmod(mix, F.lit(n_groups)).alias("group"), F.xxhash64(mix).alias("_order"))
    placed = stored(
        items.groupBy("group").applyInArrow(lambda t: _packed(t, size, most), "group BIGINT, doc_id BIGINT, copy BIGINT, bin BIGINT, offset BIGINT, free BIGINT"), "placed"
    )
    # what GROUP / 64 groups left open meets in one more packer: at most `most` bins of each
    left = placed.where(F.col("free") > 0).groupBy("group", "bin").agg((F.lit(size) - F.min("free")).alias("filled"))
    merged = left.withColumn("super", F.floor(F.col("group") / (GROUP // 64)).cast("long")).groupBy("super").applyInArrow(
        lambda t: _merged(t, size, most), "super BIGINT, group BIGINT, bin BIGINT, to_bin BIGINT, shift BIGINT"
    )
    # three kinds of sequences with numbers of their own: closed bins, merged bins, full pieces
    where = placed.join(merged, ["group", "bin"], "left").select(
        "doc_id",
        "copy",
        F.when(F.col("super").isNull(), F.shiftleft("group", 32) + F.col("bin")).otherwise(-1 - F.shiftleft("super", 32) - F.col("to_bin")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    joined = short.join(where.withColumnRenamed("doc_id", "_doc"), "copy").where(F.col("doc_id").eqNullSafe(F.col("_doc"))).select(*out)
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).alias("offset"), (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id")).select(*out)
    return joined.unionByName(whole.withColumn("offset", F.col("offset").cast("long")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing can take fewer sequences."""
    return int(-(-int(lengths.sum()) // size))
