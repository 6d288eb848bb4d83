"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a word in the middle: one at distance at most ceil(r / 2) from the
one and floor(r / 2) from the other. So every fingerprint emits all variants within half the radius, variants meet by
shuffle, and fingerprints that share a variant are verified.

The 2081 variants of a 64-bit fingerprint (r = 4) are not shuffled one by one. The shuffle is on a variant's leading
bits, its cell; a fingerprint goes to each cell that one of its variants lies in (79 cells of 12 bits), and the cell's
task makes the variants with that prefix, sorts them, and verifies runs of equal ones. Fingerprints of equal value are
one before all this. In a run, all are linked to the run's first, never all to all, and a cell returns at most one link
for each of its fingerprints.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import ascii_lower_bytes, stored, stored_rows, table

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Near copies by Jaccard similarity: this ratio or more. Texts have SKETCH fingerprints, whose bits are cut into TABLES
#: blocks of BLOCK bits that meet at two bits or fewer; at a similarity of 0.8 a bit differs with chance 0.151, so a pair
#: meets with chance 0.988. Two more words, in at most CHECKED of 128 bits, keep chance meetings out.
SIMILAR, SKETCH, BLOCK, TABLES, CHECKED = (4, 5), 12, 28, 22, 46
#: A cluster of more texts is compared with one of its texts after another, in parts of about as many, before the rest of it
#: comes to one task; so many rounds at most.
TOGETHER, PIVOTS = 2000, 8
#: Longer runs of equal blocks are one set of block_meetings without a look at their pairs.
RUN = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of its shingles' XXH64 (seed 42); 0 for no words."""
    words = _WORDS.findall(ascii_lower_bytes((text or "").encode()))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_digest(line, SEED)]
    else:
        starts = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
        digest = xxhash.xxh64_digest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a number that tells repeated rows apart) and fp (the fingerprint as a signed long) of each row of `docs`."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fp": pa.array(fps, pa.int64())})

    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id BIGINT, row BIGINT, fp BIGINT")


def flips(bits: range, most: int) -> list[np.ndarray]:
    """For each number of flipped bits 0..most, the masks over `bits`."""
    return [np.array([sum(1 << b for b in c) for c in combinations(bits, k)], dtype=np.uint64) for k in range(most + 1)]


def cell_bits(n: int, ball: int) -> int:
    """Leading bits of a variant that name its cell: cells of about a million variants."""
    variants = n * sum(math.comb(BITS, k) for k in range(ball + 1))
    return max(4, min(24, math.ceil(math.log2(max(2, variants / 1_000_000)))))


def _cells_of(batches: Iterable[pa.RecordBatch], lead: int, ball: int) -> Iterator[pa.RecordBatch]:
    masks = np.concatenate(flips(range(BITS - lead, BITS), ball))
    for batch in batches:
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            cells = ((part[:, None] ^ masks) >> np.uint64(BITS - lead)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.ravel()), "fp": pa.array(np.repeat(part, len(masks)).view(np.int64))})


class _Sets:
    """Union-find over positions; the root of a set is its smallest."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _tagged(variants: np.ndarray, source: np.ndarray, index_bits: int) -> np.ndarray:
    """One sortable word for each variant: a hash of it above, the position of its fingerprint below."""
    return ((variants * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64((1 << index_bits) - 1)) | source


def cell_links(cell: int, fps: np.ndarray, lead: int, ball: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints of one cell: (fingerprint, the smallest that this cell links it to)."""
    fps = np.unique(fps)
    n, low = len(fps), BITS - lead
    index_bits = max(1, (n - 1).bit_length())
    ahead = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(cell))
    tail = fps & np.uint64((1 << low) - 1)
    masks = flips(range(low), ball)
    words = []
    for k in range(ball + 1):
        at = np.flatnonzero(ahead == k).astype(np.uint64)
        if len(at):
            near = np.concatenate(masks[: ball - k + 1])
            words.append(_tagged(tail[at][:, None] ^ near, at[:, None], index_bits).ravel())
    word = np.concatenate(words)
    del words
    word.sort()
    where = np.uint64((1 << index_bits) - 1)
    same = np.flatnonzero((word[1:] ^ word[:-1]) <= where)
    if not len(same):
        return fps[:0], fps[:0]
    # runs of equal hashes: [start, end]
    new = np.flatnonzero(np.diff(same, prepend=-2) > 1)
    starts, ends = same[new], same[np.append(new[1:] - 1, len(same) - 1)] + 1
    sizes = ends - starts + 1
    first = np.repeat((word[starts] & where).astype(np.int64), sizes - 1)
    others = (word[same + 1] & where).astype(np.int64)
    true = np.bitwise_count(fps[first] ^ fps[others]) <= radius
    sets = _Sets(n)
    pairs = np.unique(np.stack([first, others])[:, true & (first != others)], axis=1)
    for a, b in pairs.T.tolist():
        sets.join(a, b)
    # runs in which hashes of different variants met: each member against each
    if not true.all():
        run = np.repeat(np.arange(len(starts)), sizes - 1)
        for r in np.unique(run[~true]).tolist():
            members = np.unique(word[starts[r] : ends[r] + 1] & where).astype(np.int64)
            for a in members.tolist():
                for b in members[np.bitwise_count(fps[members] ^ fps[a]) <= radius].tolist():
                    sets.join(a, b)
    root = np.fromiter((sets.root(i) for i in range(n)), np.int64, n)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links between distinct fingerprints (`distinct`: fp) at `radius` or fewer differing bits, as pairs (a, b).

    Not each pair is a row: pairs that are joined by way of a third in the same cell may be left out, so the connected
    components are those of all pairs.
    """
    ball = (radius + 1) // 2
    lead = cell_bits(n, ball)

    def joined(t: pa.Table) -> pa.Table:
        a, b = cell_links(t.column("cell")[0].as_py(), t.column("fp").to_numpy().view(np.uint64), lead, ball, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    cells = distinct.select("fp").mapInArrow(lambda x: _cells_of(x, lead, ball), "cell BIGINT, fp BIGINT")
    return cells.groupBy("cell").applyInArrow(joined, "a BIGINT, b BIGINT").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 64) -> DataFrame:
    """Connected components of `edges` (a, b): node and root, the smallest node of its component.

    Alternates two star operations until nothing changes: each node's larger neighbours are tied to the smallest in its
    neighbourhood, then its smaller ones. The number of rounds grows with the logarithm of the longest path; each
    round's edges are at most as many as the last's and are written to the shared folder.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        current = stored(small, name)
        # stars only: a fixed point has as many edges and the same sum of hashes as the round before
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """For each fingerprint of the stored table `fps`: fp, n_rows, root (its component's), least (the smallest of its rows)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = stored(fps.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n_rows")), "simhash-groups")
    roots = components(links(groups, groups.count(), radius), "simhash-components")
    return groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of `docs` (doc_id, text).

    component_id is the smallest doc_id that is reachable by links between fingerprints at `radius` or fewer bits. Null
    and empty texts have fingerprint 0 and are linked like any other. Null doc_ids are linked but never smallest, unless
    there is no other. Repeated rows are rows of one fingerprint. Columns other than these two are not read.
    """
    fps = stored(fingerprints(docs, shingle), "simhash")
    classes = _classes(fps, radius)
    smallest = classes.groupBy("root").agg(F.min("least").alias("_least"))
    named = stored(classes.join(smallest, "root").select("fp", "n_rows", F.col("_least.doc_id").alias("component_id")), "simhash-classes")
    return _assign(fps, named, fps.count())


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's shingles, sorted; a text shorter than a shingle is one, no words are none."""
    words = _WORDS.findall(ascii_lower_bytes((text or "").encode()))
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH independent fingerprints of a set of shingles, a word each."""
    ones = np.zeros(SKETCH * BITS, np.int64)
    salt = np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] + salt
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        # at most 255 rows, so that a byte holds a sum
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _sketched(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, words = [], []
        for t in batch.column("text").to_pylist():
            h = shingle_hashes(t, shingle)
            keys.append(xxhash.xxh3_128_digest(h.tobytes()))
            words.append(sketch(h).tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "key": pa.array(keys, pa.binary()), "sketch": pa.array(words, pa.binary())})


_CELL_ROWS = "cell BIGINT, node BIGINT, block BIGINT, c0 BIGINT, c1 BIGINT"


def _block_cells(batches: Iterable[pa.RecordBatch], lead: int) -> Iterator[pa.RecordBatch]:
    masks = np.array([0, *[1 << k for k in range(lead)]], np.int64)
    weights = 1 << np.arange(BLOCK, dtype=np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH)
            bits = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
            fixed = [np.repeat(x, len(masks)) for x in (batch.column("node").to_numpy(), raw[:, -2].view(np.int64), raw[:, -1].view(np.int64))]
            for t in range(TABLES):
                block = bits[:, t * BLOCK : (t + 1) * BLOCK].astype(np.int64) @ weights
                cell = (np.int64(t) << lead) | ((block[:, None] >> (BLOCK - lead)) ^ masks)
                cols = (cell.ravel(), fixed[0], np.repeat(block, len(masks)), fixed[1], fixed[2])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["cell", "node", "block", "c0", "c1"])


def _checked(c0: np.ndarray, c1: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    # counted as unsigned: of a negative number the bits of its absolute value are counted
    apart = [np.bitwise_count((c[x] ^ c[y]).view(np.uint64)).astype(np.int64) for c in (c0, c1)]
    return apart[0] + apart[1] <= CHECKED


def block_meetings(cell: int, node: np.ndarray, block: np.ndarray, c0: np.ndarray, c1: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of one cell put into sets by blocks that differ in two bits or fewer: (node, one node of its set), a row for each other node."""
    # the smallest node of a set names it, so that cells mostly name a set alike
    order = np.argsort(node)
    node, block, c0, c1 = node[order], block[order], c0[order], c1[order]
    low = BLOCK - lead
    tail, ahead = block & ((1 << low) - 1), np.bitwise_count((block >> low) ^ (cell & ((1 << lead) - 1)))
    own, other = np.flatnonzero(ahead == 0), np.flatnonzero(ahead == 1)
    near = np.array([0, *[1 << k for k in range(low)]], np.int64)
    word = np.concatenate([(((tail[own][:, None] ^ near) << 32) | own[:, None]).ravel(), (tail[other] << 32) | other])
    word.sort()
    at, begin = word & 0xFFFFFFFF, np.flatnonzero(np.diff(word >> 32, prepend=-1))
    size = np.diff(begin, append=len(word))
    place = np.arange(len(word)) - np.repeat(begin, size)
    size = np.repeat(size, size)
    sets = _Sets(len(node))
    roots = np.arange(len(node))

    def join(x: np.ndarray, y: np.ndarray) -> None:
        apart = roots[x] != roots[y]
        if apart.any():
            for i, j in np.unique(np.stack([x[apart], y[apart]]), axis=1).T.tolist():
                sets.join(i, j)
            touched = np.flatnonzero(np.asarray(sets.parent) != np.arange(len(node)))
            roots[touched] = [sets.root(i) for i in touched.tolist()]

    # members of a long run are one set; in others each is tried with each before it, unless they are joined already
    long = np.flatnonzero((size > RUN) & (place > 0))
    join(at[long - place[long]], at[long])
    todo = np.flatnonzero((size <= RUN) & (place > 0))
    for step in range(1, RUN):
        todo = todo[place[todo] >= step]
        if not len(todo):
            break
        x, y = at[todo - step], at[todo]
        ok = (roots[x] != roots[y]) & _checked(c0, c1, x, y)
        join(x[ok], y[ok])
    linked = np.flatnonzero(roots != np.arange(len(node)))
    return node[linked], node[roots[linked]]


def jaccard_roots(sets: list[np.ndarray]) -> list[int]:
    """For each set of shingles the first place of its component by SIMILAR pairs.

    A search from one set to all that are similar to it, and on from those; it looks only at sets that no component has
    yet. Sets that found theirs leave the index once half of it is such, so many copies of one text cost one look each.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    parts, n_codes = np.split(code, np.cumsum(sizes)[:-1]), int(code.max(initial=-1)) + 1
    root, free = np.full(n, -1), np.ones(n, bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        ok = free[owner]
        order = np.argsort(code[ok], kind="stable")
        return owner[ok][order], np.searchsorted(code[ok][order], np.arange(n_codes + 1))

    (holders, begin), indexed, left = index(), n, n
    for first in range(n):
        if not free[first]:
            continue
        free[first], root[first], todo = False, first, [first]
        left -= 1
        while todo and left:
            if 2 * left < indexed:
                (holders, begin), indexed = index(), left
            i = todo.pop()
            mine = parts[i]
            both = np.bincount(np.concatenate([holders[begin[c] : begin[c + 1]] for c in mine]), minlength=n) if len(mine) else np.zeros(n, np.int64)
            near = np.flatnonzero(free & (both * SIMILAR[1] >= SIMILAR[0] * (sizes + sizes[i] - both)))
            free[near], root[near] = False, first
            left -= len(near)
            todo += near.tolist()
    return root.tolist()


def _from_pivots(members: DataFrame, texts: DataFrame, shingle: int) -> tuple[DataFrame | None, DataFrame]:
    """Links of large clusters to single texts of theirs (None without large ones), and what is left to compare:
    (cluster, a, b), (cluster, node).

    A round compares all of a cluster with its smallest text that has no link yet, the pivot, in parts that keep a task
    small. By the triangle inequality of Jaccard distance a text without a link can only be similar to texts that lie at
    most 1 - SIMILAR nearer to the pivot than the nearest such text: all others are done with. So many copies of one text
    are gone after a round, and no link is lost.
    """
    most = 1 - SIMILAR[0] / SIMILAR[1]

    def compared(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(shingle_hashes(r["text"], shingle) for r in rows if r["is_pivot"])
        out = []
        for r in rows:
            if not r["is_pivot"]:
                mine = shingle_hashes(r["text"], shingle)
                both = len(np.intersect1d(own, mine, assume_unique=True))
                either = len(own) + len(mine) - both
                out.append((r["cluster"], r["node"], r["pivot"], r["linked"], both * SIMILAR[1] >= SIMILAR[0] * either, 1 - both / either if either else 0.0))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64())
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(c, y) for c, y in zip(columns, types, strict=True)], names=["cluster", "node", "pivot", "linked", "near", "far"])

    known, rest = [], []
    members = members.withColumn("linked", F.lit(False))
    for _ in range(PIVOTS):
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(~F.col("linked"), F.col("node"))).alias("pivot"))
        sized = stored(members.join(sizes, "cluster"), "similar-sized")
        rest.append(sized.where(F.col("size") <= TOGETHER).select("cluster", "node"))
        large = sized.where(F.col("size") > TOGETHER).withColumn("parts", F.ceil(F.col("size") / TOGETHER).cast("long"))
        if large.isEmpty():
            return _union_of(known), _union_of(rest)
        rows = large.select("cluster", "node", "pivot", "linked", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(False).alias("is_pivot")).where("node <> pivot")
        pivots = large.where("node = pivot").select("cluster", "node", "pivot", "linked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_pivot"))
        told = rows.unionByName(pivots).join(texts, F.col("node") == F.col("row")).select("cluster", "part", "node", "pivot", "linked", "is_pivot", "text")
        seen = stored(told.groupBy("cluster", "part").applyInArrow(compared, "cluster BIGINT, node BIGINT, pivot BIGINT, linked BOOLEAN, near BOOLEAN, far DOUBLE"), "similar-compared")
        known.append(seen.where("near").select("cluster", F.col("node").alias("a"), F.col("pivot").alias("b")))
        # texts without any link, and those that may yet be similar to one
        nearest = seen.where("not near and not linked").groupBy("cluster").agg(F.min("far").alias("_nearest"))
        members = stored(seen.join(nearest, "cluster").where((~F.col("near") & ~F.col("linked")) | (F.col("far") >= F.col("_nearest") - most - 1e-9)).select("cluster", "node", (F.col("near") | F.col("linked")).alias("linked")), "similar-members")
    rest.append(members.select("cluster", "node"))
    return _union_of(known), _union_of(rest)


def _union_of(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


def similar_components(groups: DataFrame, texts: DataFrame, n: int, shingle: int) -> DataFrame:
    """Components (node, root) of pairs with a Jaccard similarity of SIMILAR or more.

    `groups`: node and sketch, one for each distinct set of shingles; `texts`: row (a node) and text. Blocks of the
    sketch meet by ball hashing at two bits, and what meets is one cluster. Large clusters are first compared with single
    texts of theirs; what is left of a cluster comes together, and there pairs are tried on their sets of shingles, so no
    row is made for a pair.
    """
    lead = max(3, min(16, math.ceil(math.log2(max(2, n * (BLOCK + 1) / 1_000_000)))))

    def met(t: pa.Table) -> pa.Table:
        a, b = block_meetings(t.column("cell")[0].as_py(), *(t.column(c).to_numpy() for c in ("node", "block", "c0", "c1")), lead)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def alike(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cluster", "ascending"), ("node", "ascending")])
        cluster, node, text = t.column("cluster").to_numpy(), t.column("node").to_numpy(), t.column("text")
        roots = np.zeros(len(node), np.int64)
        for at in np.split(np.arange(len(node)), np.flatnonzero(np.diff(cluster)) + 1):
            roots[at] = node[at][jaccard_roots([shingle_hashes(x.as_py(), shingle) for x in text.slice(at[0], len(at))])]
        return pa.table({"cluster": pa.array(cluster, pa.int64()), "node": pa.array(node, pa.int64()), "root": pa.array(roots, pa.int64())})

    cells = groups.select("node", "sketch").mapInArrow(lambda x: _block_cells(x, lead), _CELL_ROWS)
    clusters = components(cells.groupBy("cell").applyInArrow(met, "a BIGINT, b BIGINT"), "similar-clusters")
    members = clusters.select("node", F.col("root").alias("cluster")).union(clusters.select("root", "root")).distinct().select("cluster", "node")
    known, rest = _from_pivots(members, texts, shingle)
    # clusters are dealt in lots, so that a task is called for many at once; their number follows that of their texts
    rest, n_rest = stored_rows(rest, "similar-rest")
    whole = rest.join(texts, F.col("node") == F.col("row")).select("cluster", "node", "text")
    lots = max(256, n_rest // TOGETHER)
    found = whole.withColumn("lot", F.pmod(F.xxhash64("cluster"), F.lit(lots))).groupBy("lot").applyInArrow(alike, "cluster BIGINT, node BIGINT, root BIGINT")
    if known is None:
        return found.select("node", "root")
    # only where a cluster was large do its parts have to be put together again
    found = stored(found, "similar-found")
    large = known.select("cluster").distinct()
    parts = found.join(large, "cluster", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(known.select("a", "b"))
    return found.join(large, "cluster", "left_anti").select("node", "root").unionByName(components(parts, "similar-components"))


def keep_one(docs: DataFrame, shingle: int) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: of each component of similar texts the one with the smallest doc_id.

    Two texts are similar if their sets of `shingle`-word shingles have a Jaccard similarity of SIMILAR or more. Null
    and empty texts are equal.
    """
    keyed = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "simhash-rows")
    texts = keyed.select(F.col("_row").alias("row"), F.col("_doc.text").cast("string").alias("text"))
    narrow = keyed.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), F.col("_doc.text").cast("string").alias("text"))
    sketches = narrow.mapInArrow(lambda x: _sketched(x, shingle), "doc_id BIGINT, row BIGINT, key BINARY, sketch BINARY")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = stored(sketches.groupBy("key").agg(F.min(order).alias("least"), F.first("sketch").alias("sketch")).select("least", F.col("least.row").alias("node"), "sketch"), "similar-groups")
    roots = similar_components(groups, texts, groups.count(), shingle)
    kept = groups.join(roots, "node", "left").groupBy(F.coalesce("root", groups["node"]).alias("root")).agg(F.min("least").alias("_least"))
    return keyed.join(stored(kept.select(F.col("_least.row").alias("_kept")), "simhash-kept"), F.col("_row") == F.col("_kept"), "left_semi").select("_doc.*")


def _assign(fps: DataFrame, named: DataFrame, n_rows: int, share: float = 1 / 4096) -> DataFrame:
    """Give rows their fingerprint's class. Fingerprints with over `share` of the rows, at most 1 / share, are broadcast."""
    limit = max(64, int(n_rows * share))
    heavy = F.broadcast(named.where(F.col("n_rows") > limit).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_class"), F.lit(True).alias("_is")))
    marked = fps.join(heavy, F.col("fp") == F.col("_fp"), "left")
    taken = marked.where(F.col("_is")).select("doc_id", "fp", F.col("_class").alias("component_id"))
    rest = marked.where(F.col("_is").isNull()).select("doc_id", "fp").join(named.where(F.col("n_rows") <= limit).select("fp", "component_id"), "fp")
    return taken.unionByName(rest.select("doc_id", "fp", "component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
