"""Cropped and edited image copies by local descriptors.

1. Corners: on each level of a pyramid the maxima of the smaller structure-tensor response; the level's strongest
   `KEYPOINTS`.
2. Each corner is oriented by the intensity centroid of its patch (`RADIUS`); 256 comparisons of smoothed pixels, turned
   by that angle, make a binary descriptor. They reach out to `WIDE`: corners look alike, what surrounds them does not.
3. Hamming tables: a descriptor goes to `TABLES` tables, in each by `KEY_BITS` of its bits; all descriptors that meet in
   a cell are compared, and linked at `NEAR` or fewer differing bits.
4. Geometric consensus: the matches of two images each propose a turn, a scale and a shift; the images are copies if at
   least `INLIERS` matches agree with one proposal, and if their pixels, laid over each other by the transform that fits
   these matches, correlate by `LIKE` or more: plain corners agree by chance in one pair of images in a thousand.

Steps 3 and 4 go by pairs of blocks of images: descriptors that met by chance never leave a task.

Images of equal pixels are one image before all this; `members` names that image for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm import exact_dedup
from factflow.llm.common import slices, stored, table

SIDE, KEYPOINTS, LEVELS, RADIUS, WIDE = 64, 24, 2, 7, 16
BITS, TABLES, KEY_BITS, NEAR, INLIERS, TOLERANCE = 256, 32, 24, 56, 4, 3.0


def _pattern() -> tuple[np.ndarray, np.ndarray]:
    """The comparisons: 256 pairs of offsets around the corner, and for each table the bits that make its key."""
    rng = np.random.default_rng(1)
    pairs = np.clip(rng.normal(0, WIDE / 2, (BITS, 2, 2)), -WIDE + 1, WIDE - 1)
    return pairs, np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(TABLES)])


PAIRS, KEYS = _pattern()
#: Least correlation of the pixels of copies.
LIKE = 0.7
#: Images to a block at least (at most 8 times as many), and meetings of descriptors that are compared at a time.
BLOCK, MEETINGS = 2048, 1 << 22


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2 r + 1 (edges repeated) of the last two axes."""
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(r + 1, r), (r + 1, r)], mode="edge").cumsum(-1, dtype=np.float64).cumsum(-2)
    n = 2 * r + 1
    return ((p[..., n:, n:] - p[..., :-n, n:] - p[..., n:, :-n] + p[..., :-n, :-n]) / (n * n)).astype(np.float32)


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keypoints of a stack of grey images (n, h, w): image number, (x, y, scale, angle), and packed descriptors."""
    n, found = len(images), []
    level = images.astype(np.float32)
    for k in range(LEVELS):
        h, w = level.shape[1:]
        if min(h, w) < 2 * RADIUS + 6:
            break
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = (a + b) / 2 - np.sqrt(((a - b) / 2) ** 2 + c * c)
        m = RADIUS + 1
        inner = response[:, m:-m, m:-m]
        top = np.max([response[:, m + dy : h - m + dy, m + dx : w - m + dx] for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)], axis=0)
        at, y, x = np.nonzero((inner >= top) & (inner > 4.0))
        found.append((np.full(len(at), k), at, y + m, x + m, inner[at, y, x]))
        if k == 0:
            levels = []
        levels.append(smooth)
        h2, w2 = h // 2 * 2, w // 2 * 2
        level = level[:, :h2, :w2].reshape(n, h2 // 2, 2, w2 // 2, 2).mean(axis=(2, 4))
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    lev, at, y, x, strength = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((-strength, lev, at))
    lev, at, y, x = lev[order], at[order], y[order], x[order]
    own = at * LEVELS + lev
    chosen = np.arange(len(at)) - np.searchsorted(own, own) < KEYPOINTS
    lev, at, y, x = lev[chosen], at[chosen], y[chosen], x[chosen]
    grid = np.arange(-RADIUS, RADIUS + 1)
    disc = (grid[:, None] ** 2 + grid[None] ** 2 <= RADIUS**2).astype(np.float32)
    points, codes = np.zeros((len(at), 4), np.float32), np.zeros((len(at), BITS // 8), np.uint8)
    for k, image in enumerate(levels):
        for i in np.array_split(np.flatnonzero(lev == k), max(1, (lev == k).sum() // 4096)):
            if not len(i):
                continue
            patch = image[at[i, None, None], y[i, None, None] + grid[:, None], x[i, None, None] + grid] * disc
            angle = np.arctan2((patch * grid[:, None]).sum(axis=(1, 2)), (patch * grid).sum(axis=(1, 2)))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.rint(PAIRS[..., 0] * cos - PAIRS[..., 1] * sin).astype(np.int64) + x[i, None, None]
            py = np.rint(PAIRS[..., 0] * sin + PAIRS[..., 1] * cos).astype(np.int64) + y[i, None, None]
            v = image[at[i, None, None], np.clip(py, 0, image.shape[1] - 1), np.clip(px, 0, image.shape[2] - 1)]
            codes[i] = np.packbits(v[..., 0] < v[..., 1], axis=1)
            points[i] = np.stack([(x[i] + 0.5) * 2**k - 0.5, (y[i] + 0.5) * 2**k - 0.5, np.full(len(i), 2.0**k), angle], axis=1)
    return at, points, codes


FEATURES = "media_id BIGINT, point INT, x FLOAT, y FLOAT, scale FLOAT, angle FLOAT, code BINARY"
MEDIA = "media_id BIGINT, height INT, width INT, pixels BINARY"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_shape: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for m, h, w, p in zip(*(batch.column(c).to_pylist() for c in ("media_id", "height", "width", "pixels")), strict=True):
            # rows without an image of the size they state have no features
            if p is not None and h and w and len(p) == h * w:
                by_shape.setdefault((h, w), []).append((m, p))
        for (h, w), rows in by_shape.items():
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                at, points, codes = describe(np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for _, p in part]))
                number = np.arange(len(at)) - np.searchsorted(at, at)
                cols = {c: pa.array(points[:, j], pa.float32()) for j, c in enumerate(("x", "y", "scale", "angle"))}
                ids = np.array([m for m, _ in part], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"media_id": pa.array(ids[at]), "point": pa.array(number, pa.int32()), **cols, "code": pa.array([c.tobytes() for c in codes], pa.binary())})


def consensus(p: np.ndarray, q: np.ndarray) -> int:
    """Most matches that agree with one match's similarity transform from p to q (x, y, scale, angle each).

    Matches count by distinct places on both sides.
    """
    return fitted(p, q)[0]


def fitted(p: np.ndarray, q: np.ndarray) -> tuple[int, complex, complex]:
    """`consensus`, and the turn m and shift z of the transform that fits these matches: x + iy goes to m (x + iy) + z."""
    turn, grow = q[:, 3] - p[:, 3], q[:, 2] / p[:, 2]
    # a row for each proposal, a column for each match
    c, s = (grow * np.cos(turn))[:, None], (grow * np.sin(turn))[:, None]
    dx, dy = p[:, 0] - p[:, :1], p[:, 1] - p[:, 1:2]
    ok = np.hypot(q[:, :1] + c * dx - s * dy - q[:, 0], q[:, 1:2] + s * dx + c * dy - q[:, 1]) <= TOLERANCE * np.maximum(1.0, grow)[:, None]
    ok &= np.abs((turn - turn[:, None] + math.pi) % (2 * math.pi) - math.pi) < 0.5
    agree, best, used = ok.sum(axis=1), 0, ok[0]
    for k in np.argsort(-agree, kind="stable"):
        if agree[k] <= best:
            break
        places = min(len(np.unique(np.rint(x[ok[k], :2] / 2), axis=0)) for x in (p, q))
        if places > best:
            best, used = places, ok[k]
    u, v = (x[used, 0] + 1j * x[used, 1] for x in (p, q))
    m = np.vdot(u - u.mean(), v - v.mean()) / max(np.vdot(u - u.mean(), u - u.mean()).real, 1e-9)
    return best, complex(m), complex(v.mean() - m * u.mean())


def likeness(a: np.ndarray, b: np.ndarray, m: complex, z: complex) -> float:
    """Correlation of the pixels of two grey images where the transform lays a over b; -1 if that is under a tenth of b."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    to = m * (x + 1j * y) + z
    tx, ty = np.rint(to.real).astype(np.int64), np.rint(to.imag).astype(np.int64)
    on = (tx >= 0) & (tx < b.shape[1]) & (ty >= 0) & (ty < b.shape[0])
    if on.sum() * abs(m) ** 2 * 10 < b.size:
        return -1.0
    u, v = a[on].astype(np.float64), b[ty[on], tx[on]].astype(np.float64)
    u, v = u - u.mean(), v - v.mean()
    return float((u @ v) / max(math.sqrt((u @ u) * (v @ v)), 1e-9))


def _runs(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n[k] numbers from begin[k] on: k of each number, and the number."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _parts(n: np.ndarray, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of runs of n[k] numbers, each of about `most` numbers together."""
    lot = (np.cumsum(n) - n) // most
    edges = np.flatnonzero(np.diff(lot, prepend=-1, append=-1))
    yield from (slice(x, y) for x, y in zip(edges[:-1], edges[1:], strict=True))


def _agreeing(p: np.ndarray, q: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of the runs of matches (n[k] from begin[k] on) in which `INLIERS` agree with one of the run's proposals."""
    turn, grow = q[:, 3] - p[:, 3], q[:, 2] / p[:, 2]
    c, s, reach = grow * np.cos(turn), grow * np.sin(turn), (TOLERANCE * np.maximum(1.0, grow)) ** 2
    turn %= 2 * math.pi
    run, match = _runs(begin, n)
    out = []
    for part in _parts(n[run]):
        k, v = _runs(begin[run[part]], n[run[part]])
        u = match[part][k]
        off = np.abs(turn[v] - turn[u])
        like = np.flatnonzero((off < 0.5) | (off > 2 * math.pi - 0.5))
        like = like[np.bincount(k[like], minlength=k[-1] + 1)[k[like]] >= INLIERS]
        k, u, v = k[like], u[like], v[like]
        dx, dy = p[v, 0] - p[u, 0], p[v, 1] - p[u, 1]
        ex, ey = q[u, 0] + c[u] * dx - s[u] * dy - q[v, 0], q[u, 1] + s[u] * dx + c[u] * dy - q[v, 1]
        agree = np.bincount(k[ex * ex + ey * ey <= reach[u]])
        out.append(run[part][np.flatnonzero(agree >= INLIERS)])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _cells(raw: np.ndarray) -> list[np.ndarray]:
    """The cell of each descriptor in each table."""
    out = [np.empty(len(raw), np.uint32) for _ in KEYS]
    for at in range(0, len(raw), 1 << 16):
        bits = np.unpackbits(raw[at : at + (1 << 16)], axis=1)
        for cell, key in zip(out, KEYS, strict=True):
            part = np.zeros((len(bits), 4), np.uint8)
            part[:, : -(-KEY_BITS // 8)] = np.packbits(bits[:, key], axis=1)
            cell[at : at + len(bits)] = part.view(np.uint32)[:, 0]
    return out


def _compared(t: pa.Table) -> pa.Table:
    """Copies between two blocks of images, or within the one if they are the same: all descriptors that share a cell."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    t = t.take(pa.array(np.lexsort((t.column("point").to_numpy(), t.column("media_id").to_numpy()))))
    ids, first, image = np.unique(t.column("media_id").to_numpy(), return_index=True, return_inverse=True)
    point = np.arange(len(image)) - first[image]
    block = t.column("block").to_numpy()
    points = np.stack([t.column(c).to_numpy() for c in ("x", "y", "scale", "angle")], axis=1).astype(np.float64)
    raw = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(image), -1)
    code, left, right = raw.view(np.uint64), np.flatnonzero(block == i), np.flatnonzero(block == j)
    met = []
    for cell in _cells(raw):
        order = right[np.argsort(cell[right], kind="stable")].astype(np.int32)
        begin = np.searchsorted(cell[order], cell[left]).astype(np.int32)
        met.append((order, begin, np.searchsorted(cell[order], cell[left], "right").astype(np.int32) - begin))
    starts = np.flatnonzero(np.diff(image[left], prepend=-1))
    load = np.add.reduceat(sum(n.astype(np.int64) for _, _, n in met), starts) if len(left) else starts
    starts, most = np.append(starts, len(left)), KEYPOINTS * LEVELS
    found: list[tuple] = []
    for part in _parts(load, MEETINGS):
        part = slice(starts[part.start], starts[part.stop])
        near = [np.zeros(0, np.int64)]
        for order, begin, n in met:
            begin, n = begin[part], n[part]
            for lot in _parts(n):
                a, b = _runs(begin[lot], n[lot])
                a, b = left[part][lot][a], order[b]
                # descriptors of one cell differ in fewer than 256 bits, so the sum of bytes does not overflow
                unlike = np.bitwise_count(code.take(a, axis=0) ^ code.take(b, axis=0))
                ok = np.flatnonzero(unlike[:, 0] + unlike[:, 1] + unlike[:, 2] + unlike[:, 3] <= NEAR)
                a, b = a[ok], b[ok]
                ok = image[a] < image[b] if i == j else image[a] != image[b]
                a, b = a[ok], b[ok]
                a, b = np.where(image[a] < image[b], a, b), np.where(image[a] < image[b], b, a)
                near.append(((image[a] * len(ids) + image[b]) * most + point[a]) * most + point[b])
        # what met in many tables is one match; np.unique hashes, which takes several times as long
        near = np.sort(np.concatenate(near))
        near = near[np.diff(near, prepend=-1) != 0]
        pair = near // (most * most)
        n = np.diff(np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair)))
        near, n = near[np.repeat(n >= INLIERS, n)], n[n >= INLIERS]
        begin = np.cumsum(n) - n
        a = first[near // (most * most) // len(ids)] + near // most % most
        b = first[near // (most * most) % len(ids)] + near % most
        p, q = points[a], points[b]
        for k in _agreeing(p, q, begin, n):
            run = slice(begin[k], begin[k] + n[k])
            inliers, m, z = fitted(p[run], q[run])
            if inliers >= INLIERS:
                found.append((ids[image[a[begin[k]]]], ids[image[b[begin[k]]]], inliers, m.real, m.imag, z.real, z.imag))
    return pa.table({c: pa.array([f[k] for f in found], pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(("a", "b", "inliers", "mr", "mi", "zr", "zi"))})


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = []
        for k, r in enumerate(batch.to_pylist()):
            a, b = (np.frombuffer(r[f"p{x}"], np.uint8).reshape(r[f"h{x}"], r[f"w{x}"]) for x in "ab")
            if likeness(a, b, complex(r["mr"], r["mi"]), complex(r["zr"], r["zi"])) >= LIKE:
                kept.append(k)
        yield batch.select(["a", "b", "inliers"]).take(pa.array(kept, pa.int64()))


def copies(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """Copies among `media` (media_id, height, width, pixels: grey bytes in rows).

    Returns pairs of different images, a row each: a, b (a < b: the smallest media_ids of their pixels) and inliers.
    All descriptors that share a cell are compared, so each pair of copies has its row, however many others either has.
    Rows with null or impossible sizes or pixels have no copies. Equal pixels are one image.
    """
    images = stored(
        media.where("media_id is not null").groupBy(F.sha2("pixels", 256).alias("_key"), "height", "width").agg(F.min("media_id").alias("media_id"), F.first("pixels").alias("pixels")).drop("_key"), "media"
    )
    features = stored(images.select("media_id", "height", "width", "pixels").mapInArrow(_features, FEATURES), "media-features")
    n = images.count()
    blocks = max(min(8, -(-n // block)), -(-n // (8 * block)), 1)
    # an image goes to each pair of blocks that has its own; only copies leave a pair of blocks, not what met by chance
    dealt = features.withColumn("block", F.pmod(F.xxhash64("media_id"), F.lit(blocks))).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("media_id", "point", "x", "y", "scale", "angle", "code", F.col("block").cast("int").alias("block"), F.least("block", "with").cast("int").alias("i"), F.greatest("block", "with").cast("int").alias("j"))
    # some ten thousand rows for each pair of blocks, but seconds of work: partitions enough that few pairs share one
    dealt = dealt.repartition(2 * blocks * (blocks + 1), "i", "j")
    found = stored(dealt.groupBy("i", "j").applyInArrow(_compared, "a BIGINT, b BIGINT, inliers BIGINT, mr DOUBLE, mi DOUBLE, zr DOUBLE, zi DOUBLE"), "media-found")
    of = lambda x: images.select(F.col("media_id").alias(x), F.col("height").alias(f"h{x}"), F.col("width").alias(f"w{x}"), F.col("pixels").alias(f"p{x}"))
    return found.join(of("a"), "a").join(of("b"), "b").mapInArrow(_checked, "a BIGINT, b BIGINT, inliers BIGINT")


def members(media: DataFrame) -> DataFrame:
    """media_id and same_as, the smallest media_id of its pixels, for each image of `media`: a row each, repeats once.

    Rows with null or impossible sizes or pixels are no images. Large groups stay where their rows are.
    """
    real = media.where("media_id is not null and height > 0 and width > 0 and length(pixels) = cast(height as bigint) * width")
    digests = stored(real.select("media_id", F.concat_ws(" ", F.sha2("pixels", 256), "height", "width").alias("digest")).distinct(), "media-digests")
    groups = stored(digests.groupBy("digest").agg(F.min("media_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows")), "media-groups")
    return exact_dedup.assign(digests, groups, digests.count()).select("media_id", F.col("keep_id").alias("same_as"))


def render(seed: int, side: int = SIDE) -> np.ndarray:
    """A grey test image: overlapping shapes whose places and tones follow from `seed`."""
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFF)
    out = np.full((side, side), 128.0)
    for x, y, w, h, tone in zip(rng.integers(0, side, 26), rng.integers(0, side, 26), rng.integers(5, 22, 26), rng.integers(5, 22, 26), rng.integers(0, 256, 26), strict=True):
        out[y : y + h, x : x + w] = tone
    return out.astype(np.uint8)


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A cropped, brightened and slightly noisy copy of an image."""
    rng = np.random.default_rng((seed & 0xFFFFFFFF) + 7)
    dy, dx = rng.integers(2, 9, 2)
    h, w = image.shape
    part = image[dy : h - rng.integers(0, 4), dx : w - rng.integers(0, 4)].astype(np.float64)
    return np.clip(part * rng.uniform(0.8, 1.1) + rng.uniform(-10, 20) + rng.normal(0, 1.5, part.shape), 0, 255).astype(np.uint8)


EDITED_EACH = 10


def media_of(vectors: DataFrame) -> DataFrame:
    """A media table from a table of vectors (vec_id, embedding): the tables hold no images, so each vector is drawn as one.

    The picture follows from the vector's values, so equal vectors are equal images. Each tenth vec_id also has an edited
    copy with media_id -1 - vec_id.
    """

    def drawn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, rows = [], []
                part = batch.slice(at, 512)
                for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
                    if i is None or v is None:
                        continue
                    seed = zlib.crc32(np.array([np.nan if y is None else y for y in v], dtype="<f4").tobytes())
                    image = render(seed)
                    ids.append(i)
                    rows.append(image)
                    if i % EDITED_EACH == 0:
                        ids.append(-1 - i)
                        rows.append(edited(image, i))
                yield pa.RecordBatch.from_pydict(
                    {"media_id": pa.array(ids, pa.int64()), "height": pa.array([r.shape[0] for r in rows], pa.int32()), "width": pa.array([r.shape[1] for r in rows], pa.int32()), "pixels": pa.array([r.tobytes() for r in rows], pa.binary())}
                )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(drawn, MEDIA)


def all_copies(media: DataFrame) -> DataFrame:
    """media_id, copy_id and inliers: the pairs of `copies`, and each image with the smallest media_id of equal pixels.

    inliers is null for equal pixels. So every image that has a copy is in a row, and its links are those of its media_id.
    """
    drawn = stored(media, "media-drawn")
    equal = members(drawn).where("media_id <> same_as").select(F.col("same_as").alias("media_id"), F.col("media_id").alias("copy_id"), F.lit(None).cast("bigint").alias("inliers"))
    return copies(drawn).select(F.col("a").alias("media_id"), F.col("b").alias("copy_id"), "inliers").unionByName(equal)


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_copies(media_of(table(spark, sf_dir, "embeddings")))
