"""Descriptors tell unlike images apart, so few meet by chance, and copies of other sizes are found."""

import numpy as np

from factflow.llm import media


def test_few_unlike_images_have_near_descriptors():
    at, _, codes = media.describe(np.stack([media.render(k) for k in range(100)]))
    bits = np.unpackbits(codes, axis=1)
    near = np.zeros((100, 100), int)
    for i in range(len(at)):
        differ = (bits[i] != bits).sum(axis=1) <= media.NEAR
        shares = np.any([(bits[i, key] == bits[:, key]).all(axis=1) for key in media.KEYS], axis=0)
        np.add.at(near[at[i]], at[differ & shares], 1)
    # the search compares the places of such matches for each pair of images that has enough of them
    assert (near[np.triu_indices(100, 1)] >= media.INLIERS).mean() < 0.04


def test_copies_of_twice_the_size_and_turned(spark):
    images = {k: media.render(k) for k in range(60)}
    twice = {100 + k: media.edited(np.kron(images[k], np.ones((2, 2), np.uint8)), k) for k in range(30)}
    turned = {200 + k: media.edited(np.rot90(images[k]), k) for k in range(30, 60)}
    df = spark.createDataFrame([(k, *im.shape, bytearray(np.ascontiguousarray(im).tobytes())) for k, im in (images | twice | turned).items()], "media_id long, height int, width int, pixels binary")
    got = {(r.a, r.b) for r in media.copies(df).collect()}
    want = {(k, 100 + k) for k in range(30)} | {(k, 200 + k) for k in range(30, 60)}
    assert got <= want and len(got) >= 59


def test_meetings_are_compared_in_parts(spark, monkeypatch):
    import pyarrow as pa

    images = {k: media.render(k) for k in range(6)} | {100 + k: media.edited(media.render(k % 3), k) for k in range(12)}
    rows = []
    for m, im in images.items():
        _, points, codes = media.describe(im[None])
        rows += [(m, k, *map(float, p), c.tobytes(), 0, 0, 0) for k, (p, c) in enumerate(zip(points, codes, strict=True))]
    t = pa.table(dict(zip(("media_id", "point", "x", "y", "scale", "angle", "code", "block", "i", "j"), map(pa.array, zip(*rows[::-1], strict=True)), strict=True)))
    whole = media._compared(t).sort_by([("a", "ascending"), ("b", "ascending")])
    assert whole.num_rows >= 12
    monkeypatch.setattr(media, "MEETINGS", 50)
    assert media._compared(t).sort_by([("a", "ascending"), ("b", "ascending")]).equals(whole)


def test_a_copy_with_few_matches(spark):
    image = media.render(602817074)
    images = {1: image, 2: media.edited(image, 250)}
    df = spark.createDataFrame([(k, *im.shape, bytearray(im.tobytes())) for k, im in images.items()], "media_id long, height int, width int, pixels binary")
    # 24 tables find three of its matches, 32 find five
    assert [(r.a, r.b) for r in media.copies(df).collect()] == [(1, 2)]
