"""All copies of an image are linked with each other, and blocks of images lose no link."""

import numpy as np

from factflow.llm import media


def _pairs(images):
    """Pairs of images by brute force: all descriptors that share a key in some table, then consensus."""
    at, points, codes = [], [], []
    for k, im in images.items():
        _, p, c = media.describe(im[None])
        at += [k] * len(p)
        points += list(p)
        codes += list(np.unpackbits(c, axis=1))
    matches = {}
    for i in range(len(at)):
        for j in range(len(at)):
            if at[i] < at[j] and (codes[i] != codes[j]).sum() <= media.NEAR and any((codes[i][key] == codes[j][key]).all() for key in media.KEYS):
                matches.setdefault((at[i], at[j]), []).append((points[i], points[j]))
    return {ab: n for ab, m in matches.items() if len(m) >= media.INLIERS and (n := _copied(images[ab[0]], images[ab[1]], m))}


def _copied(a, b, matches):
    n, m, z = media.fitted(*(np.array([x[s] for x in matches], np.float64) for s in (0, 1)))
    return n if n >= media.INLIERS and media.likeness(a, b, m, z) >= media.LIKE else 0


def test_every_pair_of_copies(spark):
    images = {k: media.render(k) for k in range(4)} | {100 + k: media.edited(media.render(0), k) for k in range(5)}
    want = _pairs(images)
    # copies of one image are copies of each other
    assert any(a >= 100 for a, _ in want)
    df = spark.createDataFrame([(k, *im.shape, bytearray(im.tobytes())) for k, im in images.items()], "media_id long, height int, width int, pixels binary")
    assert {(r.a, r.b): r.inliers for r in media.copies(df).collect()} == want
    assert {(r.a, r.b): r.inliers for r in media.copies(df, block=2).collect()} == want


def test_chance_agreement_is_no_copy():
    a, b = media.render(5), media.render(6)
    assert media.likeness(a, a, 1, 0) > 0.99 and media.likeness(a, b, 1, 0) < media.LIKE
