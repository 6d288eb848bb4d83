"""Mixing: inclusion against its probability over many samples, nearness to targets, repeats and narrow buckets."""

import random
from collections import defaultdict

import pytest

from factflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, copies int, target double"


def corpus(sources, sizes):
    return [(1000 * s + k, "w " * n, f"s{s:05d}", 7, 7, 0.5) for s in range(sources) for k, n in enumerate(sizes)]


def test_inclusion_frequencies(spark):
    sizes = [1, 1, 2, 3, 3, 4, 5, 5, 6, 8, 8, 9, 10, 12, 12, 15, 16, 20, 20, 24]
    # the last few words of a source go to documents that fit, which is little among 400
    got = mixing.mix(spark.createDataFrame(corpus(60, sizes * 20), SCHEMA), lean=0.5).collect()
    copies, inclusion = defaultdict(list), {}
    for r in got:
        copies[round(r.target, 6), r.size].append(r.copies)
        inclusion[round(r.target, 6), r.size] = r.inclusion
        assert r.copies in (int(r.inclusion), int(r.inclusion) + 1)
    targets = {t for t, _ in copies}
    assert len(targets) == 3 and len({round(x, 6) for (t, _), x in inclusion.items() if t == min(targets)}) == len(set(sizes))
    for key, seen in copies.items():
        assert abs(sum(seen) / len(seen) - inclusion[key]) < 0.09, (key, inclusion[key])
    # the mean words of each source are its target, and so nearly are the taken ones
    for t in targets:
        assert 20 * sum(inclusion[t, n] * n for n in sizes) == pytest.approx(t, rel=1e-9)
    taken = defaultdict(int)
    for r in got:
        taken[r.source, r.target] += r.taken
    assert all(abs(n - t) <= 12 for (_, t), n in taken.items())


@pytest.mark.parametrize("bucket", [1, 2048])
def test_rows_that_repeat_and_buckets_cut_again(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 40), rng.choice(["a", "b", None]), 1, 1, 1.0) for k in range(600)] + [(5000, "same words here", "a", 1, 1, 1.0)] * 400
    rows += [(None, None, None, None, None, None), (6000, "", "empty", 1, 1, 1.0), (6001, "long " * 900, "c", 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        by[r.source][2] = max(by[r.source][2], r.size)
    assert by["empty"][:2] == [0, 0.0] and all(abs(taken - target) <= 40 for s, (taken, target, _) in by.items() if s != "c")
    repeated = [r.copies for r in got if r.doc_id == 5000]
    p = next(r.inclusion for r in got if r.doc_id == 5000)
    assert abs(sum(repeated) / 400 - p) < 0.12 and len(set(repeated)) == 2
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_reruns_and_other_partitions_agree(spark):
    docs = spark.createDataFrame(corpus(30, range(1, 40)), SCHEMA)
    one = sorted((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    assert one == sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect())
    assert one != sorted((r.doc_id, r.copies) for r in mixing.mix(docs, seed=21).collect())
