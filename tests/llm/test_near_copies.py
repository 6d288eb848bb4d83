"""Near copies in large clusters against all pairs by brute force, and the search for components."""

import random

import numpy as np
import pytest

import corpus_pipeline
from factflow.llm import simhash


def brute(sets):
    root = simhash._Sets(len(sets))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root.join(i, j)
    return [root.root(i) for i in range(len(sets))]


def test_components_of_sets():
    rng = random.Random(5)
    for n in (1, 2, 7, 60, 150):
        base = [rng.sample(range(400), 40) for _ in range(4)]
        sets = []
        for _ in range(n):
            x = set(rng.choice(base))
            for _ in range(rng.randrange(7)):
                x.discard(rng.choice(sorted(x)))
                x.add(rng.randrange(400, 900))
            sets.append(x)
        sets += [set(), set(), set(base[0])]
        assert simhash.jaccard_roots([np.array(sorted(x), np.uint64) for x in sets]) == brute(sets)


@pytest.mark.parametrize("together", [10, 2000])
def test_large_clusters_lose_no_link(spark, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = random.Random(8)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(150):
        # a chain away from the first text and copies around each of its links
        at = base if k % 3 else list(base)
        w = list(at)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
        if k % 10 == 9:
            base = w
    rows += [(1000 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))) for k in range(20)]
    order = sorted(rows)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in order]
    roots = brute(sets)
    want = sorted(order[i][0] for i in range(len(order)) if roots[i] == i)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want and 20 < len(want) < 150
