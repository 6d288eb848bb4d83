"""The pipeline's stages against brute force, on a small corpus with toxic texts, exact and near copies and a null row."""

import random
import re
from collections import Counter

import corpus_pipeline
from factflow.llm import simhash, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice('aeiou')}" for _ in range(60)]
        if k % 6 == 0:
            words[5:5] = [f"grumpfel{rng.choice(['a', 'en', 'isch', 'ung'])}" for _ in range(3)]
        rows.append((k, " ".join(words), f"s{k % 3}", 1))
        labels.append((k, int(k % 6 == 0)))
    rows += [(300, rows[1][1].replace(" ", "\n"), "s1", 2), (301, rows[2][1] + " x", "s2", 3), (None, None, None, None), rows[7]]
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string, _row long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    det = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        if name != "best_fit_packing":
            assert out.columns == ["doc_id", "text", "source", "_row"]
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        kept[name] = docs.collect()
    clean = [r for r in rows if det.score(toxicity.features_of(r[1] or "")) < toxicity.THRESHOLD]
    assert Counter(r.doc_id for r in kept["toxicity"]) == Counter(r[0] for r in clean)
    assert not any((r.doc_id or 1) % 6 == 0 for r in kept["toxicity"] if r.doc_id != 300)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(kept["exact_dedup"]) == len({norm(r[1]) for r in clean}) and 300 not in {r.doc_id for r in kept["exact_dedup"]}
    left = sorted((r.doc_id is None, r.doc_id or 0, simhash.fingerprint(r.text, corpus_pipeline.SHINGLE)) for r in kept["exact_dedup"])
    sets = simhash._Sets(len(left))
    for i in range(len(left)):
        for j in range(i):
            if (left[i][2] ^ left[j][2]).bit_count() <= 4:
                sets.join(i, j)
    want = sorted(left[i][:2] for i in range(len(left)) if sets.root(i) == i)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept["simhash_near_dedup"]) == want
    mixed = Counter(r.doc_id for r in kept["pareto_mixing"])
    assert max(mixed.values()) <= 3 and set(mixed) <= {r.doc_id for r in kept["simhash_near_dedup"]}
    starts = Counter(r.doc_id for r in kept["best_fit_packing"] if r.piece == 0)
    assert starts == mixed


def test_near_copies_from_a_similarity_of_0_8(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(100000)}" for _ in range(200)]
        rows.append((k, " ".join(words)))
        # each changed word costs up to 5 shingles: 3 leave a similarity over 0.8, 9 one under it
        for j, n in ((100, 3), (200, 4), (300, 9)):
            w = list(words)
            for at in range(20, 20 + 20 * n, 20):
                w[at] = f"x{rng.randrange(100000)}"
            rows.append((k + j, " ".join(w)))
    # long runs of near copies of one text
    rows += [(1000 + i, rows[0][1] + f" y{i}") for i in range(3 * simhash.RUN)] + [(2000, None), (2001, " ")]
    sets = {d: {tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for d, t in rows}
    ids = [d for d, _ in rows]
    root = simhash._Sets(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if 5 * len(x & y) >= 4 * len(x | y):
                root.join(i, j)
    want = sorted(ids[i] for i in range(len(ids)) if root.root(i) == i)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want and {300, 2000} <= set(want) and not {101, 201, 1000, 2001} & set(want)
