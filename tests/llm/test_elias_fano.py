"""Elias-Fano sequences: select against the values, what they and their file hold, and shards of odd tables."""

import numpy as np

from factflow.llm import token_files


def sequences():
    rng = np.random.default_rng(2)
    yield [], [0], [7], [0, 0, 0], [5] * 1000
    for n, top in ((10, 3), (1000, 10), (5000, 10**9), (3000, 2**45), (40_000, 10**6)):
        yield np.sort(rng.integers(0, top, n)).tolist(), np.cumsum(rng.zipf(1.3, n) % top).tolist()
    yield [*range(2000), 10**12, 10**12 + 1], [0] * 3000 + [10**7] * 3000


def test_select_equals_the_values():
    for group in sequences():
        for values in group:
            made = token_files.EliasFano.of(np.array(values, np.uint64))
            again, end = token_files.EliasFano.from_bytes(b"xx" + made.to_bytes() + b"tail", 2)
            assert end == 2 + len(made.to_bytes()) and again.values().tolist() == values == made.values().tolist()
            for i in {*range(0, len(values), 37), *range(min(300, len(values))), len(values) - 1} - {-1}:
                assert again.select(i) == made.select(i) == values[i]


def test_space_is_near_minimal_and_holds_no_wide_table():
    n = 100_000
    values = np.sort(np.random.default_rng(1).integers(0, 1000 * n, n))
    made = token_files.EliasFano.of(values)
    bits = 8 * len(made.to_bytes())
    assert bits < n * (2 + np.log2(1000) + 1) + 400
    held = [x for x in vars(made).values() if isinstance(x, np.ndarray)]
    assert all(x.dtype.itemsize == 1 or len(x) <= n // token_files.STEP + 1 for x in held) and all(x.dtype != np.int64 for x in held)


def test_shards_of_nulls_repeats_long_texts_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, part int, shard string, payload binary"
    rows = [(None, "null id", 1, "s", None), (3, None, 1, "s", None), (3, None, 1, "s", None), (-5, "minus", None, None, None), (9, "long words " * 50_000, 2, "t", None), (2**62, "", 1, "s", None)]
    token_files.write(spark.createDataFrame(rows, schema), f"file://{tmp_path}/a")
    got = token_files.read(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 3, 3, 9, 2**62] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.n_tokens for r in got if r.doc_id in (3, 2**62)] == [1, 1, 1]
    token_files.write(spark.createDataFrame([], schema), f"file://{tmp_path}/b")
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0
