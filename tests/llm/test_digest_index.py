"""The digest index over sessions, settings, failures and repeats; rows that stay against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from factflow.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, keep_id long, row long, kept int"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def rows(n=400, seed=6):
    rng = random.Random(seed)
    out = [(rng.choice([k, k, k, None]), rng.choice([None, "", " ", "a b", "a\n b", f"t{rng.randrange(60)}", f"u{k}"]), "d", k, k, k) for k in range(n)]
    return out + out[40:90] + [out[3]] * 200 + [(n, "long " * 100_000, "d", 1, 1, 1)]


def test_rows_that_stay_and_their_groups(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    sizes, first = Counter(norm(r[1]) for r in data), {}
    for r in data:
        if r[0] is not None:
            first[norm(r[1])] = min(first.get(norm(r[1]), r[0]), r[0])
    got = exact_dedup.dedup(docs).collect()
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert Counter((r.doc_id, texts[r.digest], r.keep_id, r.n_rows) for r in got) == Counter((r[0], norm(r[1]), first.get(norm(r[1])), sizes[norm(r[1])]) for r in data)
    kept = [r for r in got if r.kept]
    assert Counter(texts[r.digest] for r in kept) == Counter(dict.fromkeys(sizes, 1)) and all(r.doc_id == r.keep_id for r in kept)
    whole = exact_dedup.keep_one(docs).collect()
    assert {(r.doc_id, norm(r.text)) for r in whole} == {(first.get(t), t) for t in sizes} and len(whole) == len(sizes)
    assert {tuple(r) for r in whole} <= set(data) and docs.columns == exact_dedup.keep_one(docs).columns
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0 and exact_dedup.dedup(docs.limit(0)).count() == 0


def test_another_number_of_shuffle_partitions_finds_all_texts(spark, tmp_path):
    where, docs = f"file://{tmp_path}/index", spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "16", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = exact_dedup.dedup(docs.selectExpr(f"doc_id + {partitions}000 as doc_id", "text"), where).collect()
            assert all(r.was_known == (partitions != "4") and r.keep_id // 1000 == 4 and r.kept == (partitions == "4") for r in got)
            index = exact_dedup.DigestIndex(spark, where)
            assert index.buckets == 4 and index.rows().count() == 200
            index.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, where, 16)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_a_batch_given_again(spark, tmp_path):
    where, docs = f"file://{tmp_path}/index", spark.range(50).selectExpr("id as doc_id", "concat('t', id % 30) as text")
    ask = lambda df, batch: {(r.doc_id, r.keep_id, r.was_known, r.kept) for r in exact_dedup.dedup(df, where, 4, batch).collect()}
    first = ask(docs, "a")
    assert ask(docs, "a") == first and not any(known for _, _, known, _ in first)
    # a batch that stopped half way adds what is missing
    assert ask(docs.where("doc_id < 5").selectExpr("doc_id", "concat('v', text) as text"), "b") <= ask(docs.selectExpr("doc_id", "concat('v', text) as text"), "b")
    assert all(known and not kept for _, _, known, kept in ask(docs, "c")) and all(known for _, _, known, _ in ask(docs, None))
    assert exact_dedup.keep_one(docs, where, 4, "d").count() == 0 and exact_dedup.keep_one(docs, where, 4, "a").count() == 30
    index = exact_dedup.DigestIndex(spark, where)
    assert index.rows().count() == 60 == index.rows().select("digest").distinct().count()
    index.close()
