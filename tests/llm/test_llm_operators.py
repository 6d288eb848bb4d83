"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from factflow.llm import common, exact_dedup, licenses, lm, media, mixing, packing, simhash, token_files, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "size long, kept boolean, fp long, cell long, score double"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ü", "it's", "é", " x"]
    out = [None, "", " \n\t ", "a", "A  a", "word " * 6000]
    for _ in range(n):
        out.append(rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, 80))))
    return out + out[6:16] + [out[8].replace(" ", "\n")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 7 else None, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 1, True, 2, 3, 0.5) for k, t in enumerate(texts())]
    rows.append(rows[20])
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="module")
def data(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def ids_of(text):
    return common.token_ids().tokenizer.encode(text, add_special_tokens=False).ids


def test_token_ids_equal_the_library():
    cases = ["", " a", "a ", "a  b", "a\n b", "a\r\nb", "\nx", "x\n", "<|endoftext|> z", "\x1c a", "é́ ñ", "don't  stop", "x" * 5000, *filter(None, texts())]
    for t, got in zip(cases, common.TokenIds(common.vocabulary_path(), pieces=50, words=60).encode(cases), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(t), t[:50]


def test_exact_dedup(docs, data):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for d, t in data]
    ids, sizes = {}, Counter(t for _, t in norm)
    for d, t in norm:
        if d is not None:
            ids[t] = min(ids.get(t, d), d)
    want = sorted((str(d), ids.get(t), sizes[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
    got = exact_dedup.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.n_rows, r.digest) for r in got) == want
    assert sorted(r.text or "" for r in exact_dedup.keep_one(docs).collect()) and exact_dedup.keep_one(docs).count() == len(sizes)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_digest_index_persists(spark, docs, tmp_path):
    where = f"file://{tmp_path}/index"
    exact_dedup.dedup(docs, where, 4)
    again = exact_dedup.dedup(docs.selectExpr("doc_id + 1000 as doc_id", "text"), where, 4)
    assert all(r.was_known and (r.keep_id is None or r.keep_id < 1000) for r in again.collect())
    assert exact_dedup.DigestIndex(spark, where, 4).rows().count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()})


def test_mixing(docs, data):
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.target])
        s[0] += r.size
        s[1] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size >= r.size
    assert abs(sum(s[2] for s in by.values()) - sum(s[0] for s in by.values())) < 1e-6
    assert all(s[2] <= 3 * s[0] + 1e-6 for s in by.values())
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 100, 1), ("c", 10, 1), (None, 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 1, 2, 3, 1: c stops at 30, the null source at 0; the rest is 180 for weights 1 and 2
    assert got == {"a": pytest.approx(60), "b": pytest.approx(120), "c": 30.0, None: 0.0}


def test_packing(docs, data):
    got = packing.pack(docs, size=64).collect()
    full = Counter(tuple([*ids_of(t), 2]) for _, t in data)
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in full.items())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    known = {d: [*ids_of(t), 2] for d, t in data if d is not None}
    for r in got:
        if r.doc_id is not None:
            part = known[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert len(bins) <= 1.1 * packing.lower_bound(np.array([r.length for r in got]), 64) + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, most=2)
    assert b.add(6) == (0, 0) and b.add(7) == (1, 0) and b.add(3) == (1, 7)
    assert b.add(9) == (2, 0) and b.add(8) == (3, 0)  # bin 2 (free 1) closes
    assert b.add(1) == (3, 8) and dict(b.left()) == {0: 4, 3: 1}


def test_token_files(spark, docs, data, tmp_path):
    where = f"file://{tmp_path}/shards"
    token_files.write(docs, where)
    got = token_files.read(spark, where).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x := [*ids_of(t), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9, 1 << 40], list(range(0, 5000, 7))])
def test_elias_fano(values):
    coded, end = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert coded.values().tolist() == values == [coded.select(i) for i in range(len(values))]


def test_simhash(docs, data):
    def fp(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0

    fps = [fp(t) for _, t in data]
    comp = list(range(len(data)))
    for _ in range(len(data)):
        for i in range(len(data)):
            for j in range(len(data)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == [comp[c] for c in comp]:
            break
    want = []
    for i, (d, _) in enumerate(data):
        members = [x for (x, _), c in zip(data, comp, strict=True) if c == comp[i] and x is not None]
        want.append((str(d), fps[i], min(members, default=None)))
    got = [(str(r.doc_id), r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ball_links_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:
        for k in range(1, 7):
            fps.append(int(b) ^ sum(1 << int(p) for p in rng.permutation(64)[:k]))
    fps = sorted(set(fps))
    lead, found = 6, simhash._Sets(len(fps))
    place = {f: i for i, f in enumerate(fps)}
    for cell in range(1 << lead):
        inside = [f for f in fps if ((f >> 58) ^ cell).bit_count() <= 2]
        if inside:
            for a, b in zip(*simhash.cell_links(cell, np.array(inside, np.uint64), lead, 2, 4), strict=True):
                found.join(place[int(a)], place[int(b)])
    want = simhash._Sets(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                want.join(i, j)
    assert [found.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]


def test_licenses():
    scan = licenses.Scanner()
    names = lambda t: {n for n, _, _ in scan.spans(licenses.words_of(t))}
    assert "apache-2.0" in names("Licensed under the Apache License, Version 2.0.")
    assert "gpl-3.0" in names("the GNU General Public License, version 3.")
    assert names("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert names("Licensed under the Apache Licence") == set()
    regions = licenses.parse("a <<optional>> b <<any 2>> c <<end>> d")
    auto, pattern = licenses.Automaton(regions), re.compile(licenses.as_regex(regions) + " ")
    rng = random.Random(1)
    for _ in range(500):
        w = [rng.choice("abcdx").encode() for _ in range(8)]
        assert any(auto.accepts_at(w, i) is not None for i in range(8)) == bool(pattern.search(" " + b" ".join(w).decode() + " "))


def test_license_rows(docs):
    got = licenses.scan(docs)
    assert got.count() == docs.count() and got.where("n_words = 0").where("labels <> ''").isEmpty()


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=en><title>T &amp; U</title><script>x<p></script><p>One<br>two &lt;b&gt;</p><!-- c --></html>"), (2, None, None), (1, "http://a/", "x")], "page_id long, url string, html string")
    got = warc.records(warc.derive(warc.responses_of(pages))).collect()
    assert len(got) == 6
    text = next(r for r in got if r.warc_type == "conversion" and "One" in r.block)
    assert text.block == "T & U\nOne\ntwo <b>"
    for r in got:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert f"WARC-Refers-To: {r.refers_to}".encode() in head and block == r.block.encode() + b"\r\n\r\n"
        import base64

        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    acc = [0.95, 0.9, 0.8, 0.85]
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in acc], axis=1)
    votes[rng.random(votes.shape) < 0.2] = -1
    seen, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(4).fit(seen, n.astype(float))
    assert np.abs(model.accuracies() - acc).max() < 0.06 and abs(model.prior - 0.2) < 0.05


def test_toxicity_learns(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice('aeiou')}" for _ in range(40)]
        if toxic:
            words[3:3] = [f"grumpfel{rng.choice(['a', 'en', 'isch', 'ung'])}" for _ in range(3)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (700, "")], "doc_id long, text string")
    det = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, det).collect()}
    assert all((got[k] >= 0.7) == (k % 6 == 0) for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1)
    assert got[700] < 0.7 and len(got) == 602
    assert toxicity.keep_clean(docs, det).count() == 502


def test_attention_gradients():
    model = lm.Attention(seed=1, own=10, classes=5, dim=4, window=6, stride=3)
    model.p = {n: x.astype(np.float64) for n, x in model.p.items()}
    rng = np.random.default_rng(0)
    symbols, target = rng.integers(0, 15, (3, 6)), rng.integers(0, 5, (3, 3))
    hidden = np.broadcast_to(model.ahead, (3, 3, 6)).copy()
    _, g = model.step(symbols, hidden, target)
    for name in model.NAMES:
        flat = model.p[name].ravel()
        for i in rng.integers(0, flat.size, 4):
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            up = model.step(symbols, hidden, target)[0]
            flat[i] = keep - eps
            down = model.step(symbols, hidden, target)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g[name].ravel()[i]) < 1e-4, name


def test_attention_windows_equal_one_by_one():
    model = lm.Attention(seed=2, own=10, classes=5, dim=4, window=8, stride=4)
    rng = np.random.default_rng(1)
    symbols, classes = rng.integers(0, 15, 23), rng.integers(0, 5, 23)
    begins = np.where(np.arange(23) < 9, 0, 9)
    got = model.log_classes(symbols, begins, classes, batch=2)
    for t in range(23):
        window = t // 4 * 4 - 4
        seen = [p for p in range(max(begins[t], window, 0), t + 1)]
        x = model.p["emb"][symbols[seen]]
        a = (x @ model.p["wk"]) @ (x[-1] @ model.p["wq"]) / 2 + model.p["dist"][t - np.array(seen)]
        a = np.exp(a - a.max())
        h = x[-1] + (a / a.sum()) @ (x @ model.p["wv"]) @ model.p["wo"]
        z = h @ model.p["out"] + model.p["bias"]
        assert abs(z[classes[t]] - np.log(np.exp(z).sum()) - got[t]) < 1e-4


def test_media_copies(spark):
    images = {k: media.render(k) for k in range(12)}
    rows = [(k, *im.shape, im.tobytes()) for k, im in images.items()] + [(100 + k, *(e := media.edited(images[k], k)).shape, e.tobytes()) for k in range(6)]
    rows += [(50, 64, 64, images[3].tobytes()), (60, None, None, None), (61, 10, 10, b"x")]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in rows], "media_id long, height int, width int, pixels binary")
    assert {(r.a, r.b) for r in media.copies(df).collect()} == {(k, 100 + k) for k in range(6)}


def test_toxic_patterns_vote_and_score(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice('aeiou')}" for _ in range(40)) + (" grumpfela grumpfelen" if k % 6 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame([*rows, (900, "I will kill you"), (901, rows[1][1] + " go to hell")], "doc_id long, text string")
    det = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(300)], "doc_id long, toxic int"))
    votes = dict(zip(det.voters.names, det.voters.votes(toxicity.features_of("you idiot, i hate you")), strict=True))
    assert votes["threat"] == votes["address"] == 1
    got = {r.doc_id: r.score for r in toxicity.score(docs, det).collect()}
    assert got[900] >= 0.7 and got[901] >= 0.7 and got[1] < 0.7


def test_media_equal_images_are_rows(spark):
    images = {k: media.render(k) for k in range(4)}
    rows = [(k, *im.shape, bytearray(im.tobytes())) for k, im in images.items()] + [(100 + k, 64, 64, bytearray(images[3].tobytes())) for k in range(150)]
    e = media.edited(images[3], 3)
    rows += [(50, *e.shape, bytearray(e.tobytes())), (60, None, None, None), (61, None, None, None), (62, 10, 10, bytearray(b"x")), (63, 10, 10, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "media_id long, height int, width int, pixels binary")
    got = {(r.media_id, r.copy_id): r.inliers for r in media.all_copies(df).collect()}
    assert set(got) == {(3, 50)} | {(3, 100 + k) for k in range(150)} and {p for p, n in got.items() if n is not None} == {(3, 50)}
    assert {r.media_id: r.same_as for r in media.members(df).collect()} == {k: k for k in [0, 1, 2, 3, 50]} | {100 + k: 3 for k in range(150)}
