"""Toxicity by weak supervision.

1. Lexicons are mined from labelled training rows: words and word beginnings that stand in toxic texts and hardly ever
   in others. Together with general insult lists and patterns they make many weak voters, each of which votes toxic,
   votes clean or abstains.
2. A generative label model is fitted to the votes alone, over all documents: each voter has an accuracy and a
   propensity given the class, found by expectation-maximisation over the counts of vote patterns. Voters that agree
   more than their accuracies explain are correlated; such a pair is modelled jointly, and the model is fitted again.
3. Its posteriors are the labels for a linear classifier on words and word beginnings, which scores every text.

Inputs of a score are the text and nothing else.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import slices, stored, table

#: Most labelled training rows that lexicons and classifier are fitted to (those with the smallest hash of doc_id).
SAMPLE = 16_384
#: Most features of the classifier besides mined ones, and most entries of a mined lexicon.
FEATURES, LEXICON = 1024, 2048
#: A mined feature stands in so many toxic rows at least, and so many times as often among toxic rows.
LEAST, TIMES = 5, 100
#: Chance finds that mining may make among all features, on average.
CHANCE = 0.05
THRESHOLD = 0.7

# General insults and threats, small and independent of any data set.
INSULTS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool foolish jerk garbage filth vermin imbecile".split(),
    "de": "idiot idioten dumm dummkopf trottel abschaum versager ekelhaft widerlich wertlos drecksack arschloch".split(),
    "fr": "idiot idiote imbécile crétin connard stupide minable ordure raclure pathétique dégoûtant".split(),
    "es": "idiota imbécil estúpido basura escoria patético asqueroso inútil payaso perdedor".split(),
}
THREATS = re.compile(r"\b(?:kill|hate|hurt|destroy)\s+(?:you|them|yourself|him|her)\b|\bshut up\b|\bgo to hell\b", re.I)
ADDRESS = re.compile(r"\byou(?:'re| are)?\s+(?:an?\s+|such\s+an?\s+|all\s+)?(\w+)", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: A match of THREATS has one of these among its words; letters that ignoring case equates with ASCII ones aside.
_IN_THREATS, _ODD_CASE = frozenset("kill hate hurt destroy shut hell".split()), re.compile("[\u0130\u0131\u017f\u212a]")
_INSULTS = frozenset(w for words in INSULTS.values() for w in words)
#: Features of the pattern voters: they need the text, and every other voter only its words.
PATTERNS = ("!threat", "!address")


def features_of(text: str) -> set[str]:
    """Words ("=word"), beginnings of 4 to 7 letters ("4abcd"), and beginnings that two or three different words have
    ("4abcd+", "4abcd++"), each once: inflected marks repeat a stem, chance ones hardly do. And what of PATTERNS the text has."""
    words = set(_WORDS.findall(text.lower()))
    out = {"=" + w for w in words}
    for n in (4, 5, 6, 7):
        starts = [w[:n] for w in words if len(w) > n]
        once = set(starts)
        mark = str(n)
        out.update([mark + s for s in once])
        if len(once) < len(starts):
            for s, k in Counter(starts).items():
                if k > 1:
                    out.add(f"{mark}{s}+")
                    if k > 2:
                        out.add(f"{mark}{s}++")
    if (not _IN_THREATS.isdisjoint(words) or (not text.isascii() and _ODD_CASE.search(text))) and THREATS.search(text):
        out.add("!threat")
    if not _INSULTS.isdisjoint(words) and any(m.lower() in _INSULTS for m in ADDRESS.findall(text)):
        out.add("!address")
    return out


def _fold(feature: str, folds: int) -> int:
    return zlib.crc32(feature.encode()) % folds


def surprise(toxic: int, clean: int, rate: float) -> float:
    """Minus the log of a bound on the chance that so many of a feature's rows are toxic if it is independent (Chernoff)."""
    n = toxic + clean
    q = toxic / n
    if q <= rate:
        return 0.0
    return n * (q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0))


def mine(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, n_features: int, folds: int = 3) -> list[dict[str, float]]:
    """Lexicons of features that mark toxic texts: `folds` of words and `folds` of word beginnings, each with log odds.

    `counts`: for a feature the toxic and the clean rows that have it. It counts if at least LEAST toxic rows have it, it
    is at least TIMES as frequent among toxic rows, and that is no chance find among `n_features` features.
    """
    out: list[dict[str, float]] = [{} for _ in range(2 * folds)]
    rate = n_toxic / max(1, n_toxic + n_clean)
    for f in sorted(counts, key=lambda f: (-counts[f][0], f)):
        if f in PATTERNS:
            continue
        toxic, clean = counts[f]
        odds = math.log((toxic + 0.5) / max(1, n_toxic)) - math.log((clean + 0.5) / max(1, n_clean))
        if toxic < LEAST or odds < math.log(TIMES) or surprise(toxic, clean, rate) < math.log(max(1, n_features) / CHANCE):
            continue
        # all beginnings of one stem vote in one lexicon
        lexicon = out[_fold(f[1:], folds)] if f[0] == "=" else out[folds + _fold(f[1:5], folds)]
        if len(lexicon) < LEXICON:
            lexicon[f] = odds
    return out


class Voters:
    """The weak voters. `votes(feats)` gives 1 (toxic), 0 (clean) or -1 (abstains) for each."""

    def __init__(self, lexicons: list[dict[str, float]]):
        self.lexicons = [frozenset(x) for x in lexicons]
        self.every = frozenset().union(*self.lexicons) if self.lexicons else frozenset()
        self.lists = {lang: frozenset("=" + w for w in words) for lang, words in INSULTS.items()}
        self.insults = frozenset().union(*self.lists.values())
        self.names = [f"mined_{k}" for k in range(len(self.lexicons))] + [f"list_{x}" for x in self.lists] + ["threat", "address", "mined_twice", "mined_three"]

    def counts(self, feats: set[str]) -> set[str]:
        """Features for the number of marked stems and insults of a text."""
        n = len({h[1:5] for h in feats & self.every} | {h[1:5] for h in feats & self.insults})
        return {f"#{k}" for k in (1, 2, 3, 5) if n >= k}

    def votes(self, feats: set[str]) -> list[int]:
        hits = feats & self.every
        stems = {h[1:5] for h in hits}
        # a lexicon votes clean only where none of them has a hit, else it abstains
        missing = -1 if hits else 0
        out = [1 if hits & x else missing for x in self.lexicons]
        insults = feats & self.insults
        out += [1 if insults & x else (0 if not insults and not hits else -1) for x in self.lists.values()]
        out += [1 if p in feats else -1 for p in PATTERNS]
        out.append(1 if len(stems) >= 2 else missing)
        out.append(1 if len(stems) >= 3 else missing)
        return out


class LabelModel:
    """A generative model of votes given the class, with accuracies, propensities and pairwise correlations.

    Each block of voters (one voter, or a correlated pair) has a table P(votes | class); blocks are independent given
    the class. `fit` takes vote patterns with their counts, so its work does not grow with the number of rows.
    """

    def __init__(self, n_voters: int, rounds: int = 100, corr: float = 0.25):
        self.n, self.rounds, self.corr = n_voters, rounds, corr
        self.blocks: list[tuple[int, ...]] = [(k,) for k in range(n_voters)]
        self.prior = 0.1
        self.tables: list[np.ndarray] = []
        self.correlations: list[tuple[int, int, float]] = []

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum((votes[:, v] + 1) * 3**k for k, v in enumerate(b)) for b in self.blocks]

    def _em(self, votes: np.ndarray, weight: np.ndarray) -> None:
        for_toxic, for_clean = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
        post = np.clip((0.05 + for_toxic) / (0.1 + for_toxic + for_clean), 0.02, 0.98)
        post = np.where(for_toxic == 0, 0.02, post)
        codes = self._codes(votes)
        for _ in range(self.rounds):
            self.prior = float(np.clip((post * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
            self.tables = []
            for b, c in zip(self.blocks, codes, strict=True):
                size = 3 ** len(b)
                t = np.stack([np.bincount(c, weight * (1 - post), size), np.bincount(c, weight * post, size)]) + 0.1
                self.tables.append(t / t.sum(axis=1, keepdims=True))
            new = self.posterior(votes)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def fit(self, votes: np.ndarray, weight: np.ndarray) -> LabelModel:
        self._em(votes, weight)
        post = self.posterior(votes)
        # correlation within a class of "votes toxic", beyond what the class explains
        pairs = []
        toxic = (votes == 1).astype(float)
        for a in range(self.n):
            for b in range(a + 1, self.n):
                worst = 0.0
                for w in (weight * post, weight * (1 - post)):
                    total = w.sum()
                    if total < 1:
                        continue
                    pa_, pb = (w * toxic[:, a]).sum() / total, (w * toxic[:, b]).sum() / total
                    var = pa_ * (1 - pa_) * pb * (1 - pb)
                    if var > 1e-8:
                        worst = max(worst, abs((w * toxic[:, a] * toxic[:, b]).sum() / total - pa_ * pb) / math.sqrt(var))
                if worst >= self.corr:
                    pairs.append((a, b, worst))
        taken: set[int] = set()
        self.correlations = sorted(pairs, key=lambda p: -p[2])
        for a, b, _ in self.correlations:
            if a not in taken and b not in taken:
                taken |= {a, b}
                self.blocks = [x for x in self.blocks if x not in ((a,), (b,))] + [(a, b)]
        if taken:
            self._em(votes, weight)
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for c, t in zip(self._codes(votes), self.tables, strict=True):
            logit += np.log(t[1][c]) - np.log(t[0][c])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | it votes) of each voter."""
        out = np.zeros(self.n)
        for b, t in zip(self.blocks, self.tables, strict=True):
            joint = t * np.array([[1 - self.prior], [self.prior]])
            for k, v in enumerate(b):
                value = np.arange(t.shape[1]) // 3**k % 3 - 1
                right = joint[0][value == 0].sum() + joint[1][value == 1].sum()
                out[v] = right / max(1e-12, joint[:, value >= 0].sum())
        return out


class Linear:
    """Logistic regression on sets of features, trained on soft labels."""

    def __init__(self, names: list[str]):
        self.index = {f: k for k, f in enumerate(names)}
        self.weights, self.bias = np.zeros(len(names)), 0.0

    def rows(self, feature_sets: Iterable[set[str]]) -> list[np.ndarray]:
        get = self.index.get
        return [np.array(sorted(k for f in s if (k := get(f)) is not None), dtype=np.int64) for s in feature_sets]

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, free: int, rounds: int = 300, rate: float = 0.5, l2: float = 5e-5, l2_rest: float = 2e-3) -> Linear:
        """Full-batch Adagrad; the two classes weigh alike. The first `free` features are held back less than the rest."""
        shrink = np.where(np.arange(len(self.weights)) < free, l2, l2_rest)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        weight = np.where(labels > 0.5, 0.5 / max(1.0, labels.sum()), 0.5 / max(1.0, (1 - labels).sum()))
        grad_sq, bias_sq = np.full(len(self.weights), 1e-8), 1e-8
        for _ in range(rounds):
            p = self._sigmoid(self.bias + np.bincount(owner, self.weights[flat], len(rows)))
            err = (p - labels) * weight
            g = np.bincount(flat, err[owner], len(self.weights)) + shrink * self.weights
            grad_sq += g * g
            self.weights -= rate * g / np.sqrt(grad_sq)
            bias_sq += err.sum() ** 2
            self.bias -= rate * err.sum() / math.sqrt(bias_sq)
        return self

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def score(self, feats: set[str]) -> float:
        get, w = self.index.get, self.weights
        hit = [k for f in feats if (k := get(f)) is not None]
        return float(self._sigmoid(self.bias + (w[hit].sum() if hit else 0.0)))


def held_out(doc_id):
    """Whether a row is not learnt from: crc32 of its doc_id as text, mod 3, is 1. A null doc_id is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features and label of at most `sample` labelled training rows, those with the smallest hash of their doc_id."""
    # a doc_id that is labelled twice counts once, as toxic if any of its rows says so
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null").where(~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "toxic", "text")
        .mapInArrow(_featured, "doc_id BIGINT, toxic INT, sketch BIGINT, feats STRING")
    )
    # copies of a text, near ones too, count once: else the words of a text with many copies would look like marks
    return stored(found.groupBy("sketch").agg(F.max_by("toxic", F.struct("doc_id", "feats")).alias("toxic"), F.max_by("feats", F.struct("doc_id", "feats")).alias("feats"), F.max("doc_id").alias("doc_id")), "toxic-sample")


def _sketch(text: str) -> int:
    """The least hash of a text's runs of three words: mostly equal for near copies, hardly ever for others."""
    words = _WORDS.findall(text.lower())
    return min((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        feats = [" ".join(sorted(features_of(t))) for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "sketch": pa.array(map(_sketch, texts), pa.int64()), "feats": pa.array(feats, pa.string())})


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for feats, toxic in zip(batch.column("feats").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic <= 0].update(feats.split(" ") if feats else ())
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "toxic": pa.array([counts[0][f] for f in names], pa.int64()), "clean": pa.array([counts[1][f] for f in names], pa.int64())})


def _pattern(votes: list[int]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def _unpattern(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([codes // 3**k % 3 - 1 for k in range(n)], axis=1)


class Detector:
    """What is fitted: voters, label model and classifier. Small, and sent to every task."""

    def __init__(self, voters: Voters, model: LabelModel, linear: Linear):
        self.voters, self.model, self.linear = voters, model, linear

    def score(self, feats: set[str]) -> float:
        return self.linear.score(feats | self.voters.counts(feats))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Detector:
    """Fit a detector to `docs` (doc_id, text) and `labels` (doc_id, toxic).

    Labels are read only of rows that are not held out, and of at most `sample` of them; with no such rows the voters are
    the general lists and patterns. The label model sees the vote patterns of all documents: there are at most a few
    hundred, whatever the number of rows.
    """
    rows = _labelled(docs, labels, sample)
    n_toxic, n_clean = (int(x or 0) for x in rows.agg(F.sum(F.expr("int(toxic > 0)")), F.sum(F.expr("int(toxic <= 0)"))).first())
    counts = stored(rows.select("toxic", "feats").mapInArrow(_counted, "f STRING, toxic BIGINT, clean BIGINT").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-features")
    marking = counts.where(F.col("toxic") >= LEAST).where((F.col("toxic") + 0.5) * max(1, n_clean) >= TIMES * (F.col("clean") + 0.5) * max(1, n_toxic))
    found = marking.orderBy(F.desc("toxic"), "f").limit(6 * LEXICON).collect()
    n_features = counts.where(F.col("toxic") + F.col("clean") >= LEAST).count()
    voters = Voters(mine({r.f: (r.toxic, r.clean) for r in found}, n_toxic, n_clean, n_features))

    def vote(batches):
        for batch in batches:
            counts = Counter()
            for t in batch.column("text").to_pylist():
                counts[_pattern(voters.votes(features_of(t or "")))] += 1
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(vote, "pattern BIGINT, n BIGINT").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([r.pattern for r in seen], dtype=np.int64)
    n = len(voters.names)
    model = LabelModel(n)
    if len(patterns):
        model.fit(_unpattern(patterns, n), np.array([r.n for r in seen], dtype=float))

    lexicon = [*sorted(voters.every | voters.insults), "#1", "#2", "#3", "#5", *PATTERNS]
    common = [r.f for r in counts.where(F.col("toxic") + F.col("clean") >= LEAST).orderBy(F.desc(F.col("toxic") + F.col("clean")), "f").limit(FEATURES).collect()]
    own = set(lexicon)
    linear = Linear(lexicon + [f for f in common if f not in own])

    def indexed(batches):
        for batch in slices(batches):
            sets = [set(x.split(" ")) for x in batch.column("feats").to_pylist()]
            votes = [_pattern(voters.votes(x)) for x in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "pattern": pa.array(votes, pa.int64()), "at": pa.array([x.tolist() for x in linear.rows(x | voters.counts(x) for x in sets)], pa.list_(pa.int32()))})

    if n_toxic + n_clean and len(patterns):
        # at most `sample` rows of the places of their features
        sample_rows = sorted(rows.select("doc_id", "feats").mapInArrow(indexed, "doc_id BIGINT, pattern BIGINT, at ARRAY<INT>").toArrow().to_pylist(), key=lambda r: r["doc_id"])
        linear.fit([np.array(r["at"], dtype=np.int64) for r in sample_rows], model.posterior(_unpattern(np.array([r["pattern"] for r in sample_rows]), n)), free=len(lexicon))
        # of a pattern that no sample row has nothing is learnt: it is taken at its word
        seen_at = {k for r in sample_rows for k in r["at"]}
        for k in (linear.index[p] for p in PATTERNS):
            if k not in seen_at:
                linear.weights[k] = 3.0 - linear.bias
    else:
        linear.weights[[linear.index[f] for f in ("#1", "!threat")]], linear.bias = 6.0, -3.0
    return Detector(voters, model, linear)


SCORES = "doc_id BIGINT, score DOUBLE, posterior DOUBLE"


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, score (the classifier's, 0 to 1) and posterior (the label model's) of each row of `docs`, row by row.

    Null and empty texts have no features and get the score of the bias. Columns other than doc_id and text are not read.
    """

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            feats = [features_of(t) for t in texts]
            votes = np.array([detector.voters.votes(f) for f in feats], dtype=np.int64).reshape(len(texts), -1)
            post = detector.model.posterior(votes) if len(texts) and detector.model.tables else np.zeros(len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([detector.score(f) for f in feats], pa.float64()), "posterior": pa.array(post)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, SCORES)


def keep_clean(docs: DataFrame, detector: Detector, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below `threshold`."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([detector.score(features_of(t or "")) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "posterior")
