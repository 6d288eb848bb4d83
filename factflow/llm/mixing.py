"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target number of words. A document's inclusion, the copies that it has in the mean, grows with its
size to the power `LEAN`, up to `MOST`, so that the source's words meet its target in the mean. floor(inclusion) whole
copies are certain; one more is drawn by Pareto order sampling: a document whose inclusion leaves a probability p and
that has a uniform random number u ranks by (u / (1 - u)) / (p / (1 - p)), and the sample is the first ones in that order.
The sample's size is fixed in words: it ends where the source's remaining words are used up. From there on the order is
followed through one bucket more, and a document is taken where it still fits into what is missing. That brings a source's
words near its target and favours short documents among the last few of a source, the more the fewer it has.

Finding the end of a sample needs no total order in one task: ranks fall into buckets, sums over buckets tell which bucket
the sample ends in, that bucket is cut again while it holds too many documents, and only the last is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factflow.llm.common import WORD, stored, table

#: Documents of one source that a bucket of ranks is meant to hold.
BUCKET = 2048
#: The most copies of one document.
MOST = 3
#: Inclusion grows with the size of a document to this power.
LEAN = 0.25
#: Places of ranks in a bucket's integer scale.
SCALE = 1 << 52
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Number of runs of anything but space and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Targets of all sources. `sizes`: source, source_size, n_docs. Adds target (double).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they share `share` of all words. A target stops at
    `most` times its source's size and the excess is shared again by weight until none is above. Resharing ends at a
    level: the sources whose ratio most * size / weight is below it stop, all others get level * weight. The level is
    found in one pass over the sources in the order of that ratio. (If even `most` times all sizes are too few, every
    source stops.) The rows are one per source, far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weigh = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1).cast("double"))
    ratio = weigh.withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    summed = ratio.select(
        "*",
        F.row_number().over(order).alias("_n"),
        # with this and all later sources unbounded: what the earlier ones leave, by the weights that are left
        (F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_bounded"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_free"),
        (share * F.sum("source_size").over(every)).alias("_all"),
    ).withColumn("_level", (F.col("_all") - F.col("_bounded")) / F.col("_free"))
    # the first source in that order whose level does not lift it above its bound
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_n", "_level"))).over(every)
    return summed.withColumn("_first", level).select(
        *sizes.columns,
        F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first._n")), most * F.col("source_size").cast("double"))
        .otherwise(F.col("_first._level") * F.col("_w"))
        .alias("target"),
    )


def _uniform(*keys: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _odds(p: Column) -> Column:
    return p / (1 - p)


def mix(docs: DataFrame, seed: int = 20, share: float = 1.0, most: int = MOST, lean: float = LEAN) -> DataFrame:
    """Copies of each document in the mix. `docs`: doc_id, source, text.

    Returns per row: doc_id, row (a number that tells repeated rows apart), size, source, source_size, target, inclusion,
    copies (0 to `most`), taken (copies * size). Each source's taken words come as near its target as whole documents
    allow. A null source is a source; null and empty texts have size 0 and no copies. Repeated rows are drawn each by
    themselves; equal ranks are ordered by doc_id and row. An empty table gives no rows, and a text of any length counts
    whole. Columns other than these three are not read.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text")
        ).withColumn("row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    return mix_sized(sized, seed, share, most, lean)


def inclusions(sized: DataFrame, planned: DataFrame, most: int, lean: float) -> DataFrame:
    """One row per source: source, source_size, n_docs, target, _level, _missing, _odds.

    A document's inclusion is least(most, _level * size ** lean); the level makes the source's mean words its target. The
    largest sizes stop at `most`: which ones follows from sums over the source's distinct sizes, a histogram. _missing:
    words that are left to draw after whole copies; _odds: those of the mean probability that is drawn.
    """
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("_w", F.pow(F.col("size").cast("double"), F.lit(lean)))
    known = sizes.join(planned.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = F.col("size") * F.col("n")
    level = (F.col("target") - most * F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(words * F.col("_w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    first = F.max_by(F.when(F.col("_at") * F.col("_w") <= most, F.col("_at")), F.when(F.col("_at") * F.col("_w") <= most, F.col("size"))).over(Window.partitionBy("source"))
    leveled = known.withColumn("_at", level).withColumn("_level", F.coalesce(first, F.lit(float("inf")))).withColumn("_inc", inclusion(F.col("_level"), F.col("size"), most, lean))
    part = F.col("_inc") - F.floor("_inc")
    drawn = F.sum(F.when(part > 0, F.col("n")))
    out = leveled.groupBy("source").agg(
        F.first("_level").alias("_level"), F.greatest(F.lit(0.0), F.first("target") - F.sum(F.floor("_inc") * F.col("size") * F.col("n"))).alias("_missing"), (F.sum(part * F.col("n")) / drawn).alias("_mean")
    )
    return planned.join(out.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(*planned.columns, "_level", "_missing", _odds(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), "_mean"))).alias("_odds"))


def inclusion(level: Column, size: Column, most: int, lean: float) -> Column:
    return F.when(size > 0, F.least(F.lit(float(most)), level * F.pow(size.cast("double"), F.lit(lean)))).otherwise(F.lit(0.0))


def mix_sized(sized: DataFrame, seed: int = 20, share: float = 1.0, most: int = MOST, lean: float = LEAN) -> DataFrame:
    """`mix` for a stored table of doc_id, source, size, _text (a hash of the text) and row."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    planned = stored(inclusions(sized, targets(sources, share, most), most, lean), "mix-targets")
    # rows that repeat get a number each by their own place, all others one that no partitioning changes
    again = sized.groupBy("doc_id", "source", "_text").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.xxhash64("doc_id", "source", "_text").alias("_again")).distinct()
    same = F.xxhash64("doc_id", "source", "_text")
    # one row per source joins all documents: a source's rows can be many, so the join may be split, or broadcast by its size
    known = sized.withColumn("_same", same).join(again, F.col("_same") == F.col("_again"), "left").join(planned.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    u = _uniform(F.col("doc_id"), F.col("source"), F.col("_text"), F.when(F.col("_again").isNotNull(), F.col("row")), seed=seed)
    inc = known.withColumn("inclusion", inclusion(F.col("_level"), F.col("size"), most, lean)).withColumn("_sure", F.floor("inclusion").cast("long"))
    p = F.col("inclusion") - F.col("_sure")
    ranked = inc.withColumn("_q", F.when(p > 0, _odds(u) / _odds(p)))
    # a place in (0, 1) that grows with the rank and is spread evenly where all have the mean probability
    place = F.col("_q") * F.col("_odds")
    drawn = stored(ranked.withColumn("_x", F.floor(place / (1 + place) * SCALE).cast("long")).select("doc_id", "row", "size", "source", "source_size", "target", "n_docs", "_missing", "inclusion", "_sure", "_q", "_x"), "mix-ranks")

    ends = planned.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_from"), F.lit(SCALE + 1).cast("long").alias("_to"), "_missing", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET)).cast("long").alias("_parts"))
    while True:
        ends = stored(_narrowed(drawn, ends), "mix-ends")
        # a bucket that holds far more documents than meant is cut again, unless it is a single place
        if ends.where((F.col("_n") > 8 * BUCKET) & (F.col("_to") - F.col("_from") > 1)).isEmpty():
            break
        ends = ends.withColumn("_parts", F.when(F.col("_n") > 8 * BUCKET, F.ceil(F.col("_n") / BUCKET)).otherwise(1).cast("long"))
    bounded = ends.select("_s", "_from", "_to", F.col("_missing").alias("_left"))
    # the bucket in which a source's sample ends: a few thousand rows of each source, put in order and walked through
    here = (F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to"))
    walked = (
        drawn.join(bounded, F.col("source").eqNullSafe(F.col("_s"))).where(here)
        .groupBy("source")
        .agg(F.first("_left").alias("_left"), F.array_sort(F.collect_list(F.struct("_q", "doc_id", "row", "size"))).alias("_docs"))
        .select(F.explode(_walk(F.col("_docs"), F.col("_left"))).alias("_taken_row"))
    )
    out = drawn.join(bounded, F.col("source").eqNullSafe(F.col("_s")), "left").join(walked, F.col("row") == F.col("_taken_row"), "left")
    # no end: the sample never fills (every drawn document is taken)
    extra = F.when(F.col("_q").isNull(), 0).when(F.col("_s").isNull() & F.col("_from").isNull() | (F.col("_x") < F.col("_from")) | F.col("_taken_row").isNotNull(), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("_sure") + extra).cast("long")
    return out.select("doc_id", "row", "size", "source", "source_size", "target", "inclusion", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _narrowed(drawn: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each source the bucket in which its sample ends, among `_parts` equal ones of its range of places; none if it ends
    nowhere. _missing: words left at the bucket's begin; _n: its documents."""
    known = drawn.where("_q is not null").drop("_missing").join(ends.select("_s", "_from", "_to", "_missing", "_parts"), F.col("source").eqNullSafe(F.col("_s")))
    step = F.ceil((F.col("_to") - F.col("_from")) / F.col("_parts")).cast("long")
    inside = known.where((F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to"))).withColumn("_step", step).withColumn("_bucket", F.expr("(_x - _from) div _step"))
    same = [F.first(c).alias(c) for c in ("_from", "_to", "_missing", "_step")]
    sums = inside.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n"), *same)
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    left = sums.withColumn("_missing", F.col("_missing") - F.coalesce(upto, F.lit(0))).where((F.col("_missing") >= 0) & (F.col("_missing") < F.col("_words")))
    first = left.groupBy("source").agg(F.min(F.struct("_bucket", "_missing", "_n", "_from", "_to", "_step")).alias("e"))
    begin = F.col("e._from") + F.col("e._bucket") * F.col("e._step")
    return first.select(F.col("source").alias("_s"), begin.alias("_from"), F.least(F.col("e._to"), begin + F.col("e._step")).alias("_to"), F.col("e._missing").alias("_missing"), F.col("e._n").alias("_n"))


def _walk(docs: Column, missing: Column) -> Column:
    """Rows of `docs` (in order) that are taken: each that fits into the words still missing, and in the end the one that
    brings the sum nearer if what is missing is over half of the smallest that was left."""
    start = F.struct(missing.cast("double").alias("left"), F.array().cast("array<bigint>").alias("rows"), F.lit(None).cast("bigint").alias("spare"), F.lit(None).cast("bigint").alias("spare_size"))

    def step(acc: Column, d: Column) -> Column:
        fits = d["size"] <= acc["left"]
        better = acc["spare_size"].isNull() | (d["size"] < acc["spare_size"])
        return F.struct(
            F.when(fits, acc["left"] - d["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["rows"], F.array(d["row"]))).otherwise(acc["rows"]).alias("rows"),
            F.when(~fits & better, d["row"]).otherwise(acc["spare"]).alias("spare"),
            F.when(~fits & better, d["size"]).otherwise(acc["spare_size"]).alias("spare_size"),
        )

    return F.aggregate(docs, start, step, lambda acc: F.when(acc["spare_size"] < 2 * acc["left"], F.concat(acc["rows"], F.array(acc["spare"]))).otherwise(acc["rows"]))


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "inclusion", "copies")


def mixed(docs: DataFrame, seed: int = 20, share: float = 1.0) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix takes it."""
    keyed = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    sized = keyed.select(
        F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").cast("string").alias("source"), n_words(F.col("_doc.text")).alias("size"), F.xxhash64("_doc.text").alias("_text"), F.col("_row").alias("row")
    )
    counts = mix_sized(stored(sized, "mix-sizes"), seed, share).where("copies > 0").select("row", "copies")
    return keyed.join(counts, F.col("_row") == F.col("row")).select("_doc.*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_again")).drop("_again")
