"""Exact dedup with a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table with one row per distinct text, clustered by digest. New data is reduced to one row per
digest, deduplicated against the index by a sort-merge anti-join (the index side is read bucket by bucket, without a
shuffle) and what is new is appended to the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import scratch_path, stored, table

#: A digest is heavy if it has over this share of all rows; so at most 1 / share digests are heavy.
HEAVY_SHARE = 1 / 4096


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed or carriage return becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """A table of known digests below `location`, with a row for each: digest, keep_id, n_rows, batch.

    keep_id and n_rows: smallest id and rows of the text in the batch that brought it. The number of buckets is chosen
    when the index is made (about the shuffle partitions that the largest batch needs) and stored beside the rows; opening
    takes it from there, whatever the session's settings. Batches are appended by one writer at a time. The table's name
    in the catalog is of this session only; `close` removes it and leaves the files.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, n_rows BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.spark, self.location = spark, location.rstrip("/")
        layout = f"{self.location}/layout"
        if self._exists(f"{layout}/_SUCCESS"):
            self.buckets = spark.read.schema("buckets INT").parquet(layout).first()[0]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index has {self.buckets} buckets, not {buckets}")
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).selectExpr(f"int({self.buckets}) as buckets").coalesce(1).write.mode("overwrite").parquet(layout)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/rows'")

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(conf).exists(found)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append_new(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the digests of a batch that the index lacks. `digests`: doc_id, digest. Returns the batch's groups.

        A row per digest of the batch: digest, keep_id (the index's where it was known before), n_rows, n_first (rows of
        the batch with its smallest id), was_known (another batch brought it). A null doc_id orders last; a group of null
        ids only keeps null. A batch that is given again under the same name, as after a failure half way, adds what is
        missing and gets the answer of the first time; without a name every batch is one of its own.
        """
        batch = batch or uuid.uuid4().hex
        ids = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id")
        groups = stored(ids.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n_rows"), F.min_by("n", order).alias("n_first")), "digest-groups")
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch")).write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        first = self.rows().select("digest", F.col("keep_id").alias("_kept"), F.col("batch").alias("_batch"))
        return stored(groups.join(first.hint("merge"), "digest").select("digest", F.col("_kept").alias("keep_id"), "n_rows", "n_first", (F.col("_batch") != batch).alias("was_known")), "digest-answers")


def assign(digests: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Give each row of `digests` its group's columns, whatever the size of the group.

    Digests with over `HEAVY_SHARE` of the rows are at most 1 / HEAVY_SHARE many: those are broadcast, so a hot group
    stays where its rows are. All others meet by a shuffle in which no key can have more rows than that share.
    """
    limit = max(64, int(n_rows * HEAVY_SHARE))
    heavy = groups.where(F.col("n_rows") > limit)
    marked = digests.join(F.broadcast(heavy), "digest", "left").select(*digests.columns, *[F.col(c).alias(f"_h_{c}") for c in groups.columns if c != "digest"])
    taken = marked.where(F.col("_h_n_rows").isNotNull()).select(*digests.columns, *[F.col(f"_h_{c}").alias(c) for c in groups.columns if c != "digest"])
    rest = marked.where(F.col("_h_n_rows").isNull()).select(*digests.columns).join(groups.where(F.col("n_rows") <= limit), "digest")
    return taken.unionByName(rest.select(*taken.columns))


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha256(F.col("text")).alias("digest"))


def _groups(digests: DataFrame, location: str | None, buckets: int | None, batch: str | None) -> DataFrame:
    spark = digests.sparkSession
    index = DigestIndex(spark, location or scratch_path(spark, "digest-index"), buckets)
    try:
        return index.append_new(digests, batch)
    finally:
        index.close()


def dedup(docs: DataFrame, location: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """Deduplicate `docs` (doc_id, text) against the index at `location` (a new one by default) and append to it.

    Returns one row per input row: doc_id, digest, keep_id, n_rows (rows of that text in this batch), was_known, kept.
    kept: the one row of the text that stays; none does if another batch brought the text. Null texts count as empty
    texts. Repeated rows are rows of one group; of rows that share the smallest doc_id the first as read stays. Texts of
    any length are digested whole; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    digests = stored(_digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = _groups(digests, location, buckets, batch)
    out = assign(digests, groups, digests.count())
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("was_known")
    alone = out.withColumn("kept", first & (F.col("n_first") == 1))
    tied = groups.where("n_first > 1 and not was_known").select("digest")
    if tied.isEmpty():
        return alone.drop("row", "n_first")
    # of rows that share text and smallest id, the least row number: reduced map-side, so repeats do not meet
    least = digests.join(tied, "digest", "left_semi").join(groups.select("digest", "keep_id"), "digest").where("doc_id <=> keep_id").groupBy("digest").agg(F.min("row").alias("row"))
    return alone.join(least.select("row", F.lit(True).alias("_least")), "row", "left").withColumn("kept", F.col("kept") | F.coalesce("_least", F.lit(False))).drop("row", "n_first", "_least")


def keep_one(docs: DataFrame, location: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: for each text that the index (a new one by default) does not
    know from another batch the row with the smallest doc_id, and of equal ids one.

    Rows meet their group by digest and id together, so a hot text's rows are spread; only rows that repeat an id are
    reduced once more.
    """
    groups = _groups(stored(_digests(docs), "digests"), location, buckets, batch).where("not was_known")
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[c.alias(f"_{n}") for n, c in (("id", F.col("doc_id").cast("long")), ("digest", text_sha256(F.col("text"))))])
    meet = lambda g: named.join(g.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k")), (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_k")), "left_semi")
    out = meet(groups.where("n_first = 1")).select("_row.*")
    tied = groups.where("n_first > 1")
    if tied.isEmpty():
        return out
    return out.unionByName(meet(tied).groupBy("_digest").agg(F.first("_row").alias("_row")).select("_row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

