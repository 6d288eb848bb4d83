"""Incremental maintenance: what changed, what it takes with it, and what has to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.functions import names as N

#: Fact tables with the column by which a row belongs to a class, and whether that column names a method.
OWNERS = {
    "classes": ("fqn", False), "class_hierarchy": ("class_fqn", False), "method_declarations": ("class_fqn", False), "allocation_sites": ("method_fqn", True),
    "source_assignments": ("method_fqn", True), "call_sites": ("method_fqn", True), "call_arguments": ("call_id", True), "class_annotations": ("class_fqn", False),
    "field_annotations": ("class_fqn", False), "method_annotations": ("method_fqn", True), "parameter_annotations": ("method_fqn", True),
}


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path and status (new, dirty, deleted, same) of two snapshots (file_path, hash)."""
    o, n = old.select("file_path", F.col("hash").alias("old_hash")), new.select("file_path", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "dirty").otherwise("same")
    return o.join(n, "file_path", "full_outer").select("file_path", status.alias("status"))


def affected_classes(diff: DataFrame, provenance: DataFrame) -> DataFrame:
    """class_fqn of all classes that came from dirty or deleted files. `provenance`: file_path, class_fqn."""
    return provenance.join(diff.where("status in ('dirty', 'deleted')"), "file_path", "left_semi").select("class_fqn").distinct()


def purge(facts: dict[str, DataFrame], classes: DataFrame) -> dict[str, DataFrame]:
    """Fact tables without the rows of `classes` (class_fqn). A row belongs to the class whose method it stands in."""
    gone = classes.select(F.col("class_fqn").alias("_gone")).distinct()
    out = dict(facts)
    for name, (column, is_method) in OWNERS.items():
        if name in facts:
            owner = N.class_of_method(F.col(column)) if is_method else F.col(column)
            out[name] = facts[name].withColumn("_owner", owner).join(gone, F.col("_owner") == F.col("_gone"), "left_anti").drop("_owner")
    return out


def delta(new: DataFrame, loaded: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key `loaded` lacks, once each: what a delta-only sink writes."""
    return new.dropDuplicates(key).join(loaded.select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key. Keys within `new` are to be distinct."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def config_changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether any configuration file is new, changed or gone."""
    return not snapshot_diff(old, new).where("status <> 'same'").isEmpty()


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """`files` (content_hash, ...) whose content is not in `cache` (content_hash), one row for each content."""
    return files.dropDuplicates(["content_hash"]).join(cache.select("content_hash").distinct(), "content_hash", "left_anti")
