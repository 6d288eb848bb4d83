"""Configuration files: properties, a YAML subset, and profile overlay."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.operators import spring
from factflow.sources.java import SKIPPED_DIRS

_NAME = re.compile(r"application(?:-([\w.-]+?))?\.(properties|ya?ml)$")


def _bare(v: str) -> str:
    v = v.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def parse_properties(text: str) -> list[tuple[str, str]]:
    """`key=value` or `key:value` lines; the first = counts, without one the first colon. Comments and bare lines are left out."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        sep = "=" if "=" in line else ":"
        key, found, value = line.partition(sep)
        if found:
            out.append((key.strip(), _bare(value)))
    return out


def parse_yaml(text: str) -> list[tuple[str, str]]:
    """Nested `key: value` lines as dotted keys; comments are cut, lists and anchors are not read."""
    out, stack = [], []
    for line in text.splitlines():
        body = re.sub(r"(?:^|\s)#.*$", "", line).rstrip()
        m = re.match(r"^( *)([^:\s][^:]*):(?:\s+(.*))?$", body)
        if not m or m[2].startswith("- "):
            continue
        indent = len(m[1])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        key = ".".join([*(k for _, k in stack), m[2].strip()])
        if m[3] and m[3].strip():
            out.append((key, _bare(m[3])))
        else:
            stack.append((indent, m[2].strip()))
    return out


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            m = _NAME.search(path)
            if m:
                text = (content or b"").decode("utf-8", "replace")
                rows += [(m[1] or "", k, v, n) for n, (k, v) in enumerate((parse_properties if m[2] == "properties" else parse_yaml)(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 3 else pa.string()) for k in range(4)], names=["profile", "key", "value", "pos"])


def config_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the configuration files under a folder, build and tool folders left out."""
    skipped = "|".join(map(re.escape, SKIPPED_DIRS))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "application*.{properties,yml,yaml}").load(path)
    return found.where(~F.col("path").rlike(f"/(?:{skipped})/"))


def entries(files: DataFrame) -> DataFrame:
    """profile (empty for the base file), key, value, pos."""
    return files.select("path", "content").mapInArrow(_entries, "profile STRING, key STRING, value STRING, pos INT")


def resolved(found: DataFrame) -> DataFrame:
    """key and value: the base file, overlaid by each active profile in the order in which the base names them."""
    active = found.where("profile = '' and key = 'spring.profiles.active'").groupBy().agg(F.max_by("value", "pos").alias("names"))
    named = active.select(F.posexplode(F.split("names", ",")).alias("n", "name")).select(F.trim("name").alias("profile"), (F.col("n") + 1).alias("layer"))
    layered = found.join(named, "profile", "left").withColumn("layer", F.when(F.col("profile") == "", 0).otherwise(F.col("layer"))).where("layer is not null")
    return spring.overlay(layered)
