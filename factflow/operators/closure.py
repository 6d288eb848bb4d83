"""Recursive relations: reachability, least distances and fixpoints of several rules.

Every loop is semi-naive: a round joins only what the last one found, and an anti-join keeps what is new. A round's new
rows are written to the shared folder, which cuts the plan, outlives any executor, and gives Spark the sizes by which it
picks a broadcast or a shuffle for the next round. What the driver gets is one count a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.shared import stored, stored_rows

#: More rounds than any of these relations needs; going past it is an error, never a cut result.
MOST_ROUNDS = 200


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], name: str = "fixpoint", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """All rows that follow from `seed` by `step`, which maps the last round's new rows to candidates.

    Rows are told apart by `key`. Terminates because the rows of a finite domain run out.
    """
    fresh = stored(seed.dropDuplicates(key), name)
    known = [fresh]
    for _ in range(most_rounds):
        found = step(fresh).dropDuplicates(key).join(union(known), key, "left_anti")
        fresh, n = stored_rows(found.select(*seed.columns), name)
        if not n:
            return union(known)
        known.append(fresh)
        if len(known) > 8:
            known = [stored(union(known), name)]
    raise RuntimeError(f"{name}: no fixpoint after {most_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Nodes that `seeds` (node) reach over `edges` (src, dst), seeds included: node. Cycles are no trouble."""
    hops = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    return fixpoint(
        seeds.select("node").where("node is not null"), lambda new: new.join(hops, new["node"] == hops["src"]).select(F.col("dst").alias("node")), ["node"], "reach", most_rounds
    )


def pairs(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Transitive closure of `edges` (src, dst): src, dst, a row for each pair with a path of one or more edges."""
    hops = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    far = hops.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    return fixpoint(hops, lambda new: new.join(far, new["dst"] == far["mid"]).select("src", F.col("to").alias("dst")), ["src", "dst"], "pairs", most_rounds)


def distances(edges: DataFrame, nodes: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Least number of edges from each of `nodes` (node) to each node it reaches, itself at 0: src, dst, dist.

    Rounds go in the order of distance, so the first time that a pair is found is its least.
    """
    hops = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    far = hops.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    start = nodes.where("node is not null").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist"))
    return fixpoint(
        start, lambda new: new.join(far, new["dst"] == far["mid"]).select("src", F.col("to").alias("dst"), (F.col("dist") + 1).alias("dist")), ["src", "dst"], "distances", most_rounds
    )
