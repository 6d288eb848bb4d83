"""Data-flow lineage: edges within and between methods, contraction of temporaries, and up- or downstream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.functions import names as N
from factflow.operators import closure
from factflow.shared import stored

EDGE = ["from_node", "to_node", "edge_type"]


def intra(assignments: DataFrame) -> DataFrame:
    """An edge from right to left for each assignment (lhs, rhs, assignment_type), allocations included."""
    return assignments.select(F.col("rhs").alias("from_node"), F.col("lhs").alias("to_node"), F.col("assignment_type").alias("edge_type"))


def resolved_calls(calls: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Targets of each call: the callees of its method in the call graph that bear the call's name, by caller and name
    and not by call site; if there are none, the static callee."""
    edge = call_edges.select(F.col("caller"), F.col("callee").alias("target"), F.substring_index("callee", ".", -1).alias("method_name")).distinct()
    keyed = calls.withColumn("caller", N.strip_signature(F.col("method_fqn")))
    return keyed.join(edge, ["caller", "method_name"], "left").withColumn("target", F.coalesce("target", "static_callee")).where("target is not null").drop("caller")


def inter(calls: DataFrame, arguments: DataFrame, call_edges: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges between methods: arguments to parameters, receiver to this, return to the call's left side.

    A stripped target stands for every declared method of that stripped name; an undeclared one for itself.
    """
    full = declarations.select(N.strip_signature(F.col("method_fqn")).alias("stripped"), F.col("method_fqn").alias("full")).distinct()
    targets = resolved_calls(calls, call_edges)
    known = targets.join(full, F.col("target") == F.col("stripped"), "left").withColumn("t", F.coalesce("full", "target"))
    args = known.join(arguments, "call_id").select(F.col("arg_var").alias("from_node"), F.concat(F.col("t"), F.lit("#p"), F.col("arg_index").cast("string")).alias("to_node"), F.lit("PASS_ARG").alias("edge_type"))
    recv = known.where("receiver is not null").select(F.col("receiver").alias("from_node"), F.concat("t", F.lit("#this")).alias("to_node"), F.lit("PASS_REC").alias("edge_type"))
    back = known.where("lhs is not null").select(F.concat("t", F.lit("#return")).alias("from_node"), F.col("lhs").alias("to_node"), F.lit("PASS_RET").alias("edge_type"))
    return closure.union([args, recv, back])


def merged(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, of the type with the highest priority (then the smallest name); no self-loops."""
    best = F.max_by("edge_type", F.struct(N.edge_priority(F.col("edge_type")).alias("p"), F.col("edge_type").alias("t")))
    return edges.where("from_node <> to_node").groupBy("from_node", "to_node").agg(best.alias("edge_type"))


def contracted(edges: DataFrame, most_rounds: int = closure.MOST_ROUNDS) -> DataFrame:
    """Remove temporaries with one edge in and one out, joining their neighbours by the edge of higher priority.

    Each round takes those whose predecessor is not taken in the same round (of a run of temporaries, every other one at
    least), so that rounds grow with the logarithm of the longest run. Of two neighbours the one with the smaller hash,
    then name, goes first. A temporary whose neighbours are the same node stays, as does one on a cycle of nothing else.
    """
    current = stored(merged(edges), "contract")
    for _ in range(most_rounds):
        ins = current.groupBy(F.col("to_node").alias("v")).agg(F.count(F.lit(1)).alias("n_in"), F.min("from_node").alias("pred"), F.min("edge_type").alias("t_in"))
        outs = current.groupBy(F.col("from_node").alias("v")).agg(F.count(F.lit(1)).alias("n_out"), F.min("to_node").alias("succ"), F.min("edge_type").alias("t_out"))
        ready = stored(
            ins.where((F.col("n_in") == 1) & N.is_collapsible(F.col("v"))).join(outs.where("n_out = 1"), "v").where("pred <> succ").select("v", "pred", "succ", "t_in", "t_out"), "contract-ready"
        )
        if ready.isEmpty():
            return current
        order = lambda c: F.struct(F.xxhash64(c), c)
        near = ready.select(F.col("v").alias("w"))
        is_near = lambda c: near.select(F.col("w").alias(c), F.lit(True).alias(f"{c}_ready"))
        marked = ready.join(is_near("pred"), "pred", "left").join(is_near("succ"), "succ", "left")
        # a run's local minimum by hash goes; neighbours are never both minima
        taken = stored(
            marked.where((F.col("pred_ready").isNull() | (order(F.col("v")) < order(F.col("pred")))) & (F.col("succ_ready").isNull() | (order(F.col("v")) < order(F.col("succ"))))).select("v", "pred", "succ", "t_in", "t_out"),
            "contract-taken",
        )
        joined = taken.select(
            F.col("pred").alias("from_node"), F.col("succ").alias("to_node"),
            F.when(N.edge_priority(F.col("t_out")) > N.edge_priority(F.col("t_in")), F.col("t_out")).otherwise(F.col("t_in")).alias("edge_type"),
        )
        gone = taken.select("v")
        rest = current.join(gone, F.col("from_node") == F.col("v"), "left_anti").join(gone, F.col("to_node") == F.col("v"), "left_anti")
        current = stored(merged(rest.unionByName(joined)), "contract")
    raise RuntimeError(f"contraction: no fixpoint after {most_rounds} rounds")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()


def query(edges: DataFrame, text: str, direction: str = "downstream") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges up- or downstream of the nodes that match `text`: (node, name) and (from_node, to_node, edge_type).

    Any direction but `upstream` is downstream. If no node matches, the text itself is the only node.
    """
    spark = edges.sparkSession
    found = nodes(edges).where(N.matches_node(F.col("node"), F.lit(text)))
    seeds = found if not found.isEmpty() else spark.createDataFrame([(text,)], "node string")
    ahead = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    if direction == "upstream":
        ahead = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = stored(closure.reach(ahead, seeds), "lineage")
    side = "to_node" if direction == "upstream" else "from_node"
    used = edges.join(seen, F.col(side) == F.col("node"), "left_semi").select(*EDGE).distinct()
    return seen.select("node", N.simple_name(F.col("node")).alias("name")), used
