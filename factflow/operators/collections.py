"""Collections by method name: which element, key or value slots a call writes, copies or reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Method names and what a call of that name does.
WRITES_ELEMENT = ["add", "addElement", "offer", "offerFirst", "offerLast", "push"]
READS_ELEMENT = ["get", "remove", "pop", "poll", "pollFirst", "pollLast", "peek", "peekFirst", "peekLast", "first", "last", "element"]
#: (method, effect, slot, argument or null, number of arguments or null)
RULES = (
    [(m, "write", "[element]", 0, None) for m in WRITES_ELEMENT if m != "add"]
    + [("add", "write", "[element]", 0, 1), ("add", "write", "[element]", 1, 2), ("addAll", "copy", "[element]", 0, None)]
    + [(m, "read", "[element]", None, None) for m in READS_ELEMENT]
    + [("put", "write", "[key]", 0, None), ("put", "write", "[value]", 1, None), ("put", "read", "[value]", None, None)]
    + [("putAll", "copy", "[key]", 0, None), ("putAll", "copy", "[value]", 0, None), ("keySet", "view", "[key]", None, None), ("values", "view", "[value]", None, None)]
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "method_name string, effect string, slot string, arg_index int, n_args int")


def model(calls: DataFrame, arguments: DataFrame, receiver_types: DataFrame | None = None) -> DataFrame:
    """Assignments that collection calls stand for: lhs, rhs, assignment_type, method_fqn.

    `receiver_types` (receiver, type) makes `get` of a map read its values. A write puts an argument into the receiver's
    slot, a copy moves the argument's slot, a read gives the slot to the call's left side, a view makes it the elements of
    the left side.
    """
    table = F.broadcast(rules(calls.sparkSession))  # a fixed list of some thirty rows
    n_args = arguments.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"))
    hit = calls.where("receiver is not null").join(table, "method_name").join(n_args, "call_id", "left").where(F.col("n_args").isNull() | (F.col("n_args") == F.coalesce("_n", F.lit(0))))
    if receiver_types is not None:
        maps = receiver_types.where(F.contains(F.lower("type"), F.lit("map"))).select("receiver", F.lit(True).alias("_map")).distinct()
        hit = hit.join(maps, "receiver", "left").withColumn("slot", F.when((F.col("method_name") == "get") & F.col("_map"), "[value]").otherwise(F.col("slot"))).drop("_map")
    at = lambda v: F.concat(F.col(v), F.lit("."), F.col("slot"))
    row = lambda df, lhs, rhs, kind: df.select(lhs.alias("lhs"), rhs.alias("rhs"), F.lit(kind).alias("assignment_type"), "method_fqn")
    given = hit.join(arguments.select("call_id", "arg_index", "arg_var"), ["call_id", "arg_index"])
    write = row(given.where("effect = 'write'"), at("receiver"), F.col("arg_var"), "FIELD_WRITE")
    temp = F.concat("method_fqn", F.lit("#temp_coll_"), "call_id", F.lit("_"), "slot")
    copy = given.where("effect = 'copy'")
    copied = row(copy, temp, at("arg_var"), "FIELD_READ").unionByName(row(copy, at("receiver"), temp, "FIELD_WRITE"))
    read = row(hit.where("effect = 'read' and lhs is not null"), F.col("lhs"), at("receiver"), "FIELD_READ")
    view = hit.where("effect = 'view' and lhs is not null")
    viewed = row(view, temp, at("receiver"), "FIELD_READ").unionByName(row(view, F.concat("lhs", F.lit(".[element]")), temp, "FIELD_WRITE"))
    return write.unionByName(copied).unionByName(read).unionByName(viewed).distinct()
