"""Framework calls that plain dispatch does not see: published events, started threads, and advices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.functions import names as N
from factflow.operators import callgraph, hierarchy

# Annotations that make a method an advice.
ADVICES = ["Before", "After", "Around", "AfterThrowing", "AfterReturning"]


def is_event(c_name: Column, c_static: Column) -> Column:
    return (c_name == "publishEvent") | F.coalesce(F.contains(c_static, F.lit("publishEvent")), F.lit(False))


def event_targets(events: DataFrame, anc: DataFrame, listeners: DataFrame) -> DataFrame:
    """Listeners of published objects. `events`: call_id, context, alloc_context, alloc, event_class. Adds method_fqn."""
    heard = anc.join(listeners, anc["ancestor"] == listeners["event_type"]).select(anc["class_fqn"].alias("event_class"), "method_fqn")
    return events.join(heard, "event_class").distinct()


def advices(method_annotations: DataFrame) -> DataFrame:
    """advice (method_fqn) and pattern: each pattern of each advice's pointcut, with references to named pointcuts resolved
    within the advice's class."""
    ann = method_annotations.select("method_fqn", F.substring_index("annotation_name", ":", 1).alias("base"), F.regexp_extract("annotation_name", r"(?s)^[^:]*:(.*)$", 1).alias("expr")).where("expr <> ''")
    named = ann.where("base = 'Pointcut'").select(N.class_of_method(F.col("method_fqn")).alias("class_fqn"), F.substring_index(N.strip_signature(F.col("method_fqn")), ".", -1).alias("ref"), F.col("expr").alias("named"))
    uses = ann.where(F.col("base").isin(ADVICES)).select("method_fqn", "expr", N.class_of_method(F.col("method_fqn")).alias("class_fqn"), F.regexp_extract(F.trim("expr"), r"^([\w$]+)\(\s*\)$", 1).alias("ref"))
    full = uses.join(named, ["class_fqn", "ref"], "left").withColumn("expr", F.coalesce("named", "expr"))
    return full.select(F.col("method_fqn").alias("advice"), F.explode(N.pointcut_patterns(F.col("expr"))).alias("pattern")).distinct()


def advised(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of `targets` (target) and `patterns` (pattern, ...) that match, by equi-join.

    A method matches `p.*` if p is one of the prefixes of its name at a dot, and `p` if p is the method or its class. So
    each target goes out by its prefixes, at most one for each dot, and meets the patterns' own prefix.
    """
    p = F.trim("pattern")
    keyed = patterns.withColumn("_open", F.endswith(p, F.lit("*"))).withColumn("_key", F.regexp_replace(p, r"(?:\.\.\*|\.\*|\*)$", ""))
    stripped = N.strip_signature(F.col("target"))
    parts = F.split(stripped, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("_key"), (F.size(parts) - n).alias("_short")))
    # a prefix may end in a dot: the pattern's key is then an empty last part, which no name has
    out = targets.select(*targets.columns, F.explode(prefixes).alias("_p")).select(*targets.columns, "_p._key", "_p._short")
    return out.join(keyed, "_key").where(F.col("_open") | (F.col("_short") <= 1)).drop("_key", "_short", "_open")


class Extensions:
    """The third stratum of the solver: which calls it takes over, and what they add to points-to rows and edges."""

    def __init__(self, facts, anc: DataFrame, alloc: DataFrame):
        self.facts, self.anc, self.alloc = facts, anc, alloc
        self.annotations = facts.method_annotations

    def handled(self, calls: DataFrame) -> DataFrame:
        """call_id of the calls that are events: they have no standard flow."""
        if self.annotations is None:
            return calls.select("call_id").limit(0)
        return calls.where(is_event(F.col("method_name"), F.col("static_callee"))).select("call_id")

    def third(self, calls, active, pts, edges, resolved, sensitive) -> tuple[DataFrame, DataFrame]:
        """Rows for points-to (listener parameters) and for edges (listeners, started runnables, advices)."""
        spark = calls.sparkSession
        none_p = spark.createDataFrame([], "context STRING, var STRING, alloc_context STRING, alloc STRING")
        none_e = spark.createDataFrame([], "caller_context STRING, caller STRING, callee_context STRING, callee STRING, is_virtual INT")
        if self.annotations is None:
            return none_p, none_e
        live = calls.join(active, "method_fqn").withColumn("callee_context", callgraph.callee_context(F.col("context"), F.col("call_id"), sensitive))
        first = self.facts.arguments.where("arg_index = 0").select("call_id", "arg_var")
        objects = pts.join(self.alloc, F.col("alloc") == F.col("alloc_id")).select("context", F.col("var").alias("arg_var"), "alloc_context", "alloc", F.col("class_fqn").alias("event_class"))
        published = live.where(is_event(F.col("method_name"), F.col("static_callee"))).join(first, "call_id").join(objects, ["context", "arg_var"])
        listeners = hierarchy.listener_methods(self.annotations, self.facts.declarations, self.facts.hierarchy).withColumnRenamed("method_fqn", "listener")
        heard = published.join(self.anc.select(F.col("class_fqn").alias("event_class"), F.col("ancestor").alias("event_type")), "event_class").join(listeners, "event_type")
        edge = lambda df, target, virtual=1: df.select(F.col("context").alias("caller_context"), N.strip_signature(F.col("method_fqn")).alias("caller"), "callee_context", N.strip_signature(F.col(target)).alias("callee"), F.lit(virtual).alias("is_virtual"))
        more_p = heard.select("context", F.concat("listener", F.lit("#p0")).alias("var"), "alloc_context", "alloc")
        more_e = edge(heard, "listener").unionByName(self._started(live, pts, first, edge))
        patterns = advices(self.annotations)
        targets = resolved.join(calls.select("call_id", "method_fqn"), "call_id").withColumn("callee_context", callgraph.callee_context(F.col("context"), F.col("call_id"), sensitive))
        more_e = more_e.unionByName(edge(advised(targets.select("target", "context", "method_fqn", "callee_context").distinct(), patterns), "advice"))
        return more_p, more_e

    def _started(self, live: DataFrame, pts: DataFrame, first: DataFrame, edge) -> DataFrame:
        """Edges to `run`: of a started thread's class and of the runnables given to its constructor, or of the object
        given to execute and submit. Without objects, of every class under the declared type."""
        types = pts.join(self.alloc, F.col("alloc") == F.col("alloc_id")).select("context", F.col("var").alias("v"), F.col("class_fqn").alias("type")).distinct()
        if self.facts.variable_types is not None:
            declared = self.facts.variable_types.select(F.col("var").alias("v"), "type")
            under = declared.join(self.anc, declared["type"] == self.anc["ancestor"]).select("v", F.col("class_fqn").alias("type"))
        else:
            under = None
        runs = self.facts.declarations.where("method_name = 'run'").select(F.col("class_fqn").alias("type"), F.col("method_fqn").alias("run"))
        start = live.where("method_name = 'start' and receiver is not null")
        given = live.where("method_name in ('execute', 'submit')").join(first, "call_id").select(*live.columns, F.col("arg_var").alias("v"))
        made = live.where("method_name = '<init>'").join(first, "call_id").select(F.col("method_fqn"), "context", F.col("receiver").alias("built"), F.col("arg_var").alias("v"))
        # a constructor's receiver and a start's receiver alias if they share an object
        same = pts.select("context", F.col("var").alias("receiver"), "alloc", "alloc_context").join(pts.select("context", F.col("var").alias("built"), "alloc", "alloc_context"), ["context", "alloc", "alloc_context"]).select("context", "receiver", "built").distinct()
        passed = start.join(same, ["context", "receiver"]).join(made, ["method_fqn", "context", "built"]).select(*live.columns, "v")
        asked = start.select(*live.columns, F.col("receiver").alias("v")).unionByName(passed).unionByName(given)
        known = asked.join(types, ["context", "v"]).select(*asked.columns, "type")
        if under is not None:
            known = known.unionByName(asked.join(types.select("context", "v").distinct(), ["context", "v"], "left_anti").join(under, "v").select(*asked.columns, "type"))
        return edge(known.join(runs, "type"), "run").distinct()
