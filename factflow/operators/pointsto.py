"""Points-to sets and the call graph: field-sensitive, with virtual dispatch and one level of call contexts.

All flow is one relation, copies between (context, variable) pairs: assignments, arguments, receivers, returns and
summaries alike. Field writes and reads join a base's objects with stored fields. The loop is semi-naive over three
deltas (points-to rows, field rows, newly active methods).

Static callees are a second stratum: once virtual flow is quiet, all calls whose receiver points to nothing (or that have
none) fall back to their static callee; then virtual flow runs until it is quiet again, and so on. So the result does not
depend on the order of rows. A static callee stands for the declared method of its class, name and number of parameters.
Event and asynchronous calls, and advices, are the third.

Facts of a checked size (`LOCAL_FACTS`), with bounded consequences (`LOCAL_ROWS`), are solved in the memory of one task
by `worklist`; the rules and the result are the same. All else goes round by round over shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factflow.functions import names as N
from factflow.operators import callgraph, closure, extensions, hierarchy, worklist
from factflow.shared import scratch_path, stored, stored_rows

PTS = ["context", "var", "alloc_context", "alloc"]
FLD = ["alloc_context", "alloc", "field", "value_context", "value"]
EDGE = ["caller_context", "caller", "callee_context", "callee"]
#: Steps along known flow that a round takes.
HOPS = 3
#: Most fact rows that one task reads whole, and most rows that it may derive from them before it gives up.
LOCAL_FACTS, LOCAL_ROWS = 2_000_000, 4_000_000
#: Points-to rows that a task makes of hubs.
JOINED = 4_000_000
FLOW = ["src_context", "src", "dst_context", "dst"]


@dataclass
class Facts:
    """Fact tables that the solver reads; `summaries` (method_fqn, param_index) and the annotations may be missing.

    call_id and alloc_id are keys: of several classes of one object the smallest counts.
    """

    hierarchy: DataFrame  # class_fqn, parent_fqn
    declarations: DataFrame  # method_fqn, class_fqn, method_name, params
    allocations: DataFrame  # alloc_id, class_fqn, method_fqn
    assignments: DataFrame  # lhs, rhs, assignment_type, method_fqn
    calls: DataFrame  # call_id, method_fqn, receiver, method_name, lhs, static_callee
    arguments: DataFrame  # call_id, arg_index, arg_var
    summaries: DataFrame | None = None
    method_annotations: DataFrame | None = None
    variable_types: DataFrame | None = None  # var, type


@dataclass
class Solution:
    """What follows from the facts. `sensitive`: whether call contexts were told apart."""

    pts: DataFrame
    fields: DataFrame
    edges: DataFrame
    sensitive: bool

    def call_edges(self) -> DataFrame:
        """caller, callee, caller_context, callee_context, is_virtual: one row for each key, virtual if any way is."""
        return self.edges.groupBy(*EDGE).agg(F.max("is_virtual").alias("is_virtual")).select("caller", "callee", "caller_context", "callee_context", "is_virtual")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class _Relation:
    """A growing set of rows: all of it, and what the last round added."""

    def __init__(self, name: str, columns: list[str], spark: SparkSession, types: str):
        self.name, self.columns = name, columns
        self.none = self.all = self.delta = empty(spark, types)
        self.fresh, self.parts = False, 0

    def add(self, candidates: list[DataFrame]) -> bool:
        """Keep what is new among `candidates`; with none there is nothing to run."""
        self.fresh, self.delta = False, self.none
        if not candidates:
            return False
        rows = closure.union([c.select(*self.columns) for c in candidates]).distinct()
        new, n = stored_rows(rows.join(self.all, self.columns, "left_anti").select(*self.columns) if self.parts else rows, self.name)
        if not n:
            return False
        self.fresh, self.delta = True, new
        self.all = self.all.unionByName(new) if self.parts else new
        self.parts += 1
        if self.parts % 6 == 0:
            self.all = stored(self.all, self.name)
        return True


def _strings(columns: list[str]) -> str:
    return ", ".join(f"{c} STRING" for c in columns)


def _above(facts: Facts) -> DataFrame:
    """Rows of the hierarchy that dispatch may climb: those of classes with objects, and of classes that are parents."""
    asked = facts.allocations.select("class_fqn").union(facts.hierarchy.select("parent_fqn")).distinct()
    return facts.hierarchy.select("class_fqn", "parent_fqn").join(asked, "class_fqn", "left_semi")


def _fact_rows(facts: Facts) -> DataFrame:
    """All fact tables in one: kind and six texts."""
    tables = {
        "hierarchy": _above(facts),
        "declarations": facts.declarations.select("method_fqn", "class_fqn", "method_name", "params"),
        "allocations": facts.allocations.select("alloc_id", "class_fqn"),
        "assignments": facts.assignments.select("lhs", "rhs", "assignment_type", "method_fqn"),
        "calls": facts.calls.select("call_id", "method_fqn", "receiver", "method_name", "lhs", "static_callee"),
        "arguments": facts.arguments.select("call_id", "arg_index", "arg_var"),
        "methods": closure.union([f.select("method_fqn") for f in (facts.assignments, facts.calls, facts.allocations)]).where("method_fqn is not null").distinct(),
    }
    if facts.summaries is not None:
        tables["summaries"] = facts.summaries.select("method_fqn", "param_index")
    return closure.union([_as_rows(kind, df) for kind, df in tables.items()])


def _as_rows(kind: str, df: DataFrame) -> DataFrame:
    texts = [F.col(c).cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (6 - len(df.columns))
    return df.select(F.lit(kind).alias("kind"), *[t.alias(f"c{k}") for k, t in enumerate(texts)])


def _local(rows: DataFrame, batches: list[tuple[DataFrame, DataFrame]], events: bool, context_limit: int, supernode_limit: int, most: int) -> dict[str, DataFrame] | None:
    """Relations by name, from one task that holds all `rows`; None if it would derive over `most` rows."""

    n_batches = len(batches)

    def solved(parts):
        import pyarrow as pa

        tables: dict[str, list[tuple]] = {k: [] for k in ("hierarchy", "declarations", "allocations", "assignments", "calls", "arguments", "methods", "summaries")}
        widths = {"hierarchy": 2, "declarations": 4, "allocations": 2, "assignments": 4, "calls": 6, "arguments": 3, "methods": 1, "summaries": 2, "pts": 4, "edges": 5}
        for part in parts:
            columns = [part.column(k).to_pylist() for k in range(part.num_columns)]
            for kind, *row in zip(*columns, strict=True):
                tables.setdefault(kind, []).append(tuple(row[: widths[kind.split(":")[0]]]))
        calls = tables["calls"]
        tables["methods"] = [m for (m,) in tables["methods"]]
        sites: dict[str, int] = {}
        for c in calls:
            if c[5] is not None:
                sites[c[5]] = sites.get(c[5], 0) + 1
        handled = {c[0] for c in calls if events and (c[3] == "publishEvent" or (c[3] is not None and "publishEvent" in (c[5] or "")))}
        out: dict[str, list] = {"kind": [], **{f"c{k}": [] for k in range(5)}, "n": []}
        schema = pa.schema([("kind", pa.string()), *[(f"c{k}", pa.string()) for k in range(5)], ("n", pa.int32())])
        try:
            supers = {t for t, n in sites.items() if n > supernode_limit}
            # the third stratum reads what hubs leave out
            plain = events or len(calls) <= context_limit
            run = worklist.Worklist(tables, len(calls) <= context_limit, supers, handled, most) if plain else worklist.Hubbed(tables, supers, handled, most)
            run.run()
            for k in range(n_batches):
                run.add(tables.get(f"pts:{k}", []), [(*e[:4], int(e[4])) for e in tables.get(f"edges:{k}", [])])
        except worklist.TooLarge:
            yield pa.RecordBatch.from_pylist([{"kind": "too large"}], schema)
            return
        for kind, row in run.rows():
            out["kind"].append(kind)
            n = row[-1] if kind in ("edges", "resolved") else None
            texts = row[:-1] if n is not None else row
            for k in range(5):
                out[f"c{k}"].append(texts[k] if k < len(texts) else None)
            out["n"].append(n)
            if len(out["n"]) >= 50_000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, schema)

    extra = [_as_rows(f"{kind}:{k}", df) for k, both in enumerate(batches) for kind, df in zip(("pts", "edges"), both, strict=True)]
    seen = Observation()
    done = closure.union([rows, *extra]).coalesce(1).mapInArrow(solved, "kind STRING, c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING, n INT").observe(seen, F.count_if(F.col("kind") == "too large").alias("n"))
    # a folder for each relation: none reads another's rows
    path = scratch_path(rows.sparkSession, "solved")
    done.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    if seen.get.get("n"):
        return None
    columns = {"pts": PTS, "fields": FLD, "edges": [*EDGE, "is_virtual"], "active": ["method_fqn", "context"], "resolved": ["call_id", "context", "target", "is_virtual"]}
    whole = rows.sparkSession.read.schema("c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING, n INT, kind STRING").parquet(path)
    part = lambda kind, names: whole.where(F.col("kind") == kind).select(*[F.col("n" if c == "is_virtual" else f"c{k}").alias(c) for k, c in enumerate(names)])
    out = {kind: part(kind, names) for kind, names in columns.items()}
    hubs = part("hub", ["hub", "alloc_context", "alloc"])
    if events or hubs.isEmpty():
        return out
    values = hubs.toDF("hub", "value_context", "value")
    of_each = part("hub:all", ["hub", "field", "value_context", "value"]).unionByName(part("hub:both", ["base", "field", "hub"]).join(values, "hub").drop("hub").withColumnRenamed("base", "hub"))
    fields = part("hub:fields", ["hub", "alloc_context", "alloc", "field"]).join(values, "hub").unionByName(of_each.join(hubs, "hub"))
    edges = part("hub:edges", ["group", "caller"]).join(part("hub:callees", ["group", "callee"]), "group").select(F.lit("").alias("caller_context"), "caller", F.lit("").alias("callee_context"), "callee", F.lit(1).alias("is_virtual"))
    out["pts"] = out["pts"].unionByName(_spread(part("hub:pts", ["hub", "context", "var"]), hubs).select(*PTS))
    out["fields"] = out["fields"].unionByName(fields.select(*FLD)).distinct()
    out["edges"] = out["edges"].unionByName(edges).distinct()
    return out


def _spread(places: DataFrame, objects: DataFrame) -> DataFrame:
    """Join by hub: few rows on both sides make many, so tasks are counted by what comes out, and a hub's places are dealt."""
    counts = places.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(objects.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), "hub")
    n = -(-int(counts.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 1) // JOINED)
    dealt = places.withColumn("part", F.pmod(F.xxhash64("var"), F.lit(n))).repartition(n, "hub", "part")
    each = objects.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("part", F.col("part").cast("bigint")).repartition(n, "hub", "part")
    return dealt.hint("merge").join(each, ["hub", "part"])


def _solve_local(spark: SparkSession, facts: Facts, context_limit: int, supernode_limit: int, local_facts: int, local_rows: int, most_rounds: int) -> Solution | None:
    rows, n_rows = stored_rows(_fact_rows(facts), "facts")
    if n_rows > local_facts:
        return None
    sensitive, events = callgraph.context_sensitive(rows.where("kind = 'calls'"), context_limit), facts.method_annotations is not None
    batches: list[tuple[DataFrame, DataFrame]] = []
    ext = None
    for _ in range(most_rounds):
        got = _local(rows, batches, events, context_limit, supernode_limit, local_rows)
        if got is None:
            return None
        if events:
            if ext is None:
                alloc = stored(facts.allocations.groupBy("alloc_id").agg(F.min("class_fqn").alias("class_fqn")), "alloc-types")
                ext = extensions.Extensions(facts, stored(hierarchy.ancestors(facts.hierarchy, facts.declarations), "ancestors"), alloc)
            pts, edges = ext.third(facts.calls, got["active"], got["pts"], got["edges"], got["resolved"], F.lit(sensitive))
            pts, n = stored_rows(pts.distinct().join(got["pts"], PTS, "left_anti").select(*PTS), "extension-pts")
            edges, m = stored_rows(edges.distinct().join(got["edges"], [*EDGE, "is_virtual"], "left_anti").select(*EDGE, "is_virtual"), "extension-edges")
            if n or m:
                batches.append((pts, edges))
                continue
        return Solution(got["pts"], got["fields"], got["edges"], sensitive)
    raise RuntimeError(f"points-to: no fixpoint after {most_rounds} rounds")


def solve(
    spark: SparkSession, facts: Facts, context_limit: int = callgraph.CONTEXT_LIMIT, supernode_limit: int = callgraph.SUPERNODE_LIMIT, most_rounds: int = closure.MOST_ROUNDS,
    local_facts: int = LOCAL_FACTS, local_rows: int = LOCAL_ROWS,
) -> Solution:
    """Run all rules to their fixpoint. Rows with null keys take no part; an empty fact table makes empty relations.

    Over `context_limit` call sites all contexts are one: the result then has no call contexts and `Solution.sensitive` is
    False. A static callee of over `supernode_limit` sites is not entered: what it returns is one object named after it.
    Both are rules of the analysis, parameters here, and hold alike in both ways of solving. `local_facts` = 0 keeps the
    work out of a single task at any size.
    """
    if local_facts:
        found = _solve_local(spark, facts, context_limit, supernode_limit, local_facts, local_rows, most_rounds)
        if found is not None:
            return found
    return _solve_rounds(spark, facts, context_limit, supernode_limit, most_rounds)


def _static_targets(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """`calls` with static_target: the declared method of the static callee's class, name and number of parameters (the
    smallest of several), else the static callee as it stands."""
    declared = (
        declarations.where("method_fqn is not null").groupBy(F.col("class_fqn").alias("_class"), F.col("method_name").alias("_name"), N.param_count(F.col("method_fqn")).alias("_n"))
        .agg(F.min("method_fqn").alias("_declared"))
    )
    static = F.col("static_callee")
    bare = N.strip_signature(static)
    named = calls.withColumn("_class", F.when(F.contains(static, F.lit("(")) & F.contains(bare, F.lit(".")), N.class_of_method(static))).withColumn("_name", F.substring_index(bare, ".", -1)).withColumn("_n", N.param_count(static))
    return named.join(declared, ["_class", "_name", "_n"], "left").withColumn("static_target", F.coalesce("_declared", static)).drop("_class", "_name", "_n", "_declared")


def _solve_rounds(spark: SparkSession, facts: Facts, context_limit: int, supernode_limit: int, most_rounds: int) -> Solution:
    alloc = stored(facts.allocations.groupBy("alloc_id").agg(F.min("class_fqn").alias("class_fqn")), "alloc-types")
    assign = facts.assignments.select("lhs", "rhs", "assignment_type", "method_fqn").distinct()
    sensitive = callgraph.context_sensitive(facts.calls, context_limit)
    calls = stored(_static_targets(facts.calls.withColumn("sig", F.coalesce(N.signature_params(F.col("static_callee")), F.lit(""))), facts.declarations), "calls")
    args = facts.arguments.select("call_id", "arg_index", "arg_var")
    supers = callgraph.supernodes(facts.calls, supernode_limit).select(F.col("static_callee").alias("target"))
    summaries = facts.summaries if facts.summaries is not None else empty(spark, "method_fqn STRING, param_index INT")
    has_calls, third_stratum = not calls.isEmpty(), facts.method_annotations is not None
    anc = dispatch = ext = None
    standard = calls
    if has_calls or third_stratum:
        anc = stored(hierarchy.ancestors(facts.hierarchy, facts.declarations), "ancestors")
        wanted = (
            alloc.select(F.col("class_fqn")).distinct().join(anc, "class_fqn")
            .join(facts.declarations.select(F.col("class_fqn").alias("ancestor"), "method_name"), "ancestor")
            .join(calls.where("receiver is not null").select("method_name", "sig").distinct(), "method_name")
            .select(F.col("class_fqn").alias("alloc_type"), "method_name", "sig")
        )
        dispatch = stored(hierarchy.dispatch(anc, facts.declarations, wanted), "dispatch")
        ext = extensions.Extensions(facts, anc, alloc)
        handled_names = ext.handled(calls)
        standard = stored(calls.join(handled_names, "call_id", "left_anti"), "standard-calls")

    pts, fld = _Relation("pts", PTS, spark, _strings(PTS)), _Relation("fields", FLD, spark, _strings(FLD))
    flow, active = _Relation("flow", FLOW, spark, _strings(FLOW)), _Relation("active", ["method_fqn", "context"], spark, "method_fqn STRING, context STRING")
    edges = _Relation("edges", [*EDGE, "is_virtual"], spark, _strings(EDGE) + ", is_virtual INT")
    reso = _Relation("resolved", ["call_id", "context", "target", "is_virtual"], spark, "call_id STRING, context STRING, target STRING, is_virtual INT")

    methods = closure.union([facts.assignments.select("method_fqn"), facts.calls.select("method_fqn"), facts.allocations.select("method_fqn")])
    pending_active = [methods.where("method_fqn is not null").distinct().withColumn("context", F.lit(""))]
    pending_pts: list[DataFrame] = []
    pending_edges: list[DataFrame] = []
    kinds = {r.assignment_type for r in assign.select("assignment_type").distinct().collect()}
    writes = stored(assign.where("assignment_type = 'FIELD_WRITE'").select("method_fqn", N.field_base(F.col("lhs")).alias("base"), N.field_name(F.col("lhs")).alias("field"), F.col("rhs").alias("src")), "writes")
    reads = stored(assign.where("assignment_type = 'FIELD_READ'").select("method_fqn", N.field_base(F.col("rhs")).alias("base"), N.field_name(F.col("rhs")).alias("field"), F.col("lhs").alias("dst")), "reads")
    copies = stored(assign.where("assignment_type = 'COPY'").select("method_fqn", F.col("rhs").alias("src"), F.col("lhs").alias("dst")), "copies")
    made = stored(assign.where("assignment_type = 'ALLOC'").select("method_fqn", F.col("lhs").alias("var"), F.col("rhs").alias("alloc")), "made")
    has_slots = not assign.where("lhs like 'SpringBeanAlloc:%.%'").isEmpty()

    of = lambda p, var, *out: p.select("context", F.col("var").alias(var), F.col("alloc_context").alias(out[0]), F.col("alloc").alias(out[1]))
    moved = lambda p, f: p.join(f, (p["context"] == f["src_context"]) & (p["var"] == f["src"])).select(F.col("dst_context").alias("context"), F.col("dst").alias("var"), "alloc_context", "alloc")
    read = lambda x, p, f: x.join(of(p, "base", "alloc_context", "alloc"), ["context", "base"]).join(f, ["alloc_context", "alloc", "field"]).select("context", F.col("dst").alias("var"), F.col("value_context").alias("alloc_context"), F.col("value").alias("alloc"))
    write = lambda x, p, q: x.join(of(p, "base", "alloc_context", "alloc"), ["context", "base"]).join(of(q, "src", "value_context", "value"), ["context", "src"]).select(*FLD)
    fall, sums = False, stored(summaries, "summaries")
    for _ in range(most_rounds):
        grew = active.add(pending_active)
        next_pts, next_fld, flows, pending_active, found_edges = [], [], [], [], list(pending_edges)
        next_pts += pending_pts
        on = active.all
        if has_calls:
            # resolved calls: virtual ones by the objects of their receivers, later static ones
            live = standard.join(on, "method_fqn")
            typed = []
            if pts.fresh:
                typed.append(live.join(pts.delta.select("context", F.col("var").alias("receiver"), "alloc"), ["context", "receiver"]).select(*standard.columns, "context", "alloc"))
            if active.fresh and pts.parts:
                typed.append(standard.join(active.delta, "method_fqn").join(pts.all.select("context", F.col("var").alias("receiver"), "alloc"), ["context", "receiver"]).select(*standard.columns, "context", "alloc"))
            candidates = []
            if typed:
                t = closure.union(typed).join(alloc, F.col("alloc") == F.col("alloc_id")).withColumnRenamed("class_fqn", "alloc_type")
                candidates.append(t.join(dispatch, ["alloc_type", "method_name", "sig"]).select("call_id", "context", "target", F.lit(1).alias("is_virtual")))
            if fall:
                silent = live.where("static_callee is not null").join(pts.all.select("context", F.col("var").alias("receiver")).distinct(), ["context", "receiver"], "left_anti")
                candidates.append(silent.select("call_id", "context", F.col("static_target").alias("target"), F.lit(0).alias("is_virtual")))
            if reso.add(candidates):
                grew = True
                new = reso.delta.join(calls, "call_id").withColumn("callee_context", callgraph.callee_context(F.col("context"), F.col("call_id"), F.lit(sensitive)))
                found_edges.append(new.select(F.col("context").alias("caller_context"), N.strip_signature(F.col("method_fqn")).alias("caller"), "callee_context", N.strip_signature(F.col("target")).alias("callee"), "is_virtual"))
                is_super = new.join(supers, "target", "left_semi")
                plain = new.join(supers, "target", "left_anti")
                summed = plain.join(sums.select(F.col("method_fqn").alias("target"), "param_index"), "target")
                body = plain.join(sums.select(F.col("method_fqn").alias("target")).distinct(), "target", "left_anti")
                by_summary = summed.join(args.withColumnRenamed("call_id", "_call"), (F.col("call_id") == F.col("_call")) & (F.col("param_index") == F.col("arg_index")))
                flows += [
                    by_summary.where("lhs is not null").select(F.col("context").alias("src_context"), F.col("arg_var").alias("src"), F.col("context").alias("dst_context"), F.col("lhs").alias("dst")),
                    body.where("receiver is not null").select(F.col("context").alias("src_context"), F.col("receiver").alias("src"), F.col("callee_context").alias("dst_context"), F.concat("target", F.lit("#this")).alias("dst")),
                    body.join(args, "call_id").select(F.col("context").alias("src_context"), F.col("arg_var").alias("src"), F.col("callee_context").alias("dst_context"), F.concat("target", F.lit("#p"), F.col("arg_index").cast("string")).alias("dst")),
                    body.where("lhs is not null").select(F.col("callee_context").alias("src_context"), F.concat("target", F.lit("#return")).alias("src"), F.col("context").alias("dst_context"), F.col("lhs").alias("dst")),
                ]
                next_pts.append(is_super.where("lhs is not null").select("context", F.col("lhs").alias("var"), F.lit("").alias("alloc_context"), F.concat(F.lit("SupernodeReturn:"), "target").alias("alloc")))
                # a full name becomes active in the context that it was called in
                pending_active.append(body.select(F.col("target").alias("method_fqn"), F.col("callee_context").alias("context")))
        if active.fresh:
            if "COPY" in kinds:
                flows.append(copies.join(active.delta, "method_fqn").select(F.col("context").alias("src_context"), "src", F.col("context").alias("dst_context"), "dst"))
            next_pts.append(made.join(active.delta, "method_fqn").select("context", "var", F.col("context").alias("alloc_context"), "alloc"))
        grew |= flow.add([f.where("src is not null") for f in flows])
        grew |= edges.add(found_edges)
        # flow from new rows and along new flow; writes and reads with either side new, or in newly active methods
        if pts.fresh and flow.parts:
            # several hops a round: a call's way through this, return and left side is one round instead of three
            hop = pts.delta
            for _hop in range(HOPS):
                hop = moved(hop, flow.all).select(*PTS).distinct()
                next_pts.append(hop)
        if flow.fresh and pts.parts:
            next_pts.append(moved(pts.all, flow.delta))
        if "FIELD_READ" in kinds and fld.parts and pts.parts:
            r = reads.join(on, "method_fqn")
            next_pts += [read(r, pts.delta, fld.all)] * pts.fresh + [read(r, pts.all, fld.delta)] * fld.fresh
            if active.fresh:
                next_pts.append(read(reads.join(active.delta, "method_fqn"), pts.all, fld.all))
        if "FIELD_WRITE" in kinds and pts.parts:
            w = writes.join(on, "method_fqn")
            next_fld += [write(w, pts.delta, pts.all), write(w, pts.all, pts.delta)] if pts.fresh else []
            if active.fresh:
                next_fld.append(write(writes.join(active.delta, "method_fqn"), pts.all, pts.all))
        if has_slots and pts.fresh:
            # what is injected into a field slot is in that field of every object of the class
            part = lambda k: F.regexp_extract("var", r"(?s)^SpringBeanAlloc:(.*)\.([^.]*)$", k)
            slots = pts.delta.where("var like 'SpringBeanAlloc:%.%'").select(part(1).alias("class_fqn"), part(2).alias("field"), F.col("alloc_context").alias("value_context"), F.col("alloc").alias("value"))
            next_fld.append(slots.join(alloc, "class_fqn").select(F.lit("").alias("alloc_context"), F.col("alloc_id").alias("alloc"), "field", "value_context", "value"))
        # plans of this round's candidates are fixed by now: neither relation's growth changes the other's
        grew |= fld.add(next_fld)
        grew |= pts.add(next_pts)
        pending_pts, pending_edges = [], []
        fell, fall = fall, False
        if grew:
            continue
        if has_calls and not fell:
            # virtual flow is quiet: the next round, and only that, takes static callees
            fall = True
            continue
        if facts.method_annotations is None:
            return Solution(pts.all, fld.all, edges.all, sensitive)
        more_pts, more_edges = ext.third(calls, active.all, pts.all, edges.all, reso.all, F.lit(sensitive))
        more_pts = stored(more_pts.distinct().join(pts.all, PTS, "left_anti"), "extension-pts")
        more_edges = stored(more_edges.distinct().join(edges.all, [*EDGE, "is_virtual"], "left_anti"), "extension-edges")
        pending_pts = [] if more_pts.isEmpty() else [more_pts]
        pending_edges = [] if more_edges.isEmpty() else [more_edges]
        if not pending_pts and not pending_edges:
            return Solution(pts.all, fld.all, edges.all, sensitive)
    raise RuntimeError(f"points-to: no fixpoint after {most_rounds} rounds")


def field_expressions(solution: Solution, assignments: DataFrame) -> DataFrame:
    """Points-to rows of the field expressions that assignments name: what the base's objects hold in the field."""
    exprs = assignments.where("assignment_type = 'FIELD_WRITE'").select(F.col("lhs").alias("expr")).union(assignments.where("assignment_type = 'FIELD_READ'").select("rhs")).distinct()
    split = exprs.select("expr", N.field_base(F.col("expr")).alias("var"), N.field_name(F.col("expr")).alias("field"))
    return (
        split.join(solution.pts, "var").join(solution.fields, ["alloc_context", "alloc", "field"])
        .select("context", F.col("expr").alias("var"), F.col("value_context").alias("alloc_context"), F.col("value").alias("alloc")).distinct()
    )
