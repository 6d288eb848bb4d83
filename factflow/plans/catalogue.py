"""Named queries over projected facts, each with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.functions import names as N
from factflow.operators import callgraph, closure, collections, extensions, hierarchy, incremental, lineage, pointsto, spring
from factflow.plans.bridge import frame, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

METHOD_QUERIES = ["handle", "handle()", "handle(int)", "customer.3.handle", "3.handle(int)", "region.1.handle()", "nation.2.handle( )"]
NODE_QUERIES = ["turn0", "t()#turn2", "c1.t", "c1.t()", "t()#temp_call_lhs_1", "c3.t()#turn0", "temp_call_lhs_3"]
POINTCUTS = [
    ("adv.A.before()", "within(ECONOMY..*)"), ("adv.A.after()", "execution(* STANDARD.Brand1.*(..))"), ("adv.B.around()", "within(PROMO.Brand2) || within(SMALL.*)"),
    ("adv.B.x()", "execution(public void MEDIUM.Brand3.m7(..))"), ("adv.C.y()", "@annotation(Foo)"), ("adv.C.z()", "within(LARGE*)"),
]


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


def values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


GRAPH = f"SELECT from_node, to_node, {{best}} AS edge_type FROM ({sql('graph')}) g WHERE from_node <> to_node GROUP BY from_node, to_node"
_RANK = "CASE edge_type WHEN 'PASS_ARG' THEN 5 WHEN 'PASS_RET' THEN 4 WHEN 'PASS_REC' THEN 3 WHEN 'FIELD_READ' THEN 2 WHEN 'FIELD_WRITE' THEN 1 WHEN 'COPY' THEN 0 ELSE -1 END"
GRAPH = GRAPH.format(best=f"arg_max(edge_type, {_RANK} * 1000 + ascii(edge_type))")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.merged(frame(spark, sf_dir, "graph"))


def _closure_sql(a: str, b: str) -> str:
    return f"""
WITH RECURSIVE e AS ({GRAPH}), s(node) AS (
  SELECT DISTINCT node FROM (SELECT from_node AS node FROM e UNION SELECT to_node FROM e) x WHERE node LIKE '%#turn0'
  UNION SELECT e.{b} FROM s JOIN e ON e.{a} = s.node
)
SELECT node, CASE WHEN strpos(node, '#') > 0 THEN substr(node, strpos(node, '#') + 1) ELSE split_part(node, '.', -1) END AS name FROM s
"""


@query("lineage_downstream", _closure_sql("from_node", "to_node"))
def lineage_downstream(spark, sf_dir):
    return lineage.query(graph(spark, sf_dir), "turn0")[0]


@query("lineage_upstream", _closure_sql("to_node", "from_node"))
def lineage_upstream(spark, sf_dir):
    return lineage.query(graph(spark, sf_dir), "turn0", "upstream")[0]


@query(
    "lineage_query_edges",
    f"""
WITH RECURSIVE e AS ({GRAPH}), s(node) AS (
  SELECT DISTINCT node FROM (SELECT from_node AS node FROM e UNION SELECT to_node FROM e) x WHERE node LIKE '%.t()#turn2'
  UNION SELECT e.to_node FROM s JOIN e ON e.from_node = s.node
)
SELECT DISTINCT from_node, to_node, edge_type FROM e JOIN s ON e.from_node = s.node
""",
)
def lineage_query_edges(spark, sf_dir):
    return lineage.query(graph(spark, sf_dir), "t()#turn2")[1]


_ALL_EDGES = f"SELECT rhs AS from_node, lhs AS to_node, assignment_type AS edge_type FROM ({sql('assignments')}) a UNION ALL SELECT from_node, to_node, edge_type FROM ({sql('graph')}) g"


@query("lineage_edges_merged", f"SELECT from_node, to_node, arg_max(edge_type, {_RANK} * 1000 + ascii(edge_type)) AS edge_type FROM ({_ALL_EDGES}) x WHERE from_node <> to_node GROUP BY from_node, to_node")
def lineage_edges_merged(spark, sf_dir):
    return lineage.merged(lineage.intra(frame(spark, sf_dir, "assignments")).unionByName(frame(spark, sf_dir, "graph")))


_DECL, _CALLS, _ARGS, _EDGES = sql("declarations"), sql("calls"), sql("arguments"), sql("call_edges")
_INTER = f"""
WITH c AS (SELECT *, split_part(method_fqn, '(', 1) AS caller FROM ({_CALLS}) x), r AS (
  SELECT c.call_id, c.receiver, c.lhs, coalesce(e.callee, c.static_callee) AS target FROM c
  LEFT JOIN (SELECT DISTINCT caller, callee, split_part(callee, '.', -1) AS method_name FROM ({_EDGES}) y) e ON e.caller = c.caller AND e.method_name = c.method_name
), t AS (
  SELECT r.*, coalesce(d.method_fqn, r.target) AS t FROM r LEFT JOIN (SELECT DISTINCT split_part(method_fqn, '(', 1) AS s, method_fqn FROM ({_DECL}) z) d ON d.s = r.target WHERE r.target IS NOT NULL
)
SELECT a.arg_var AS from_node, t.t || '#p' || a.arg_index AS to_node, 'PASS_ARG' AS edge_type FROM t JOIN ({_ARGS}) a USING (call_id)
UNION ALL SELECT receiver, t || '#this', 'PASS_REC' FROM t WHERE receiver IS NOT NULL
UNION ALL SELECT t || '#return', lhs, 'PASS_RET' FROM t WHERE lhs IS NOT NULL
"""


@query("lineage_interproc", _INTER)
def lineage_interproc(spark, sf_dir):
    g = lambda n: frame(spark, sf_dir, n)
    return lineage.inter(g("calls"), g("arguments"), g("call_edges"), g("declarations"))


_P = f"SELECT from_node, to_node, edge_type FROM ({sql('paths')}) p"
_PRIO = lambda c: _RANK.replace("edge_type", c)


@query(
    "lineage_contracted",
    f"""
WITH RECURSIVE e AS ({_P}), d AS (
  SELECT v FROM (SELECT to_node AS v, count(*) AS n FROM e GROUP BY 1) i JOIN (SELECT from_node AS v, count(*) AS m FROM e GROUP BY 1) o USING (v) WHERE n = 1 AND m = 1 AND regexp_matches(v, '#temp_call_lhs_')
), w AS (
  SELECT from_node, to_node, edge_type FROM e WHERE from_node NOT IN (SELECT v FROM d)
  UNION ALL
  SELECT w.from_node, e.to_node, CASE WHEN {_PRIO("e.edge_type")} > {_PRIO("w.edge_type")} THEN e.edge_type ELSE w.edge_type END FROM w JOIN d ON w.to_node = d.v JOIN e ON e.from_node = d.v
)
SELECT from_node, to_node, edge_type FROM w WHERE to_node NOT IN (SELECT v FROM d)
""",
)
def lineage_contracted(spark, sf_dir):
    return lineage.contracted(frame(spark, sf_dir, "paths"))


@query("callgraph_outgoing", f"SELECT DISTINCT caller, callee, is_virtual FROM ({_EDGES}) e WHERE caller = 'u1' OR caller LIKE '%.u1'")
def callgraph_outgoing(spark, sf_dir):
    return callgraph.query(frame(spark, sf_dir, "call_edges"), "u1")


@query("callgraph_incoming", f"SELECT DISTINCT caller, callee, is_virtual FROM ({_EDGES}) e WHERE callee = 'region.2.handle'")
def callgraph_incoming(spark, sf_dir):
    return callgraph.query(frame(spark, sf_dir, "call_edges"), "2.handle", "incoming")


_BOUNDARY = "({c} = {q} OR ends_with({c}, '.' || {q}) OR ends_with({c}, '#' || {q}))"
_MATCH = f"""CASE WHEN ends_with(q, '()') THEN ends_with(c, '()') AND {_BOUNDARY.format(c="split_part(c, '(', 1)", q="left(q, len(q) - 2)")}
  WHEN strpos(q, '(') > 0 THEN ends_with(c, substr(q, strpos(q, '('))) AND {_BOUNDARY.format(c="split_part(c, '(', 1)", q="split_part(q, '(', 1)")}
  ELSE {_BOUNDARY.format(c="split_part(c, '(', 1)", q="q")} END"""


@query(
    "match_method_signature",
    f"SELECT method_fqn, text FROM (SELECT method_fqn, text, replace(method_fqn, ' ', '') AS c, replace(text, ' ', '') AS q FROM ({_DECL}) d, {values([(q,) for q in METHOD_QUERIES], 'text')}) x WHERE {_MATCH}",
)
def match_method_signature(spark, sf_dir):
    decl = frame(spark, sf_dir, "declarations").select("method_fqn")
    # the queries are a list of fixed length: each becomes a filter, not a join
    return closure.union([decl.where(N.matches_method(F.col("method_fqn"), F.lit(q))).withColumn("text", F.lit(q)) for q in METHOD_QUERIES])


def _node_sql() -> str:
    m = _MATCH.replace("(c", "(cm").replace("split_part(c,", "split_part(cm,")
    both = m.replace("q,", "qm,").replace("(q", "(qm").replace("= q ", "= qm ").replace("|| q)", "|| qm)")
    return f"""
WITH n AS (SELECT from_node AS node FROM ({sql("graph")}) g UNION SELECT to_node FROM ({sql("graph")}) h), x AS (
  SELECT node, text, replace(node, ' ', '') AS c, replace(text, ' ', '') AS q FROM n, {values([(q,) for q in NODE_QUERIES], "text")}
), y AS (
  SELECT *, CASE WHEN strpos(c, '#') > 0 THEN regexp_extract(c, '^(.*)#[^#]*$', 1) END AS cm, CASE WHEN strpos(q, '#') > 0 THEN regexp_extract(q, '^(.*)#[^#]*$', 1) END AS qm FROM x
), z AS (
  SELECT *, split_part(cm, '(', 1) AS cp, coalesce(qm, q) AS w FROM y
), s AS (
  SELECT *, CASE WHEN ends_with(w, '()') THEN left(w, len(w) - 2) ELSE split_part(w, '(', 1) END AS wp FROM z
), t AS (
  SELECT *, (cp = wp OR ends_with(cp, '.' || wp) OR ends_with(cp, '#' || wp)) AND (strpos(w, '(') = 0 OR ends_with(cm, substr(w, strpos(w, '(')))) AS method_ok FROM s
)
SELECT node, text FROM t WHERE CASE WHEN qm IS NOT NULL THEN cm IS NOT NULL AND split_part(c, '#', -1) = split_part(q, '#', -1) AND method_ok
  ELSE c = q OR ends_with(c, '#' || q) OR ends_with(c, '.' || q) OR (cm IS NOT NULL AND method_ok) END
"""


@query("match_lineage_node", _node_sql())
def match_lineage_node(spark, sf_dir):
    nodes = lineage.nodes(frame(spark, sf_dir, "graph"))
    return closure.union([nodes.where(N.matches_node(F.col("node"), F.lit(q))).withColumn("text", F.lit(q)) for q in NODE_QUERIES])


@query(
    "name_functions",
    f"""
SELECT method_fqn, split_part(method_fqn, '(', 1) AS stripped, CASE WHEN params_text = '' THEN 0 ELSE len(string_split(params_text, ',')) END::INT AS n_params, params_text AS signature,
  regexp_extract(split_part(method_fqn, '(', 1), '^(.*)\\.[^.]*$', 1) AS owner, nullif(split_part(params_text, ',', 1), '') AS first_type,
  lower(left(split_part(class_fqn, '.', -1), 1)) || substr(split_part(class_fqn, '.', -1), 2) AS bean
FROM (SELECT *, regexp_extract(method_fqn, '^[^(]*\\((.*)\\)', 1) AS params_text FROM ({_DECL}) d) x
""",
)
def name_functions(spark, sf_dir):
    m = F.col("method_fqn")
    return frame(spark, sf_dir, "declarations").select(
        "method_fqn", N.strip_signature(m).alias("stripped"), N.param_count(m).alias("n_params"), N.signature_params(m).alias("signature"), N.class_of_method(m).alias("owner"),
        N.first_param(m).alias("first_type"), N.decapitalize(F.col("class_fqn")).alias("bean"),
    )


@query(
    "field_expressions_split",
    f"SELECT DISTINCT rhs AS expr, regexp_extract(rhs, '^([^#]*#[^.]*)\\.(.*)$', 1) AS base, regexp_extract(rhs, '^([^#]*#[^.]*)\\.(.*)$', 2) AS field FROM ({sql('assignments')}) a WHERE assignment_type = 'FIELD_READ'",
)
def field_expressions_split(spark, sf_dir):
    reads = frame(spark, sf_dir, "assignments").where("assignment_type = 'FIELD_READ'")
    return reads.select(F.col("rhs").alias("expr"), N.field_base(F.col("rhs")).alias("base"), N.field_name(F.col("rhs")).alias("field")).distinct()


_HM = sql("hierarchy_multi")
_ANC = f"""
  h AS ({_HM}), walk(class_fqn, ancestor, dist) AS (
    SELECT c, c, 0 FROM (SELECT class_fqn AS c FROM h UNION SELECT parent_fqn FROM h) x
    UNION ALL SELECT w.class_fqn, h.parent_fqn, w.dist + 1 FROM walk w JOIN h ON w.ancestor = h.class_fqn WHERE w.dist < 10
  ), anc AS (SELECT class_fqn, ancestor, min(dist)::BIGINT AS dist FROM walk GROUP BY 1, 2)
"""


@query("class_ancestors_min_distance", f"WITH RECURSIVE {_ANC} SELECT class_fqn, ancestor, dist FROM anc")
def class_ancestors_min_distance(spark, sf_dir):
    return hierarchy.ancestors(frame(spark, sf_dir, "hierarchy_multi"))


@query("subtype_semi", f"WITH RECURSIVE {_ANC} SELECT class_fqn, ancestor, dist FROM anc WHERE ancestor IN ('nation.3', 'region.1')")
def subtype_semi(spark, sf_dir):
    types = spark.createDataFrame([("nation.3",), ("region.1",)], "type string")
    return hierarchy.subtypes(hierarchy.ancestors(frame(spark, sf_dir, "hierarchy_multi")), types).select("class_fqn", "ancestor", "dist")


@query(
    "virtual_dispatch",
    f"""
WITH RECURSIVE {_ANC}, d AS ({_DECL}), w AS (SELECT DISTINCT class_fqn AS alloc_type, 'handle' AS method_name, sig FROM ({sql("allocations")}) a, (VALUES (''), ('int')) s(sig)), f AS (
  SELECT w.*, d.method_fqn AS target, d.params = w.sig AS exact, anc.dist FROM w JOIN anc ON anc.class_fqn = w.alloc_type JOIN d ON d.class_fqn = anc.ancestor AND d.method_name = w.method_name
  WHERE d.params = w.sig OR (CASE WHEN d.params = '' THEN 0 ELSE len(string_split(d.params, ',')) END) = (CASE WHEN w.sig = '' THEN 0 ELSE len(string_split(w.sig, ',')) END)
)
SELECT alloc_type, method_name, sig, target FROM (SELECT *, row_number() OVER (PARTITION BY alloc_type, method_name, sig ORDER BY exact DESC, dist, target) AS n FROM f) x WHERE n = 1
""",
)
def virtual_dispatch(spark, sf_dir):
    decl = frame(spark, sf_dir, "declarations")
    types = frame(spark, sf_dir, "allocations").select(F.col("class_fqn").alias("alloc_type")).distinct()
    wanted = types.select("alloc_type", F.lit("handle").alias("method_name"), F.explode(F.array(F.lit(""), F.lit("int"))).alias("sig"))
    anc = hierarchy.ancestors(frame(spark, sf_dir, "hierarchy_multi"), only=types.withColumnRenamed("alloc_type", "class_fqn"))
    return hierarchy.dispatch(anc, decl, wanted)


def _facts(spark, sf_dir, calls: bool, kinds=("ALLOC", "COPY", "FIELD_READ", "FIELD_WRITE")) -> pointsto.Facts:
    g = lambda n: frame(spark, sf_dir, n)
    assign = g("assignments").where(F.col("assignment_type").isin(list(kinds))).unionByName(g("return_bodies"))
    sites = g("calls") if calls else g("calls").limit(0)
    return pointsto.Facts(g("hierarchy_multi"), g("declarations"), g("allocations"), assign, sites, g("arguments"))


@query("pts_alloc", f"SELECT DISTINCT lhs AS var, rhs AS alloc FROM ({sql('assignments')}) a WHERE assignment_type = 'ALLOC'")
def pts_alloc(spark, sf_dir):
    return pointsto.solve(spark, _facts(spark, sf_dir, False, ("ALLOC",))).pts.select("var", "alloc").distinct()


@query(
    "pts_copy_closure",
    f"""
WITH RECURSIVE a AS ({sql("assignments")}), p(var, alloc) AS (
  SELECT lhs, rhs FROM a WHERE assignment_type = 'ALLOC' UNION SELECT a.lhs, p.alloc FROM p JOIN a ON a.rhs = p.var AND a.assignment_type = 'COPY'
) SELECT DISTINCT var, alloc FROM p
""",
)
def pts_copy_closure(spark, sf_dir):
    return pointsto.solve(spark, _facts(spark, sf_dir, False, ("ALLOC", "COPY"))).pts.select("var", "alloc").distinct()


def _unrolled(rounds: int) -> str:
    out = [f"a AS MATERIALIZED ({sql('assignments')})", "w AS (SELECT regexp_extract(lhs, '^([^#]*#[^.]*)\\.(.*)$', 1) AS base, regexp_extract(lhs, '^([^#]*#[^.]*)\\.(.*)$', 2) AS field, rhs FROM a WHERE assignment_type = 'FIELD_WRITE')",
           "r AS (SELECT lhs, regexp_extract(rhs, '^([^#]*#[^.]*)\\.(.*)$', 1) AS base, regexp_extract(rhs, '^([^#]*#[^.]*)\\.(.*)$', 2) AS field FROM a WHERE assignment_type = 'FIELD_READ')",
           "p0 AS MATERIALIZED (SELECT DISTINCT lhs AS var, rhs AS alloc FROM a WHERE assignment_type = 'ALLOC')", "f0 AS MATERIALIZED (SELECT '' AS alloc, '' AS field, '' AS value WHERE false)"]
    for k in range(1, rounds + 1):
        p, f = f"p{k - 1}", f"f{k - 1}"
        out.append(f"f{k} AS MATERIALIZED (SELECT * FROM {f} UNION SELECT x.alloc, w.field, y.alloc FROM w JOIN {p} x ON x.var = w.base JOIN {p} y ON y.var = w.rhs)")
        out.append(f"p{k} AS MATERIALIZED (SELECT * FROM {p} UNION SELECT a.lhs, x.alloc FROM a JOIN {p} x ON x.var = a.rhs WHERE a.assignment_type = 'COPY' UNION SELECT r.lhs, f.value FROM r JOIN {p} x ON x.var = r.base JOIN f{k} f ON f.alloc = x.alloc AND f.field = r.field)")
    return f"WITH {', '.join(out)} SELECT var, alloc FROM p{rounds}"


@query("pts_field_sensitive", _unrolled(24))
def pts_field_sensitive(spark, sf_dir):
    return pointsto.solve(spark, _facts(spark, sf_dir, False)).pts.select("var", "alloc").distinct()


@query("pts_interprocedural")
def pts_interprocedural(spark, sf_dir):
    return pointsto.solve(spark, _facts(spark, sf_dir, True)).pts


@query("call_graph_solved")
def call_graph_solved(spark, sf_dir):
    return pointsto.solve(spark, _facts(spark, sf_dir, True)).call_edges()


@query("context_select", f"SELECT call_id, ctx AS caller_context, CASE WHEN (SELECT count(*) FROM ({_CALLS}) n) <= 1000 AND ctx = '' THEN call_id ELSE '' END AS callee_context FROM ({_CALLS}) c, (VALUES (''), ('call.0')) v(ctx)")
def context_select(spark, sf_dir):
    calls = frame(spark, sf_dir, "calls")
    sensitive = callgraph.context_sensitive(calls)
    out = calls.select("call_id", F.explode(F.array(F.lit(""), F.lit("call.0"))).alias("caller_context"))
    return out.withColumn("callee_context", callgraph.callee_context(F.col("caller_context"), F.col("call_id"), F.lit(sensitive)))


@query("supernodes", f"SELECT static_callee, count(*) AS n_sites FROM ({_CALLS}) c GROUP BY 1 HAVING count(*) > 350")
def supernodes(spark, sf_dir):
    return callgraph.supernodes(frame(spark, sf_dir, "calls"), 350)


@query(
    "event_listener_edges",
    f"""
WITH RECURSIVE {_ANC} SELECT DISTINCT a.alloc_id AS alloc, l.method_fqn FROM ({sql("allocations")}) a JOIN anc ON anc.class_fqn = a.class_fqn
JOIN {values([("l.A.on(nation.3)", "nation.3"), ("l.B.on(region.1)", "region.1")], "method_fqn, event_type")} ON v.event_type = anc.ancestor
""".replace("l.method_fqn", "v.method_fqn"),
)
def event_listener_edges(spark, sf_dir):
    ann = spark.createDataFrame([("l.A.on(nation.3)", "EventListener"), ("l.B.on(region.1)", "EventListener:x"), ("l.C.on()", "EventListener"), ("l.D.on(region.1)", "Other")], "method_fqn string, annotation_name string")
    h = frame(spark, sf_dir, "hierarchy_multi")
    listeners = hierarchy.listener_methods(ann, frame(spark, sf_dir, "declarations"), h)
    objects = frame(spark, sf_dir, "allocations").select(F.col("alloc_id").alias("alloc"), F.col("class_fqn").alias("event_class"))
    return extensions.event_targets(objects, hierarchy.ancestors(h), listeners).select("alloc", "method_fqn")


def _aop_sql() -> str:
    rows = [("adv.A.before()", "ECONOMY", 1), ("adv.A.after()", "STANDARD.Brand1", 1), ("adv.B.around()", "PROMO.Brand2", 0), ("adv.B.around()", "SMALL", 1), ("adv.B.x()", "MEDIUM.Brand3.m7", 0), ("adv.C.z()", "LARGE", 1)]
    return f"""
SELECT DISTINCT target, advice FROM (SELECT target, split_part(target, '(', 1) AS m FROM ({sql("targets")}) t) t, {values(rows, "advice, p, open")}
WHERE CASE WHEN open = 1 THEN m = p OR starts_with(m, p || '.') ELSE m = p OR regexp_extract(m, '^(.*)\\.[^.]*$', 1) = p END
"""


@query("aop_advice_edges", _aop_sql())
def aop_advice_edges(spark, sf_dir):
    kinds = ["Before", "After", "Around", "AfterThrowing", "AfterReturning", "Before"]
    rows = [(m, f"{k}:{e}") for (m, e), k in zip(POINTCUTS, kinds, strict=True)]
    patterns = extensions.advices(spark.createDataFrame(rows, "method_fqn string, annotation_name string"))
    return extensions.advised(frame(spark, sf_dir, "targets"), patterns).select("target", "advice").distinct()


_BEANS = f"""
SELECT class_fqn, CASE WHEN strpos(annotation_name, ':') > 0 THEN split_part(annotation_name, ':', 2) ELSE lower(left(split_part(class_fqn, '.', -1), 1)) || substr(split_part(class_fqn, '.', -1), 2) END AS bean_name
FROM ({sql("beans")}) b WHERE annotation_name <> 'Primary'
"""


@query("bean_names", _BEANS)
def bean_names(spark, sf_dir):
    return spring.beans(frame(spark, sf_dir, "beans"))


@query(
    "bean_injection",
    f"""
WITH RECURSIVE {_ANC}, b AS ({_BEANS}), f AS (
  SELECT p.*, b.class_fqn AS bean_class, b.bean_name FROM ({sql("points")}) p JOIN anc ON anc.ancestor = p.type JOIN b ON b.class_fqn = anc.class_fqn
  WHERE qualifier IS NULL OR bean_name = qualifier OR b.class_fqn = qualifier OR ends_with(b.class_fqn, '.' || qualifier)
), g AS (SELECT *, count(*) OVER w AS n, max((bean_name = field)::INT) OVER w AS same FROM f WINDOW w AS (PARTITION BY owner, field, type))
SELECT owner, field, type, bean_class, bean_name FROM g WHERE qualifier IS NOT NULL OR n = 1 OR same = 0 OR bean_name = field
""",
)
def bean_injection(spark, sf_dir):
    beans = spring.beans(frame(spark, sf_dir, "beans"))
    return spring.candidates(frame(spark, sf_dir, "points"), beans, hierarchy.ancestors(frame(spark, sf_dir, "hierarchy_multi"), only=beans))


_PROPS = f"SELECT key, arg_max(value, layer * 1000000000 + pos) AS value FROM ({sql('properties')}) p GROUP BY key"


@query("properties_overlay", _PROPS)
def properties_overlay(spark, sf_dir):
    return spring.overlay(frame(spark, sf_dir, "properties"))


@query(
    "value_injection",
    f"""
WITH pr AS ({_PROPS}), v AS (SELECT p_partkey, value, trim(regexp_replace(trim(value), '^["''](.*)["'']$', '\\1')) AS s FROM ({sql("values")}) x)
SELECT p_partkey, v.value, CASE WHEN starts_with(s, '${{') THEN coalesce(pr.value, CASE WHEN strpos(s, ':') > 0 THEN substr(s, strpos(s, ':') + 1, len(s) - strpos(s, ':') - 1) ELSE substr(s, 3, len(s) - 3) END) ELSE s END AS resolved
FROM v LEFT JOIN pr ON starts_with(s, '${{') AND pr.key = split_part(substr(s, 3, len(s) - 3), ':', 1)
""",
)
def value_injection(spark, sf_dir):
    return spring.resolve_values(frame(spark, sf_dir, "values"), spring.overlay(frame(spark, sf_dir, "properties"))).select("p_partkey", "value", "resolved")


def _routes_sql(where: str = "") -> str:
    clean = "CASE WHEN t = '' THEN '' ELSE regexp_replace(CASE WHEN starts_with(t, '/') THEN t ELSE '/' || t END, '(.)/$', '\\1') END"
    part = lambda c: clean.replace("t = ''", f"trim({c}) = ''").replace("starts_with(t,", f"starts_with(trim({c}),").replace("THEN t ELSE", f"THEN trim({c}) ELSE").replace("|| t END", f"|| trim({c}) END")
    return f"""
WITH m AS (SELECT * FROM ({sql("mappings")}) x), p AS (
  SELECT m.class_fqn, method_fqn, name, args, unnest(CASE WHEN args = '' THEN [''] ELSE list_transform(regexp_extract_all(regexp_replace(args, '^(value|path)[^=]*=', ''), '"[^"]*"'), lambda s: s[2:-2]) END) AS path FROM m
), b AS (SELECT class_fqn, trim(args, '"') AS base FROM ({sql("class_mappings")}) y), j AS (SELECT p.*, coalesce(base, '') AS base FROM p LEFT JOIN b USING (class_fqn)), r AS (
  SELECT unnest(CASE name WHEN 'GetMapping' THEN ['GET'] WHEN 'PostMapping' THEN ['POST'] WHEN 'PutMapping' THEN ['PUT'] WHEN 'DeleteMapping' THEN ['DELETE'] WHEN 'PatchMapping' THEN ['PATCH']
    ELSE CASE WHEN strpos(upper(args), 'REQUESTMETHOD.GET') > 0 THEN ['GET'] WHEN strpos(upper(args), 'REQUESTMETHOD.POST') > 0 THEN ['POST'] ELSE ['ANY'] END END) AS http_method,
    regexp_replace(({part("base")}) || ({part("path")}), '/+', '/', 'g') AS full_path, method_fqn FROM j
)
SELECT DISTINCT http_method, CASE WHEN full_path = '' THEN '/' ELSE regexp_replace(full_path, '(.)/$', '\\1') END AS path, method_fqn AS controller_method_fqn FROM r {where}
"""


def _routes(spark, sf_dir):
    m = frame(spark, sf_dir, "mappings")
    return spring.web_routes(m.select("class_fqn").distinct(), frame(spark, sf_dir, "class_mappings"), m)


@query("web_routes", _routes_sql())
def web_routes(spark, sf_dir):
    return _routes(spark, sf_dir)


@query("routes_filtered", _routes_sql("WHERE http_method = 'GET' AND CASE WHEN full_path = '' THEN '/' ELSE regexp_replace(full_path, '(.)/$', '\\1') END = '/base30'"))
def routes_filtered(spark, sf_dir):
    return callgraph.routes(_routes(spark, sf_dir), "/base30", "GET")


_OLD, _NEW = sql("old_files"), sql("new_files")
_DIFF = f"""
SELECT file_path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'dirty' ELSE 'same' END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (file_path)
"""


@query("snapshot_diff", _DIFF)
def snapshot_diff(spark, sf_dir):
    return incremental.snapshot_diff(frame(spark, sf_dir, "old_files"), frame(spark, sf_dir, "new_files"))


@query(
    "purge_cascade",
    f"""
SELECT d.* FROM ({_DECL}) d WHERE class_fqn NOT IN (SELECT 'customer.' || file_path FROM ({_DIFF}) x WHERE status IN ('dirty', 'deleted'))
""",
)
def purge_cascade(spark, sf_dir):
    diff = incremental.snapshot_diff(frame(spark, sf_dir, "old_files"), frame(spark, sf_dir, "new_files"))
    provenance = frame(spark, sf_dir, "old_files").select("file_path", F.concat(F.lit("customer."), F.col("file_path").cast("string")).alias("class_fqn"))
    return incremental.purge({"method_declarations": frame(spark, sf_dir, "declarations")}, incremental.affected_classes(diff, provenance))["method_declarations"]


@query("delta_append", f"SELECT file_path, hash FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.file_path = n.file_path AND o.hash = n.hash)")
def delta_append(spark, sf_dir):
    return incremental.delta(frame(spark, sf_dir, "new_files"), frame(spark, sf_dir, "old_files"), ["file_path", "hash"])


@query("cache_by_hash", f"SELECT DISTINCT hash AS content_hash FROM ({_NEW}) n WHERE hash NOT IN (SELECT hash FROM ({_OLD}) o)")
def cache_by_hash(spark, sf_dir):
    h = lambda n: frame(spark, sf_dir, n).select(F.col("hash").alias("content_hash"))
    return incremental.uncached(h("new_files"), h("old_files"))


_COLL = f"(SELECT call_id, method_fqn, receiver, CASE (CAST(substr(call_id, 6) AS BIGINT)) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'get' ELSE 'put' END AS method_name, lhs FROM ({_CALLS}) c)"


@query(
    "collection_model",
    f"""
SELECT DISTINCT receiver || '.[element]' AS lhs, arg_var AS rhs, 'FIELD_WRITE' AS assignment_type, method_fqn FROM {_COLL} c JOIN ({_ARGS}) a USING (call_id) WHERE method_name = 'add'
UNION SELECT lhs, receiver || '.[element]', 'FIELD_READ', method_fqn FROM {_COLL} c WHERE method_name = 'get'
UNION SELECT receiver || '.[key]', arg_var, 'FIELD_WRITE', method_fqn FROM {_COLL} c JOIN ({_ARGS}) a USING (call_id) WHERE method_name = 'put'
UNION SELECT lhs, receiver || '.[value]', 'FIELD_READ', method_fqn FROM {_COLL} c WHERE method_name = 'put'
""",
)
def collection_model(spark, sf_dir):
    number = F.substring("call_id", 6, 20).cast("long") % 3
    calls = frame(spark, sf_dir, "calls").withColumn("method_name", F.when(number == 0, "add").when(number == 1, "get").otherwise("put"))
    return collections.model(calls, frame(spark, sf_dir, "arguments"))


@query("upsert", f"SELECT file_path, hash FROM ({_NEW}) n UNION ALL SELECT file_path, hash FROM ({_OLD}) o WHERE file_path NOT IN (SELECT file_path FROM ({_NEW}) m)")
def upsert(spark, sf_dir):
    return incremental.upsert(frame(spark, sf_dir, "old_files"), frame(spark, sf_dir, "new_files"), ["file_path"])
