"""Fact tables projected from general tables, so that every operator can be run and checked at any scale.

Each projection is one SELECT that Spark and DuckDB read alike; `{name}` stands for a table. `frame` runs it in Spark,
`sql` gives the text for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _s(c: str) -> str:
    return f"cast({c} as string)"


_HIERARCHY = f"""
SELECT concat('order.', {_s("o_orderkey")}) AS class_fqn, concat('customer.', {_s("o_custkey")}) AS parent_fqn FROM {{orders}}
UNION ALL SELECT concat('customer.', {_s("c_custkey")}), concat('nation.', {_s("c_nationkey")}) FROM {{customer}}
UNION ALL SELECT concat('supplier.', {_s("s_suppkey")}), concat('nation.', {_s("s_nationkey")}) FROM {{supplier}}
UNION ALL SELECT concat('nation.', {_s("n_nationkey")}), concat('region.', {_s("n_regionkey")}) FROM {{nation}}
"""

_EVENTS = """
SELECT event_id, user_id, event_type, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS prev2 FROM {events}
"""
_METHOD = f"concat('m.u', {_s('user_id')}, '()')"


def _var(c: str) -> str:
    return f"concat('m.u', {_s('user_id')}, '()#v', {_s(c)})"


_FIELD = f".f', {_s('event_id % 2')})"

PROJECTIONS = {
    "hierarchy": _HIERARCHY,
    "hierarchy_multi": _HIERARCHY + f"UNION ALL SELECT concat('customer.', {_s('c_custkey')}), concat('region.', {_s('c_custkey % 5')}) FROM {{customer}} WHERE c_custkey % 10 = 0",
    "declarations": f"""
SELECT concat('region.', {_s("r_regionkey")}, '.handle()') AS method_fqn, concat('region.', {_s("r_regionkey")}) AS class_fqn, 'handle' AS method_name, '' AS params FROM {{region}}
UNION ALL SELECT concat('nation.', {_s("n_nationkey")}, '.handle()'), concat('nation.', {_s("n_nationkey")}), 'handle', '' FROM {{nation}} WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('customer.', {_s("c_custkey")}, '.handle(int)'), concat('customer.', {_s("c_custkey")}), 'handle', 'v' FROM {{customer}} WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('customer.', {_s("c_custkey")}, '.handle()'), concat('customer.', {_s("c_custkey")}), 'handle', '' FROM {{customer}} WHERE c_custkey % 5 = 0
""",
    "allocations": f"SELECT concat('alloc.', {_s('event_id')}) AS alloc_id, concat('customer.', {_s('user_id')}) AS class_fqn, {_METHOD} AS method_fqn FROM {{events}} WHERE event_type = 'signup'",
    "assignments": f"""
SELECT {_var("event_id")} AS lhs, concat('alloc.', {_s("event_id")}) AS rhs, 'ALLOC' AS assignment_type, {_METHOD} AS method_fqn FROM ({_EVENTS}) e1 WHERE event_type = 'signup'
UNION ALL SELECT {_var("event_id")}, {_var("prev")}, 'COPY', {_METHOD} FROM ({_EVENTS}) e2 WHERE event_type IN ('click', 'purchase') AND prev IS NOT NULL
UNION ALL SELECT concat({_var("prev")}, '.f', {_s("event_id % 2")}), {_var("prev2")}, 'FIELD_WRITE', {_METHOD} FROM ({_EVENTS}) e3 WHERE event_type = 'purchase' AND prev2 IS NOT NULL
UNION ALL SELECT {_var("event_id")}, concat({_var("prev")}, '.f', {_s("event_id % 2")}), 'FIELD_READ', {_METHOD} FROM ({_EVENTS}) e4 WHERE event_type = 'view' AND prev IS NOT NULL
""",
    "calls": f"""
SELECT concat('call.', {_s("event_id")}) AS call_id, {_METHOD} AS method_fqn, {_var("prev")} AS receiver, 'handle' AS method_name, {_var("event_id")} AS lhs, concat('region.', {_s("event_id % 5")}, '.handle()') AS static_callee
FROM ({_EVENTS}) e WHERE event_type = 'error' AND prev IS NOT NULL
""",
    "arguments": f"SELECT concat('call.', {_s('event_id')}) AS call_id, 0 AS arg_index, {_var('event_id')} AS arg_var FROM {{events}} WHERE event_type = 'error' AND event_id % 2 = 0",
    "return_bodies": """
SELECT concat('region.', cast(r_regionkey as string), '.handle()#return') AS lhs, concat('region.', cast(r_regionkey as string), '.handle()#this') AS rhs, 'COPY' AS assignment_type, concat('region.', cast(r_regionkey as string), '.handle()') AS method_fqn FROM {region}
UNION ALL SELECT concat('nation.', cast(n_nationkey as string), '.handle()#return'), concat('nation.', cast(n_nationkey as string), '.handle()#this'), 'COPY', concat('nation.', cast(n_nationkey as string), '.handle()') FROM {nation} WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('customer.', cast(c_custkey as string), '.handle()#return'), concat('customer.', cast(c_custkey as string), '.handle()#this'), 'COPY', concat('customer.', cast(c_custkey as string), '.handle()') FROM {customer} WHERE c_custkey % 5 = 0
""",
    "call_edges": f"""
SELECT DISTINCT concat('m.u', {_s("user_id")}) AS caller, concat('region.', {_s("event_id % 5")}, '.handle') AS callee, event_id % 2 AS is_virtual FROM {{events}} WHERE event_type = 'error'
""",
    "turns": f"""
SELECT conv_id, turn, concat('c', {_s("conv_id")}, '.t()#', CASE WHEN role = 'assistant' THEN 'temp_call_lhs_' ELSE 'turn' END, {_s("turn")}) AS node,
  CASE role WHEN 'user' THEN 'PASS_ARG' WHEN 'assistant' THEN 'PASS_RET' ELSE 'COPY' END AS edge_type,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {{conversations}}
""",
}
_TURNS = PROJECTIONS["turns"]
PROJECTIONS["paths"] = f"SELECT a.node AS from_node, b.node AS to_node, a.edge_type FROM ({_TURNS}) a JOIN ({_TURNS}) b ON a.conv_id = b.conv_id AND b.n = a.n + 1"
PROJECTIONS["graph"] = f"""{PROJECTIONS["paths"]}
UNION ALL SELECT a.node, b.node, 'COPY' FROM ({_TURNS}) a JOIN ({_TURNS}) b ON a.conv_id = b.conv_id AND a.back = 1 AND b.n = 1 WHERE a.conv_id % 5 = 0 AND a.n > 1
UNION ALL SELECT a.node, b.node, 'COPY' FROM ({_TURNS}) a JOIN ({_TURNS}) b ON b.conv_id = a.conv_id + 1 AND a.n = 2 AND b.n = 1 WHERE a.conv_id % 3 = 0
"""
_VERBS = "CASE page_id % 6 WHEN 0 THEN 'GetMapping' WHEN 1 THEN 'PostMapping' WHEN 2 THEN 'PutMapping' WHEN 3 THEN 'DeleteMapping' WHEN 4 THEN 'PatchMapping' ELSE 'RequestMapping' END"
PROJECTIONS |= {
    "mappings": f"""
SELECT concat('web.C', {_s("page_id % 50")}) AS class_fqn, concat('web.C', {_s("page_id % 50")}, '.m', {_s("page_id")}, '()') AS method_fqn, {_VERBS} AS name,
  CASE WHEN page_id % 7 = 0 THEN concat('{{{{"', url, '", "/alias', {_s("page_id")}, '/"}}}}') WHEN page_id % 7 = 1 THEN concat('value = "', url, '"') WHEN page_id % 7 = 2 THEN ''
    WHEN page_id % 6 = 5 THEN concat('path = "', url, '", method = RequestMethod.', CASE WHEN page_id % 12 = 5 THEN 'GET' ELSE 'POST' END) ELSE concat('"', url, '"') END AS args
FROM {{pages}} WHERE url IS NOT NULL
""",
    "class_mappings": f"SELECT DISTINCT concat('web.C', {_s('page_id % 50')}) AS class_fqn, concat('\"/base', {_s('page_id % 50')}, CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END, '\"') AS args FROM {{pages}} WHERE page_id < 50",
    "properties": f"SELECT concat('k.', {_s('event_id % 50')}) AS key, concat(event_type, '-', {_s('event_id')}) AS value, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS layer, event_id AS pos FROM {{events}} WHERE event_type IN ('click', 'view', 'error')",
    "values": f"""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat('"${{{{k.', {_s("p_size")}, ':', p_brand, '}}}}"') WHEN p_partkey % 4 = 1 THEN concat('${{{{k.', {_s("p_size")}, '}}}}') WHEN p_partkey % 4 = 2 THEN concat(' ''', p_brand, ''' ') ELSE p_brand END AS value
FROM {{part}}
""",
    "old_files": "SELECT doc_id AS file_path, md5(coalesce(text, '')) AS hash FROM {documents} WHERE doc_id % 11 <> 0",
    "new_files": "SELECT doc_id AS file_path, md5(concat(coalesce(text, ''), CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END)) AS hash FROM {documents} WHERE doc_id % 13 <> 0",
    "targets": f"SELECT concat(replace(p_type, ' ', '.'), '.', replace(p_brand, '#', ''), '.m', {_s('p_partkey')}, '(int)') AS target FROM {{part}}",
    "beans": f"""
SELECT concat('customer.', {_s("c_custkey")}) AS class_fqn, CASE WHEN c_custkey % 4 = 0 THEN 'Service' WHEN c_custkey % 4 = 1 THEN 'Component' WHEN c_custkey % 4 = 2 THEN concat('Repository:bean', {_s("c_custkey")}) ELSE 'Primary' END AS annotation_name FROM {{customer}} WHERE c_custkey % 3 <> 1
""",
    "points": f"SELECT concat('order.', {_s('o_orderkey')}) AS owner, concat('field', {_s('o_orderkey % 4')}) AS field, concat('nation.', {_s('o_orderkey % 25')}) AS type, CASE WHEN o_orderkey % 9 = 0 THEN concat('bean', {_s('o_orderkey % 600')}) END AS qualifier FROM {{orders}}",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = PROJECTIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(name: str) -> str:
    text = PROJECTIONS[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return re.sub(r"\{\{|\}\}", lambda m: m[0][0], text)
