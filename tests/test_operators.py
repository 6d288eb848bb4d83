import random

import pytest

from factflow.operators import closure, collections, extensions, hierarchy, incremental, lineage, pointsto, spring


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_reach_with_cycle(spark, rows):
    e = rows([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), (None, "a")], "src, dst")
    assert tuples(closure.reach(e, rows([("a",)], "node"))) == [("a",), ("b",), ("c",)]
    assert len(tuples(closure.pairs(e))) == 10


def test_distances_random(spark, rows):
    rng = random.Random(5)
    e = sorted({(str(rng.randrange(8)), str(rng.randrange(8))) for _ in range(14)})
    want = {}
    for s in sorted({x for p in e for x in p}):
        dist, todo = {s: 0}, [s]
        for v in todo:
            for a, b in e:
                if a == v and b not in dist:
                    dist[b] = dist[v] + 1
                    todo.append(b)
        want |= {(s, k): d for k, d in dist.items()}
    edges = rows(e, "src, dst")
    got = closure.distances(edges, edges.selectExpr("src as node").union(edges.selectExpr("dst")).distinct())
    assert {(r.src, r.dst): r.dist for r in got.collect()} == want


def test_contraction(spark, rows):
    edges = rows([("A", "m()#temp_alloc_1", "COPY"), ("m()#temp_alloc_1", "B", "FIELD_WRITE"), ("E", "normal", "COPY"), ("normal", "F", "COPY"), *[(f"m()#temp_alloc_{k}", f"m()#temp_alloc_{k + 1}", "COPY") for k in range(10, 17)], ("C", "m()#temp_alloc_10", "PASS_ARG"), ("m()#temp_alloc_17", "D", "COPY")], "from_node, to_node, edge_type")
    assert tuples(lineage.contracted(edges)) == [("A", "B", "FIELD_WRITE"), ("C", "D", "PASS_ARG"), ("E", "normal", "COPY"), ("normal", "F", "COPY")]


def test_inter_procedural_lineage(spark, rows):
    calls = rows([("c1", "Client.main()", None, "process", "Client.main()#output", "Service.process(String)")], "call_id, method_fqn, receiver, method_name, lhs, static_callee")
    args = spark.createDataFrame([("c1", 0, "Client.main()#input")], "call_id string, arg_index int, arg_var string")
    edges, decl = rows([("Client.main", "Service.process")], "caller, callee"), rows([("Service.process(String)",)], "method_fqn")
    assert tuples(lineage.inter(calls, args, edges, decl)) == [("Client.main()#input", "Service.process(String)#p0", "PASS_ARG"), ("Service.process(String)#return", "Client.main()#output", "PASS_RET")]


def facts(spark, rows, **more):
    base = {
        "hierarchy": rows([("SubA", "Base"), ("SubB", "Base")], "class_fqn, parent_fqn"),
        "declarations": rows([("Base.foo()", "Base", "foo", ""), ("SubA.foo()", "SubA", "foo", ""), ("SubB.foo()", "SubB", "foo", "")], "method_fqn, class_fqn, method_name, params"),
        "allocations": rows([("AllocA", "SubA", "Main.run()"), ("AllocB", "SubB", "Main.run()")], "alloc_id, class_fqn, method_fqn"),
        "assignments": rows([("x", "AllocA", "ALLOC", "Main.run()"), ("y", "AllocB", "ALLOC", "Main.run()"), ("z", "x", "COPY", "Main.run()")], "lhs, rhs, assignment_type, method_fqn"),
        "calls": rows([("c1", "Main.run()", "z", "foo", None, "Base.foo()")], "call_id, method_fqn, receiver, method_name, lhs, static_callee"),
        "arguments": spark.createDataFrame([], "call_id string, arg_index int, arg_var string"),
    }
    return pointsto.Facts(**(base | more))


def test_virtual_dispatch(spark, rows):
    s = pointsto.solve(spark, facts(spark, rows))
    pts = {(r.var, r.alloc) for r in s.pts.collect()}
    assert ("z", "AllocA") in pts and ("z", "AllocB") not in pts
    assert {(r.caller, r.callee, r.callee_context, r.is_virtual) for r in s.call_edges().collect()} == {("Main.run", "SubA.foo", "c1", 1)}
    assert ("SubA.foo()#this", "AllocA") in pts


def test_summary_supernode_and_fallback(spark, rows):
    calls = rows([("c1", "M.r()", None, "f", "ret", "Id.f(Object)"), ("c2", "M.r()", None, "big", "s", "Big.big()"), ("c3", "M.r()", None, "big", None, "Big.big()")], "call_id, method_fqn, receiver, method_name, lhs, static_callee")
    args = spark.createDataFrame([("c1", 0, "arg")], "call_id string, arg_index int, arg_var string")
    f = facts(spark, rows, calls=calls, arguments=args, assignments=rows([("arg", "AllocA", "ALLOC", "M.r()")], "lhs, rhs, assignment_type, method_fqn"), summaries=spark.createDataFrame([("Id.f(Object)", 0)], "method_fqn string, param_index int"))
    s = pointsto.solve(spark, f, supernode_limit=1)
    pts = {(r.var, r.alloc) for r in s.pts.collect()}
    assert {("ret", "AllocA"), ("s", "SupernodeReturn:Big.big()")} <= pts
    assert {(r.callee, r.is_virtual) for r in s.call_edges().collect()} == {("Id.f", 0), ("Big.big", 0)}


def test_event_extension(spark, rows):
    calls = rows([("c1", "P.pub()", "p", "publishEvent", None, "Pub.publishEvent(Object)")], "call_id, method_fqn, receiver, method_name, lhs, static_callee")
    args = spark.createDataFrame([("c1", 0, "e")], "call_id string, arg_index int, arg_var string")
    f = facts(
        spark, rows, calls=calls, arguments=args, assignments=rows([("e", "AllocA", "ALLOC", "P.pub()")], "lhs, rhs, assignment_type, method_fqn"),
        method_annotations=rows([("L.on(Base)", "EventListener"), ("L.other(Zed)", "EventListener")], "method_fqn, annotation_name"),
    )
    s = pointsto.solve(spark, f)
    assert {(r.caller, r.callee) for r in s.call_edges().collect()} == {("P.pub", "L.on")}
    assert ("L.on(Base)#p0", "AllocA") in {(r.var, r.alloc) for r in s.pts.collect()}


def test_advice(spark, rows):
    ann = rows([("A.pc()", "Pointcut:within(com.t..*)"), ("A.before()", "Before:pc()"), ("A.after()", "After:execution(* com.u.S.m(..))")], "method_fqn, annotation_name")
    got = extensions.advised(rows([("com.t.X.run(int)",), ("com.u.S.m()",), ("com.u.S.mm()",)], "target"), extensions.advices(ann))
    assert sorted((r.target, r.advice) for r in got.collect()) == [("com.t.X.run(int)", "A.before()"), ("com.u.S.m()", "A.after()")]


def test_beans_and_injection(spark, rows):
    b = spring.beans(rows([("a.UserRepo", "Repository"), ("a.Mail", "Service"), ("a.Mail", "Service:mailer"), ("a.X", "Primary")], "class_fqn, annotation_name"))
    assert tuples(b) == [("a.Mail", "mailer"), ("a.UserRepo", "userRepo")]
    anc = hierarchy.ancestors(rows([("a.UserRepo", "I"), ("a.Mail", "I")], "class_fqn, parent_fqn"))
    points = rows([("C", "userRepo", "I", None), ("C", "other", "I", None), ("C", "m", "I", "mailer")], "owner, field, type, qualifier")
    got = sorted((r.field, r.bean_class) for r in spring.candidates(points, b, anc).collect())
    assert got == [("m", "a.Mail"), ("other", "a.Mail"), ("other", "a.UserRepo"), ("userRepo", "a.UserRepo")]


def test_properties_and_values(spark, rows):
    props = spring.overlay(spark.createDataFrame([("p", "1", 0, 0), ("p", "2", 1, 0), ("p", "3", 1, 1), ("q", "x", 0, 5)], "key string, value string, layer int, pos int"))
    assert tuples(props) == [("p", "3"), ("q", "x")]
    got = spring.resolve_values(rows([("${p:9}",), ("${none:d}",), ("${none}",), ("'lit'",)], "value"), props)
    assert sorted(r.resolved for r in got.collect()) == ["3", "d", "lit", "none"]


def test_routes(spark, rows):
    got = spring.routes_of_annotations(rows([("C", "RestController"), ("C", "RequestMapping"), ("C", "RequestMapping:\"/api/v1\"")], "class_fqn, annotation_name"), rows([("C.a()", "GetMapping"), ("C.a()", 'GetMapping:"/users"'), ("C.b()", 'PostMapping:{"/users/add","/users/create"}')], "method_fqn, annotation_name"))
    assert sorted((r.http_method, r.path) for r in got.collect()) == [("GET", "/api/v1/users"), ("POST", "/api/v1/users/add"), ("POST", "/api/v1/users/create")]


def test_incremental(spark, rows):
    diff = incremental.snapshot_diff(rows([("a", "1"), ("b", "1"), ("c", "1")], "file_path, hash"), rows([("a", "1"), ("b", "2"), ("d", "1")], "file_path, hash"))
    assert tuples(diff) == [("a", "same"), ("b", "dirty"), ("c", "deleted"), ("d", "new")]
    gone = incremental.affected_classes(diff, rows([("b", "p.B"), ("c", "p.C"), ("a", "p.A")], "file_path, class_fqn"))
    kept = incremental.purge({"source_assignments": rows([("p.B.m()", 1), ("p.Bx.m()", 2), ("p.A.m(p.B)", 3)], "method_fqn string, n int")}, gone)
    assert [r.n for r in kept["source_assignments"].orderBy("n").collect()] == [2, 3]


@pytest.mark.parametrize(("name", "args", "want"), [("add", [(0, "i")], {("l.[element]", "i", "FIELD_WRITE")}), ("add", [(0, "n"), (1, "i")], {("l.[element]", "i", "FIELD_WRITE")}), ("get", [(0, "i")], {("r", "l.[element]", "FIELD_READ")})])
def test_collections(spark, rows, name, args, want):
    calls = rows([("c", "M.m()", "l", name, "r")], "call_id, method_fqn, receiver, method_name, lhs")
    arguments = spark.createDataFrame([("c", k, v) for k, v in args], "call_id string, arg_index int, arg_var string")
    assert {(r.lhs, r.rhs, r.assignment_type) for r in collections.model(calls, arguments).collect()} == want


def test_injection_points_are_all_orders(spark, tmp_path):
    from factflow.plans import bridge

    spark.range(1, 601).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = bridge.frame(spark, str(tmp_path), "points").collect()
    assert len(got) == 600 and len({r.field for r in got}) == 4 and len({r.type for r in got}) == 25
    assert "%" in bridge.sql("points") and "WHERE" not in bridge.sql("points")
