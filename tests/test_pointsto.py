"""The points-to solver, both ways of running it, against the rules evaluated naively over whole sets."""

import random

import pytest

from factflow.operators import pointsto


def signature(name):
    return name[name.index("(") + 1 : name.rindex(")")] if name and "(" in name and ")" in name else ""


def n_params(text):
    return len(text.split(",")) if text.strip() else 0


def naive(f, sensitive, supers):
    """Every rule over all rows, again and again, until nothing is new; then static callees; and so on."""
    above = {}
    for c in {x for p in f["hierarchy"] for x in p} | {d[1] for d in f["declarations"]}:
        dist = {c: 0}
        for d in range(10):
            for a, b in f["hierarchy"]:
                if dist.get(a) == d and b not in dist:
                    dist[b] = d + 1
        above[c] = dist
    cls = dict(f["allocations"])

    def dispatch(c, name, sig):
        found = [(params != sig, above[c][owner], m) for m, owner, n, params in f["declarations"] if c in above and owner in above[c] and n == name and (params == sig or n_params(params) == n_params(sig))]
        return min(found)[2] if found else None

    def refined(static):
        owner, name = static.split("(")[0].rsplit(".", 1)
        found = [m for m, c, n, _ in f["declarations"] if (c, n) == (owner, name) and n_params(signature(m)) == n_params(signature(static))]
        return min(found) if found else static

    pts, fld, edges, reso = set(), set(), set(), set()
    active = {(m, "") for m in {a[3] for a in f["assignments"]} | {c[1] for c in f["calls"]}}

    def enter(call, ctx, target, virtual):
        reso.add((call[0], ctx, target, virtual))
        inner = call[0] if sensitive and ctx == "" else ""
        edges.add((ctx, call[1].split("(")[0], inner, target.split("(")[0], virtual))
        if target not in supers and target not in {s[0] for s in f["summaries"]}:
            active.add((target, inner))

    def flows():
        out = set()
        for lhs, rhs, kind, m in f["assignments"]:
            out |= {(c, rhs, c, lhs) for a, c in active if a == m and kind == "COPY"}
        calls = {c[0]: c for c in f["calls"]}
        for cid, ctx, target, _ in reso:
            _, _, receiver, _, lhs, _ = calls[cid]
            inner = cid if sensitive and ctx == "" else ""
            args = [(i, v) for c, i, v in f["arguments"] if c == cid]
            if target in supers:
                if lhs:
                    pts.add((ctx, lhs, "", f"SupernodeReturn:{target}"))
            elif target in {s[0] for s in f["summaries"]}:
                out |= {(ctx, v, ctx, lhs) for i, v in args if lhs and (target, i) in f["summaries"]}
            else:
                out |= {(ctx, v, inner, f"{target}#p{i}") for i, v in args}
                out |= {(ctx, receiver, inner, f"{target}#this")} if receiver else set()
                out |= {(inner, f"{target}#return", ctx, lhs)} if lhs else set()
        return out

    def size():
        return len(pts), len(fld), len(edges), len(reso), len(active)

    while True:
        while True:
            before = size()
            split = lambda e: e.rsplit(".", 1)
            for lhs, rhs, kind, m in f["assignments"]:
                for c in [c for a, c in active if a == m]:
                    if kind == "ALLOC":
                        pts.add((c, lhs, c, rhs))
                    if kind == "FIELD_WRITE":
                        base, field = split(lhs)
                        fld |= {(a[2], a[3], field, b[2], b[3]) for a in pts if a[:2] == (c, base) for b in pts if b[:2] == (c, rhs)}
                    if kind == "FIELD_READ":
                        base, field = split(rhs)
                        pts |= {(c, lhs, x[3], x[4]) for a in pts if a[:2] == (c, base) for x in fld if x[:3] == (a[2], a[3], field)}
            for src_c, src, dst_c, dst in flows():
                pts |= {(dst_c, dst, a[2], a[3]) for a in pts if a[:2] == (src_c, src)}
            for call in f["calls"]:
                for c in [c for a, c in active if a == call[1]]:
                    for a in [a for a in pts if a[:2] == (c, call[2])]:
                        target = dispatch(cls.get(a[3]), call[3], signature(call[5]))
                        if target:
                            enter(call, c, target, 1)
            if size() == before:
                break
        before = size()
        silent = [(call, c) for call in f["calls"] for a, c in active if a == call[1] and call[5] and not any(p[:2] == (c, call[2]) for p in pts)]
        for call, c in silent:
            enter(call, c, refined(call[5]), 0)
        if size() == before:
            return pts, fld, edges


def random_facts(seed):
    """A small program; its names begin with the seed, so many of them make one table."""
    rng = random.Random(seed)
    s = f"s{seed}"
    classes = [f"{s}.C{k}" for k in range(5)]
    f = {"hierarchy": [(classes[k], classes[rng.randrange(k)]) for k in range(1, 5)], "declarations": [], "allocations": [], "assignments": [], "calls": [], "arguments": [], "summaries": set()}
    methods = [f"{s}.Main.run()", f"{s}.Main.go()"]
    for c in classes:
        for name, types in [("foo", ""), ("bar", "T"), ("bar", "U,V")]:
            if rng.random() < 0.5:
                m = f"{c}.{name}({types})"
                f["declarations"].append((m, c, name, ",".join("ab"[: n_params(types)])))
                methods.append(m)
                if rng.random() < 0.15:
                    f["summaries"].add((m, 0))
    for m in methods:
        own = [f"{m}#{v}" for v in ("x", "y", "z", "this", "p0")]
        for k in range(rng.randrange(4)):
            a = f"{m}@{k}"
            f["allocations"].append((a, rng.choice(classes)))
            f["assignments"].append((rng.choice(own), a, "ALLOC", m))
        for _ in range(rng.randrange(4)):
            kind = rng.choice(["COPY", "COPY", "FIELD_READ", "FIELD_WRITE"])
            lhs, rhs = rng.choice([*own, f"{m}#return"]), rng.choice(own)
            f["assignments"].append((f"{rng.choice(own)}.f" if kind == "FIELD_WRITE" else lhs, f"{rhs}.f" if kind == "FIELD_READ" else rhs, kind, m))
        for k in range(rng.randrange(3)):
            name, n = rng.choice([("foo", 0), ("bar", 1), ("bar", 2)])
            cid = f"{m}!{k}"
            static = f"{rng.choice(classes)}.{name}({','.join(['Object'] * n)})"
            f["calls"].append((cid, m, rng.choice([*own, None]), name, rng.choice([*own, None]), rng.choice([static, static, None])))
            f["arguments"] += [(cid, i, rng.choice(own)) for i in range(n)]
    return f


def as_facts(spark, all_facts):
    merged = {k: [r for f in all_facts for r in f[k]] for k in all_facts[0]}
    schemas = {
        "hierarchy": "class_fqn string, parent_fqn string", "declarations": "method_fqn string, class_fqn string, method_name string, params string", "allocations": "alloc_id string, class_fqn string",
        "assignments": "lhs string, rhs string, assignment_type string, method_fqn string", "calls": "call_id string, method_fqn string, receiver string, method_name string, lhs string, static_callee string",
        "arguments": "call_id string, arg_index int, arg_var string", "summaries": "method_fqn string, param_index int",
    }
    made = {k: spark.createDataFrame(merged[k], schemas[k]) for k in schemas}
    made["allocations"] = made["allocations"].selectExpr("alloc_id", "class_fqn", "split(alloc_id, '@')[0] as method_fqn")
    return pointsto.Facts(**made)


def sets(solution):
    return {tuple(r) for r in solution.pts.collect()}, {tuple(r) for r in solution.fields.collect()}, {tuple(r) for r in solution.edges.collect()}


@pytest.mark.parametrize(("local_facts", "sensitive"), [(pointsto.LOCAL_FACTS, True), (pointsto.LOCAL_FACTS, False), (0, True)])
def test_solver_equals_naive_evaluation(spark, local_facts, sensitive):
    programs = [random_facts(seed) for seed in range(100)]
    sites = {}
    for f in programs:
        for c in f["calls"]:
            sites[c[5]] = sites.get(c[5], 0) + 1
    supers = {m for m, n in sites.items() if m and n > 3}
    want = [set(), set(), set()]
    for f in programs:
        for all_rows, rows in zip(want, naive(f, sensitive, supers), strict=True):
            all_rows |= rows
    got = sets(pointsto.solve(spark, as_facts(spark, programs), context_limit=10**6 if sensitive else 0, supernode_limit=3, local_facts=local_facts))
    for name, a, b in zip(("pts", "fields", "edges"), got, want, strict=True):
        assert a == b, (name, sorted(a - b)[:3], sorted(b - a)[:3])
    assert any(e[4] == 0 for e in want[2]) and any(e[4] == 1 for e in want[2]) and want[1]


@pytest.mark.parametrize("local_facts", [pointsto.LOCAL_FACTS, 0])
def test_static_callee_only_where_virtual_flow_is_quiet(spark, local_facts):
    f = {
        "hierarchy": [("SubA", "Base")], "declarations": [("A.f(Base)", "A", "f", "b"), ("Base.foo()", "Base", "foo", ""), ("SubA.foo()", "SubA", "foo", "")], "allocations": [("M.run()@0", "SubA")],
        "assignments": [("M.run()#x", "M.run()@0", "ALLOC", "M.run()"), ("A.f(Base)#y", "A.f(Base)#p0", "COPY", "A.f(Base)")],
        "calls": [("c1", "M.run()", None, "f", None, "A.f(Object)"), ("c2", "A.f(Base)", "A.f(Base)#y", "foo", None, "Base.foo()")], "arguments": [("c1", 0, "M.run()#x")], "summaries": [],
    }
    s = pointsto.solve(spark, as_facts(spark, [f]), local_facts=local_facts)
    edges = {(r.caller_context, r.caller, r.callee, r.is_virtual) for r in s.edges.collect()}
    # in the empty context y points to nothing, so its call falls back; in c1 it holds the object
    assert ("c1", "A.f", "SubA.foo", 1) in edges and ("c1", "A.f", "Base.foo", 0) not in edges
    assert ("", "M.run", "A.f", 0) in edges
    assert not any(r.var == "Base.foo()#this" for r in s.pts.collect())


def test_task_that_would_hold_too_much_gives_up(spark):
    facts = as_facts(spark, [random_facts(3)])
    assert sets(pointsto.solve(spark, facts, local_rows=1)) == sets(pointsto.solve(spark, facts))


def test_empty_facts(spark):
    empty = {k: [] for k in random_facts(0)}
    for local_facts in (pointsto.LOCAL_FACTS, 0):
        assert sets(pointsto.solve(spark, as_facts(spark, [empty]), local_facts=local_facts)) == (set(), set(), set())
