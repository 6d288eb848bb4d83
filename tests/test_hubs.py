"""Hubs give what a plain run gives, and hold near what the program holds where its objects meet in one cycle."""

import pytest
from test_pointsto import as_facts, naive, random_facts, sets

from factflow.operators import pointsto, worklist


def test_hubs_equal_naive_evaluation(spark, monkeypatch):
    monkeypatch.setattr(worklist.Hubbed, "FIRST", 0)
    monkeypatch.setattr(worklist.Hubbed, "MANY", 1)
    made = []
    monkeypatch.setattr(worklist._Hub, "__init__", lambda self, name, init=worklist._Hub.__init__: (made.append(name), init(self, name))[1])
    programs = [random_facts(seed) for seed in range(150)]
    for f in programs:
        tables = {**{k: list(v) for k, v in f.items()}, "methods": sorted({r[i] for k, i in (("assignments", 3), ("calls", 1)) for r in f[k]} | {r[0].split("@")[0] for r in f["allocations"]})}
        got = worklist.Hubbed(tables, set(), set(), 10**6)
        got.run()
        pts, fields, edges = naive(f, False, set())
        name = got.object_names.__getitem__
        hold = lambda s: {name(o) for o in s if o >= 0}.union(*({name(o) for o in got.hubs[h].all} for h in s if h < 0))
        assert {(*n, *o) for n, s in zip(got.names, got.held, strict=True) if len(n) == 2 for o in hold(s)} == pts
    assert made


def ring(n):
    """A program of `n` objects that all meet: each variable holds each object, and each field of each object too."""
    m = "M.run()"
    return {
        "hierarchy": [("A", "B")], "declarations": [("B.foo()", "B", "foo", "")], "allocations": [(f"{m}@{k}", "A") for k in range(n)], "arguments": [], "summaries": [],
        "assignments": [r for k in range(n) for r in ((f"{m}#v{k}", f"{m}@{k}", "ALLOC", m), (f"{m}#v{k}", f"{m}#v{(k + 1) % n}", "COPY", m), (f"{m}#v{k}.f", f"{m}#v{k}", "FIELD_WRITE", m), (f"{m}#w{k}", f"{m}#v{k}.f", "FIELD_READ", m))],
        "calls": [("c", m, f"{m}#w0", "foo", f"{m}#x", None)],
    }


def test_rows_beyond_the_bound_by_hubs(spark, monkeypatch):
    monkeypatch.setattr(pointsto, "JOINED", 5_000)
    monkeypatch.setattr(pointsto, "_solve_rounds", lambda *a: pytest.fail("the program fits one task"))
    pts, fields, edges = sets(pointsto.solve(spark, as_facts(spark, [ring(100)]), context_limit=0, local_rows=20_000))
    assert len(pts) == 100 * 201 and len(fields) == 100 * 100
    assert edges == {("", "M.run", "", "B.foo", 1)}
    assert {r for r in pts if r[1] == "B.foo()#this"} == {("", "B.foo()#this", "", f"M.run()@{k}") for k in range(100)}


def test_hubs_of_one_cycle_are_merged(monkeypatch):
    """Two rings that meet by static calls, once virtual flow is quiet, are one cycle and end with one hub."""
    monkeypatch.setattr(worklist.Hubbed, "FIRST", 1000)
    f, n, m = ring(200), 200, "M.run()"
    f["assignments"] = [(a, f"{m}#v{(k + 1) % 100 + k // 100 * 100}" if kind == "COPY" else b, kind, m) for (a, b, kind, m), k in zip(f["assignments"], [k for k in range(n) for _ in range(4)], strict=True)]
    f["assignments"].append(("Id.f(T)#return", "Id.f(T)#p0", "COPY", "Id.f(T)"))
    f["calls"] += [("d", m, None, "f", f"{m}#v100", "Id.f(T)"), ("e", m, None, "f", f"{m}#v0", "Id.f(T)")]
    f["arguments"] = [("d", 0, f"{m}#v0"), ("e", 0, f"{m}#v100")]
    got = worklist.Hubbed({**f, "methods": [m]}, set(), set(), 10**6)
    got.run()
    assert [len(h.all) for h in got.hubs.values()] == [n]
    name = got.object_names.__getitem__
    hold = lambda s: {name(o) for o in s if o >= 0}.union(*({name(o) for o in got.hubs[h].all} for h in s if h < 0))
    places = [f"{m}#{v}{k}" for v in "vw" for k in range(n)] + ["B.foo()#this", "Id.f(T)#p0", "Id.f(T)#return"]
    pts = {("", p, "", f"{m}@{k}") for p in places for k in range(n)}
    assert {(*p, *o) for p, s in zip(got.names, got.held, strict=True) if len(p) == 2 for o in hold(s)} == pts
