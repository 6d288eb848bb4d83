"""Whole projects through a workspace: injection, values, collections, callbacks, libraries, and analyses that are repeated."""

import zipfile

import pytest
from test_bytecode import identity_class

from factflow.workspace import Workspace


def project(tmp_path, **files):
    for name, text in files.items():
        folder = tmp_path / "p" / "com" / "w"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.java").write_text(f"package com.w;\n{text}")
    return f"file://{tmp_path}/p"


def objects(w, var):
    return {r.alloc.split(":")[-1] if r.alloc.startswith("StringAlloc:") else r.alloc for r in w.table("points_to_sets").where(f"var like '%{var}'").collect()}


def edges(w):
    return {(r.caller, r.callee) for r in w.table("call_edges").collect()}


def test_injection_by_constructor_and_values(spark, tmp_path):
    base = project(
        tmp_path,
        Mailer="public interface Mailer { void send(String text); }",
        Smtp="@Service public class Smtp implements Mailer { public void send(String text) { } }",
        Printer='@Component("paper") public class Printer implements Mailer { public void send(String text) { } }',
        Shop='@Service public class Shop { private Mailer mailer; private String note; @Value("${server.port:8080}") private String port;\n'
        ' public Shop(@Qualifier("paper") Mailer mailer, @Value("${app.desc:none given}") String note) { this.mailer = mailer; this.note = note; }\n'
        " public void sell(String item) { mailer.send(item); String p = port; String n = note; } }",
    )
    (tmp_path / "p/application.properties").write_text("server.port=9090\n")
    (tmp_path / "p/target").mkdir()
    (tmp_path / "p/target/application.properties").write_text("server.port=1\n")
    w = Workspace(spark, f"file://{tmp_path}/ws", base)
    w.analyze()
    assert {r.value for r in w.table("properties").collect()} == {"9090"}
    assert ("com.w.Shop.sell", "com.w.Printer.send") in edges(w) and ("com.w.Shop.sell", "com.w.Smtp.send") not in edges(w)
    assert objects(w, "Shop.sell(java.lang.String)#p") == {"9090"} and objects(w, "Shop.sell(java.lang.String)#n") == {"none given"}


def test_collections_and_callbacks(spark, tmp_path):
    base = project(
        tmp_path,
        Item="public class Item { }",
        Call="public interface Call { void done(Item i); }",
        Mine="public class Mine implements Call { private Item got; public void done(Item i) { this.got = i; } }",
        Worker="public class Worker { public void run(Call c, Item i) { c.done(i); } }",
        Main="import java.util.*; public class Main { public void run() { List list = new ArrayList(); Item a = new Item(); list.add(a); Item b = list.get(0);\n"
        " Map map = new HashMap(); Item v = new Item(); map.put(a, v); Item c = map.get(a); Worker w = new Worker(); Mine m = new Mine(); w.run(m, a); } }",
    )
    w = Workspace(spark, f"file://{tmp_path}/ws", base)
    w.analyze()
    a, v = objects(w, "Main.run()#a"), objects(w, "Main.run()#v")
    assert len(a) == len(v) == 1 and a != v
    assert objects(w, "Main.run()#b") == a and objects(w, "Main.run()#c") == v
    assert {("com.w.Main.run", "com.w.Worker.run"), ("com.w.Worker.run", "com.w.Mine.done")} <= edges(w)
    assert objects(w, "#this.got") == a


def test_libraries_by_folder_and_by_maven(spark, tmp_path):
    base = project(tmp_path, Use="import lib.Identity; public class Use { public void run() { Use u = new Use(); Object o = Identity.f(u); } }")
    jar = tmp_path / "m2/org/a/lib/1/lib-1.jar"
    jar.parent.mkdir(parents=True)
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("Identity.class", identity_class())
    (tmp_path / "p/pom.xml").write_text("<project><groupId>g</groupId><artifactId>x</artifactId><version>1</version><properties><v>1</v></properties><dependencies><dependency><groupId>org.a</groupId><artifactId>lib</artifactId><version>${v}</version></dependency></dependencies></project>")
    w = Workspace(spark, f"file://{tmp_path}/ws", base, repository=f"file://{tmp_path}/m2")
    w.analyze()
    assert w.table("library_facts").where("relation = 'method_summaries' and a = 'Identity.f(java.lang.Object)'").count() == 1
    again = Workspace(spark, f"file://{tmp_path}/ws2", base, libraries=[f"file://{jar.parent}"])
    again.analyze()
    assert again.table("library_facts").drop("path").count() == w.table("library_facts").count()


def test_analysis_again(spark, tmp_path):
    base = project(tmp_path, A="public class A { public void f(B b) { b.g(); } }", B="public class B { public void g() { } public void h() { } }")
    w = Workspace(spark, f"file://{tmp_path}/ws", base)
    assert w.analyze()["new"] == 2
    first = w._pointer()["tables"]
    assert w.analyze() == {"new": 0, "dirty": 0, "deleted": 0, "same": 2} and w._pointer()["tables"] == first
    (tmp_path / "p/application.properties").write_text("a=b\n")
    w.analyze()
    assert w.table("properties").count() == 1 and w._pointer()["tables"]["facts"] == first["facts"]
    project(tmp_path, A="public class A { public void f(B b) { b.h(); } }")
    # an analysis that stops half way leaves the last one's tables in force
    stopped = Workspace(spark, f"file://{tmp_path}/ws", base)
    stopped._solve = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        stopped.analyze()
    other = Workspace(spark, f"file://{tmp_path}/ws", base)
    assert ("com.w.A.f", "com.w.B.g") in edges(other)
    assert other.analyze()["dirty"] == 1
    assert ("com.w.A.f", "com.w.B.h") in edges(other) and ("com.w.A.f", "com.w.B.g") not in edges(other)
