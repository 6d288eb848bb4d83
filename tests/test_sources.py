from pyspark.sql import functions as F

from factflow.operators import pointsto, spring
from factflow.sources import config, java

CODE = {
    "Strategy.java": "package com.t; public interface Strategy { Item execute(Item i); }",
    "A.java": "package com.t; @Service public class A implements Strategy { public Item execute(Item i) { return i; } /* x */ }",
    "Item.java": "package com.t; public class Item { }",
    "Holder.java": 'package com.t; class Holder<T> { private Item f; void set(Item x) { this.f = x; } Item get() { return f; } static class In { String s = "a;{b"; } }',
    "Client.java": """package com.t; import java.util.List;
@RestController @RequestMapping("/api/v1")
public class Client {
  @Autowired private Strategy strategy;
  // comment ; {
  @GetMapping("/users") public Item run(@PathVariable int id) throws Exception {
    Strategy s = new A();
    Item item = new Item();
    if (id > 3) { Item out = s.execute(item); return out; }
    Holder h = new Holder(); h.set(item); String q = "x;y";
    return h.get();
  }
}""",
}


def tagged(spark):
    return java.facts(spark.createDataFrame([(f"/p/{n}", bytearray(c.encode())) for n, c in CODE.items()], "path string, content binary")).cache()


def test_java_to_call_graph(spark):
    t = tagged(spark)
    get = lambda n: java.relation(t, n)
    assert get("errors").count() == 0
    assert {r.fqn for r in get("classes").collect()} == {"com.t.Strategy", "com.t.A", "com.t.Item", "com.t.Holder", "com.t.Holder$In", "com.t.Client"}
    assert {(r.class_fqn, r.parent_fqn) for r in get("class_hierarchy").collect()} == {("com.t.A", "com.t.Strategy")}
    assert "com.t.Client.run(int)" in {r.method_fqn for r in get("method_declarations").collect()}
    ann = {(r.field_name, r.annotation_name) for r in get("field_annotations").collect()}
    assert {("strategy", "Autowired"), ("strategy", "FieldType:com.t.Strategy"), ("f", "FieldType:com.t.Item")} <= ann
    f = pointsto.Facts(get("class_hierarchy"), get("method_declarations"), get("allocation_sites"), get("source_assignments"), get("call_sites"), get("call_arguments"))
    s = pointsto.solve(spark, f)
    edges = {(r.caller, r.callee, r.is_virtual) for r in s.call_edges().collect()}
    assert {("com.t.Client.run", "com.t.A.execute", 1), ("com.t.Client.run", "com.t.Holder.set", 1), ("com.t.Client.run", "com.t.Holder.get", 1)} <= edges
    item = next(r.alloc_id for r in get("allocation_sites").where("class_fqn = 'com.t.Item'").collect())
    assert {r.alloc for r in s.pts.where(F.col("var") == "com.t.Client.run(int)#return").collect()} == {item}
    routes = spring.routes_of_annotations(get("class_annotations"), get("method_annotations"))
    assert [tuple(r) for r in routes.collect()] == [("GET", "/api/v1/users", "com.t.Client.run(int)")]


def test_config(spark):
    files = {
        "application.properties": "spring.profiles.active=dev\nserver.port=8080\napp.name = 'my-app'\n# c\nbad",
        "application-dev.yml": "server:\n  port: 9090 # dev\napp:\n  desc: \"development mode\"\n",
        "application-prod.yml": "server:\n  port: 1\n",
    }
    df = spark.createDataFrame([(f"/p/{n}", bytearray(c.encode())) for n, c in files.items()], "path string, content binary")
    got = {r.key: r.value for r in config.resolved(config.entries(df)).collect()}
    assert got == {"spring.profiles.active": "dev", "server.port": "9090", "app.name": "my-app", "app.desc": "development mode"}


def test_broken_source_is_reported_not_raised(spark):
    df = spark.createDataFrame([("/p/X.java", bytearray(b"class X { void m( { ")), ("/p/Y.java", None)], "path string, content binary")
    assert java.relation(java.facts(df), "classes").count() <= 1
