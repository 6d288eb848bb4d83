import pytest

from factflow.streaming import snapshots
from factflow.workspace import NotFound, Workspace


def test_analyse_and_query(spark, tmp_path):
    p = tmp_path / "project/com/t"
    p.mkdir(parents=True)
    (p / "Repo.java").write_text("package com.t; @Repository public class Repo { public String load(String k) { return k; } }")
    (p / "Api.java").write_text('package com.t; @RestController public class Api { @Autowired private Repo repo; @GetMapping("/x") public String get(String k) { String r = repo.load(k); return r; } }')
    (tmp_path / "project/application.properties").write_text("a=b\n")
    w = Workspace(spark, f"file://{tmp_path}/ws", f"file://{tmp_path}/project")
    with pytest.raises(NotFound):
        w.routes()
    assert w.analyze() == {"new": 2, "dirty": 0, "deleted": 0, "same": 0}
    assert [(r.caller, r.callee, r.is_virtual) for r in w.call_graph("Api.get").collect()] == [("com.t.Api.get", "com.t.Repo.load", 1)]
    assert [tuple(r) for r in w.routes("/x").collect()] == [("GET", "/x", "com.t.Api.get(String)".replace("String", "java.lang.String"))]
    nodes, _ = w.lineage("Api.get(java.lang.String)#k")
    assert "com.t.Repo.load(java.lang.String)#p0" in {r.node for r in nodes.collect()}


def test_stream_of_snapshots(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    run = lambda: snapshots.changes(spark, spark.readStream.schema("file_path string, hash string").parquet(src), str(tmp_path / "state"), str(tmp_path / "check"), lambda df, n: seen.append(sorted((r.file_path, r.status) for r in df.collect()))).awaitTermination()
    spark.createDataFrame([("a", "1"), ("b", "1")], "file_path string, hash string").write.parquet(src)
    run()
    spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "file_path string, hash string").write.mode("append").parquet(src)
    run()
    assert seen == [[("a", "new"), ("b", "new")], [("b", "dirty"), ("c", "new")]]
