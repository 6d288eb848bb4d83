from pyspark.sql import functions as F

from factflow.functions import names as N


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_method_parts(spark):
    m = F.lit("a.B$C.run(int,java.util.Map)")
    assert value(spark, N.strip_signature(m)) == "a.B$C.run"
    assert value(spark, N.param_count(m)) == 2
    assert value(spark, N.class_of_method(m)) == "a.B$C"
    assert value(spark, N.first_param(m)) == "int"
    assert value(spark, N.param_count(F.lit("a.B.run( )"))) == 0
    assert value(spark, N.first_param(F.lit("a.B.run()"))) is None
    assert value(spark, N.class_of_method(F.lit("run"))) == "run"


def test_method_matching(spark):
    cands = ["com.a.S.run(int)", "com.a.S.run()", "com.a.T.run(int, long)", "com.a.XS.run(int)"]
    want = {
        "S.run": ["com.a.S.run(int)", "com.a.S.run()"], "run()": ["com.a.S.run()"], "S.run(int)": ["com.a.S.run(int)"], "run(int,long)": ["com.a.T.run(int, long)"], "zz": [],
    }
    df = spark.createDataFrame([(c,) for c in cands], "c string")
    for q, found in want.items():
        assert sorted(r.c for r in df.where(N.matches_method(F.col("c"), F.lit(q))).collect()) == sorted(found), q


def test_node_matching(spark):
    cands = ["a.B.m(int)#x", "a.B.m(int)#y", "a.C.m()#x", "StringAlloc:1", "a.B.f"]
    df = spark.createDataFrame([(c,) for c in cands], "c string")
    find = lambda q: sorted(r.c for r in df.where(N.matches_node(F.col("c"), F.lit(q))).collect())
    assert find("x") == ["a.B.m(int)#x", "a.C.m()#x"]
    assert find("B.m#x") == ["a.B.m(int)#x"]
    assert find("B.m(int)") == ["a.B.m(int)#x", "a.B.m(int)#y"]
    assert find("f") == ["a.B.f"]


def test_paths(spark):
    both = lambda a, b: value(spark, N.combine_paths(F.lit(a), F.lit(b)))
    assert both("api/", "/users/") == "/api/users"
    assert both("", "") == "/"
    assert both("//a//b", "") == "/a/b"
    paths = lambda a: value(spark, N.annotation_paths(F.lit(a)))
    assert paths('{"/users/add","/users/create"}') == ["/users/add", "/users/create"]
    assert paths("value = '/x'") == ["/x"]
    assert paths("") == [""]
    assert paths("BASE") == ["BASE"]
    assert value(spark, N.http_methods(F.lit("RequestMapping"), F.lit("method={RequestMethod.GET, RequestMethod.POST}"))) == ["GET", "POST"]
    assert value(spark, N.http_methods(F.lit("RequestMapping"), F.lit(None).cast("string"))) == ["ANY"]
    assert value(spark, N.http_methods(F.lit("PatchMapping"), F.lit(""))) == ["PATCH"]


def test_pointcuts(spark):
    within = lambda m, p: value(spark, N.matches_within(F.lit(m), F.lit(p)))
    assert within("com.t.A.m(int)", "com.t..*")
    assert not within("com.tt.A.m()", "com.t..*")
    assert within("com.t.A.m()", "com.t.A")
    assert within("com.t.A.m()", "com.t.A.m")
    assert value(spark, N.pointcut_patterns(F.lit("within(a.b..*) || execution(* c.D.*(..)) || args(x)"))) == ["a.b..*", "c.D.*"]


def test_placeholder(spark):
    p = lambda v: tuple(value(spark, N.placeholder(F.lit(v))))
    assert p('"${server.port:8080}"') == ("server.port", "8080", None)
    assert p("${a.b}") == ("a.b", "a.b", None)
    assert p("'plain'") == (None, None, "plain")


def test_priorities_and_temporaries(spark):
    assert value(spark, N.is_collapsible(F.lit("a.B.m()#temp_void_call_1")))
    assert not value(spark, N.is_collapsible(F.lit("a.B.m()#temp_anorm_1")))
    assert value(spark, N.edge_priority(F.lit("PASS_RET"))) > value(spark, N.edge_priority(F.lit("COPY"))) > value(spark, N.edge_priority(F.lit("ALLOC")))
