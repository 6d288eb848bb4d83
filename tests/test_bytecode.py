import struct

from factflow.sources import classfile, maven


def u2(x):
    return struct.pack(">H", x)


def utf(s):
    return b"\x01" + u2(len(s)) + s.encode()


def identity_class():
    pool = [utf("Identity"), b"\x07" + u2(1), utf("java/lang/Object"), b"\x07" + u2(3), utf("f"), utf("(Ljava/lang/Object;)Ljava/lang/Object;"), utf("Code")]
    code = b"\x2a\xb0"
    attr = u2(7) + struct.pack(">I", 12 + len(code)) + u2(1) + u2(1) + struct.pack(">I", len(code)) + code + u2(0) + u2(0)
    method = u2(9) + u2(5) + u2(6) + u2(1) + attr
    return b"\xca\xfe\xba\xbe" + u2(0) + u2(52) + u2(len(pool) + 1) + b"".join(pool) + u2(0x21) + u2(2) + u2(4) + u2(0) + u2(0) + u2(1) + method + u2(0)


def test_summary_of_a_returned_parameter(spark):
    df = spark.createDataFrame([("h", "/x/Identity.class", bytearray(identity_class())), ("b", "/x/Bad.class", bytearray(b"zz"))], "content_hash string, path string, content binary")
    tagged = classfile.facts(df)
    assert [tuple(r) for r in classfile.relation(tagged, "method_summaries").collect()] == [("Identity.f(java.lang.Object)", 0)]
    assert classfile.relation(tagged, "errors").count() == 1
    cached = classfile.facts(df, tagged.where("content_hash = 'h'"))
    assert classfile.relation(cached, "classes").count() == 1


def test_descriptor():
    assert classfile.descriptor("(ILjava/lang/String;[J)V") == (["int", "java.lang.String", "long[]"], "void")


def test_switches():
    table = b"\xaa\x00\x00\x00" + struct.pack(">iii", 0, 0, 1) + struct.pack(">ii", 0, 0) + b"\xb1"
    lookup = b"\xab\x00\x00\x00" + struct.pack(">ii", 0, 1) + struct.pack(">ii", 5, 0) + b"\xb1"
    for code in (table, lookup):
        assert [op for _, op, _ in classfile.instructions(code)][-1] == 0xB1
    for bad in (b"\xaa\x00\x00\x00" + struct.pack(">iii", 0, 0, 2**31 - 1), b"\xab\x00\x00\x00" + struct.pack(">ii", 0, -5), b"\xaa\x00"):
        assert list(classfile.instructions(bad)) == []


def test_maven(tmp_path):
    repo = tmp_path / "m2"
    jar = repo / "org/a/lib/1.2/lib-1.2.jar"
    jar.parent.mkdir(parents=True)
    jar.write_bytes(b"")
    (tmp_path / "pom.xml").write_text("<project><groupId>g</groupId><artifactId>root</artifactId><version>1</version><properties><v>1.2</v></properties><dependencyManagement><dependencies><dependency><groupId>org.a</groupId><artifactId>lib</artifactId><version>${v}</version></dependency></dependencies></dependencyManagement></project>")
    child = tmp_path / "c"
    child.mkdir()
    (child / "pom.xml").write_text('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId><artifactId>root</artifactId><version>1</version></parent><artifactId>c</artifactId><dependencies><dependency><groupId>org.a</groupId><artifactId>lib</artifactId></dependency><dependency><groupId>org.b</groupId><artifactId>gone</artifactId><version>3</version></dependency><dependency><groupId>org.a</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>')
    assert maven.jars(child / "pom.xml", repo) == [jar]
    assert maven.interpolate("${a}", {"a": "${b}", "b": "x"}) == "x"
