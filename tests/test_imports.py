"""Import resolution over tables of any size: neither files nor imports go whole through the driver."""

from loomctx.operators import graph


def test_no_side_is_broadcast(spark):
    imports = [("a/x.py", "b.m", "python"), ("a/x.py", ".y", "python"), ("web/i.ts", "./c", "typescript"), ("j/From.java", "com.K", "java"), ("j/From.java", "org.Two", "java"), ("a/x.py", "x", "python")]
    files = [("a/x.py",), ("a/y.py",), ("b/m.py",), ("web/c.tsx",), ("j/com/K.java",), ("j/p/Two.java",), ("j/q/Two.java",)]
    found = graph.resolve_imports(spark.createDataFrame(imports, "path string, module string, lang string"), spark.createDataFrame(files, "path string"))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("a/x.py", ".y", "a/y.py"), ("a/x.py", "b.m", "b/m.py"), ("j/From.java", "com.K", "j/com/K.java"), ("web/i.ts", "./c", "web/c.tsx")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
