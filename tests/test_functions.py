import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions import text as T
from loomctx.functions.parse import parse
from loomctx.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("a  \r\nb\r", "a\nb\n"), ("x\n\n\n", "x\n"), ("", "\n"), ("\ufeffx", "x\n"), ("a\tb\t", "a\tb\n"), ("\n\nx", "\n\nx\n"), ("a\u00a0\n", "a\u00a0\n"), (" \n \n", "\n")])
def test_normalize(spark, raw, want):
    got = one(spark, T.normalize("t"), t=raw)
    assert got == want
    assert one(spark, T.normalize("t"), t=got) == got


def test_hash_spaces_are_apart(spark):
    digests = [one(spark, T.content_hash(k, "l", "t"), l=lang, t="same") for k in (2, 3) for lang in ("python", "typescript")]
    assert len(set(digests)) == 4 and all(re.fullmatch("[0-9a-f]{64}", d) for d in digests)


def test_query_tokens(spark):
    paths, symbols = T.query_tokens("q")
    q = "Fix `PaymentValidator` in src/app.py, not Foo. or é (a_b)"
    assert one(spark, paths, q=q) == ["src/app.py", "Foo."]
    assert one(spark, symbols, q=q) == ["Fix", "PaymentValidator", "not", "a_b"]


def test_contains_word_is_exact(spark):
    for text, want in (("use ab now", True), ("abc", False), ("_ab", False), ("éab", False), ("(ab)", True), ("", False)):
        assert one(spark, T.contains_word("t", F.lit("ab")), t=text) is want


def test_upper_median_and_ewma(spark):
    assert one(spark, T.upper_median(F.array(*map(F.lit, [1.0, 4.0, 2.0, 3.0])))) == 3.0
    assert one(spark, F.round(T.ewma(F.lit(5)), 4)) == 4.0951


@given(st.lists(st.integers(0, 8), unique=True, max_size=6), st.lists(st.integers(0, 8), unique=True, max_size=8))
@settings(max_examples=8, deadline=None)
def test_subsequence(spark, part, whole):
    it = iter(whole)
    want = all(any(x == y for y in it) for x in part)
    lists = spark.createDataFrame([(part, whole)], "a array<int>, b array<int>")
    assert lists.select(T.is_subsequence(F.col("a"), F.col("b"))).first()[0] is want


def test_unknown_mode():
    with pytest.raises(ValueError, match="unknown mode 'yolo'"):
        S.profile("yolo")
    assert S.profile("")["mode"] == "default"
    assert S.profile("architecture")["w_centrality"] == 0.2


PYTHON = '''from __future__ import annotations
import os, a.b as c
from .x import y

@dec(1)
def f(a, b=g()):
    """Doc é line.

    more"""
    return self.h(k(a))

class A(B, m.C):
    async def q(self, z):
        await run(z)
'''


def test_python():
    decls, imports = parse("python", PYTHON)
    f, a = decls
    assert imports == ["os", "a.b", ".x"]
    assert f["signature"] == 'def f(a, b=g()):\n    """Doc é line."""\n    ...\n' and f["calls"] == ["g", "h", "k"] and f["line_start"] == 5
    assert a["bases"] == ["B", "C"] and a["signature"] == "class A(B, m.C):\n    async def q(self, z): ...\n"
    data = PYTHON.encode()
    assert data[f["byte_start"] : f["byte_end"]].startswith(b"@dec") and data[a["byte_start"] : a["byte_end"]].endswith(b"run(z)")


def test_broken_python_still_has_declarations():
    decls, imports = parse("python", "import os\n\ndef ok(a):\n    return run(a)\n\ndef bad(:\n    x\n")
    assert [d["name"] for d in decls] == ["ok", "bad"] and imports == ["os"] and decls[0]["calls"] == ["run"]


def test_typescript():
    decls, imports = parse("typescript", """import { a } from "./a";
export default class Foo<T> extends Bar implements Baz {
  name = "a{b";
  async run(a: string): Promise<void> { const r = /[/}]/g; await this.go(`x ${fmt(a)} }`); }
}
export const add = async (a: number): Promise<number> => { return sum(a); };
export interface I { a: string }
type U = 'a' | 'b';
const notfn = 5;
""")
    assert imports == ["./a"] and [d["name"] for d in decls] == ["Foo", "add", "I", "U"]
    assert decls[0]["calls"] == ["fmt", "go"] and decls[0]["bases"] == ["Bar"] and decls[0]["impls"] == ["Baz"]
    assert decls[1]["signature"].startswith("export const add = async (a: number): Promise<number> =>")


def test_java():
    decls, imports = parse("java", """package p;
import java.util.List;
@Deprecated
public final class Foo extends Base<Arg> implements A {
  private int x = compute(1);
  @Override public int run(String s) throws E { helper(s); return new Inner().call(); }
  class Inner { int call() { return 1; } }
}
interface I extends J, K { void m(); }
record R(int a) { int twice() { return dbl(a); } }
""")
    assert imports == ["java.util.List"] and [d["kind"] for d in decls] == ["class", "interface", "record"]
    assert decls[0]["calls"] == ["Inner", "call", "compute", "helper"] and decls[0]["bases"] == ["Base", "Arg"] and decls[1]["impls"] == ["J", "K"]


def test_ignore_rules(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("*.log\n/build/\n!keep.log\n")
    (tmp_path / "a" / ".gitignore").write_text("b/\n")
    for name in ("x.py", "y.log", "keep.log", "a/z.py", "a/b/no.py", "img.PNG", "yarn.lock", "m.min.js", ".hidden", "__init__.py"):
        (tmp_path / name).write_text("x")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "out.py").write_text("x")
    (tmp_path / "big.py").write_bytes(b"x" * (files.MAX_BYTES + 1))
    assert [f[0] for f in files.repo_files(str(tmp_path))] == ["__init__.py", "a/z.py", "keep.log", "x.py"]
