from tessera.functions.html import sanitize
from tessera.sources import extract, files


def test_ignore_rules():
    rules = {"": ["*.log", "!keep.log", "/only_root", "build/"], "sub": ["!x.log"]}
    assert files.ignored("a/b.log", rules) is True
    assert files.ignored("a/keep.log", rules) is False
    assert files.ignored("sub/x.log", rules) is False
    assert files.ignored("only_root", rules) is True and files.ignored("a/only_root", rules) is None
    assert files.ignored("build/x.py", rules) is True and files.ignored("x.py", rules) is None


def test_binary():
    assert files.is_binary(b"a\0b") and not files.is_binary("é".encode()[:1] and "text é".encode()[:-1])
    assert files.is_binary(bytes(range(1, 32)) * 10)


def test_symbols():
    py = extract.python_symbols("import a\nclass B:\n    def c(self):\n        d()\ndef e(): pass\n")
    assert ("class", "B", 2, 4) in py and ("function", "B.c", 3, 4) in py and ("function", "e", 5, 5) in py and ("call", "d", 4, 4) in py
    assert ("class", "A", 1, 3) in extract.brace_symbols("class A {\n  int x;\n}\n")
    md = extract.markdown_sections("# t\n## a\nx\n```\n## no\n```\n### b\ny\n## c\n")
    assert md == [("class", "a", 2, 8), ("function", "b", 7, 8), ("class", "c", 9, 9)]


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("1")
    (tmp_path / "a.py").write_text("def f(): pass\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "run").write_text("#!/usr/bin/env python\n")
    (tmp_path / ".gitignore").write_text("*.tmp\n")
    (tmp_path / "z.tmp").write_text("z")
    got = {r["relative_path"]: r["language"] for r in files.scan_repository(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "Python", "bad.py": "Python", "run": "Python"}
    df = spark.createDataFrame([("a.py", "Python", "def f(): pass\n"), ("bad.py", "Python", "def ("), ("k.kt", "Kotlin", None)], "path string, language string, text string")
    assert {(r["path"], r["record"], r["status"]) for r in extract.extract(df).collect()} == {("a.py", "module", "success"), ("a.py", "function", "success"), ("bad.py", "module", "failure"), ("k.kt", "module", "success")}


def test_sanitize():
    assert sanitize('<p onclick="x">a<script>b</script><a href="javascript:x" title="t">c</a><br></p>') == '<p>a&lt;script&gt;b&lt;/script&gt;<a title="t">c</a><br /></p>'
