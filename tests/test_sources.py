"""Scan, extraction and stored states on small trees."""

import json
import os
import re

import pytest

from tessera.operators import code_graph as cg
from tessera.sources import extract, files, state

PY = '''"""Doc."""
import os
from . import (
    a, b)

@app.command()
def main(x, *rest, key=1, **more) -> int:
    helper(x)

    def inner():
        deep()
    class Local(Base):
        pass

class Shape(Base, mix.In):
    size = compute()

    def area(self):
        return self.side() * 2

    def area(self):
        """Again."""

async def main(): ...
'''


def short(rows, *keys):
    return [tuple(r.get(k) for k in keys) for r in rows]


def test_python_records():
    rows = extract.read_file("p/m.py", "Python", PY)
    sym = [r for r in rows if r["record"] in ("class", "function")]
    assert short(sym, "record", "qualified", "ordinal", "owner", "nested") == [
        ("function", "main", 0, None, False), ("function", "main.inner", 0, None, True), ("class", "main.Local", 0, None, True), ("class", "Shape", 0, None, False),
        ("function", "Shape.area", 0, "Shape", False), ("function", "Shape.area", 1, "Shape", False), ("function", "main", 1, None, False)]
    main = sym[0]
    assert main["parameters"] == ["x", "rest", "key", "more"] and main["returns"] == "int" and main["decorators"] == ["app.command()"] and sym[5]["docstring"] == "Again."
    names = {r["id"]: r.get("qualified") for r in rows if r["record"] not in ("call", "import", "inherit")}
    assert {(names[r["id"]], r["name"]) for r in rows if r["record"] == "call"} == {("main", "helper"), ("main.inner", "deep"), ("Shape", "compute"), ("Shape.area", "self.side")}
    assert {(names[r["id"]], r["name"]) for r in rows if r["record"] == "inherit"} == {("main.Local", "Base"), ("Shape", "Base"), ("Shape", "mix.In")}
    assert [r["text"] for r in rows if r["record"] == "import"] == ["import os", "from . import (\n    a, b)"]
    assert len({r["id"] for r in sym}) == len(sym)


JAVA = """import com.acme.Money;
// class Ghost {
public class Shop extends Store implements A, B<C> {
    private int n; /* } */
    public Shop(int a, List<Map<K, V>> b) throws X {
        init(a, "}{");
        if (a > 1) { other.call(); }
    }
    interface Inner { }
}
class Next { void go() { run(); } }
"""


def test_brace_records():
    rows = extract.read_file("S.java", "Java", JAVA)
    assert short([r for r in rows if r["record"] == "class"], "name", "start", "end", "parent", "owner") == [("Shop", 3, 10, "Store, A, B<C>", None), ("Inner", 9, 9, None, "Shop"), ("Next", 11, 11, None, None)]
    f = [r for r in rows if r["record"] == "function"]
    assert short(f, "qualified", "start", "end", "parameters") == [("Shop.Shop", 5, 8, ["a", "b"])]
    assert {r["name"] for r in rows if r["record"] == "call" and r["id"] == f[0]["id"]} == {"init", "other.call"}
    assert [r["name"] for r in rows if r["record"] == "inherit"] == ["Store", "A", "B"] and [r["text"] for r in rows if r["record"] == "import"] == ["import com.acme.Money;"]
    go = "package m\nfunc (s *Server) Run(a int, b string) error {\n\ts.start(a)\n}\ntype Server struct {\n}\n"
    assert [(r["qualified"], r["parameters"], r["owner"]) for r in extract.read_file("x.go", "Go", go) if r["record"] == "function"] == [("Server.Run", ["a", "b"], "Server")]
    ts = "export const f = (a: number, b?: string) => {\n  g(a);\n};\nfunction g(x = 1) { return h(x); }\n"
    assert [(r["name"], r["parameters"]) for r in extract.read_file("x.ts", "TypeScript", ts) if r["record"] == "function"] == [("f", ["a", "b"]), ("g", ["x"])]
    rs = "impl Foo {\n  fn bar(&self, n: u8) -> u8 { baz(n) }\n}\n"
    assert [(r["qualified"], r["parameters"]) for r in extract.read_file("x.rs", "Rust", rs) if r["record"] == "function"] == [("Foo.bar", ["n"])]
    assert extract.read_file("x.js", "JavaScript", "function f( { }")[0]["status"] == "failure"
    big = "class A {\n" + "void m() { x(); }\n" * 20_000 + "}\n"
    assert sum(r["record"] == "class" for r in extract.read_file("A.java", "Java", big)) == 1


def test_arguments_and_delimiters():
    assert extract.split_arguments("a, Map<K, V> b, c = f(1, 2), {d, e}") == ["a", "Map<K, V> b", "c = f(1, 2)", "{d, e}"] and extract.split_arguments(" ") == []
    assert extract.delimiters_balance("([{}])") and not extract.delimiters_balance("([)]") and not extract.delimiters_balance("(") and not extract.delimiters_balance("}")


def test_markdown_records():
    md = "---\ntitle: x\n---\n# Top\nintro\n\nSetext\n------\nbody\n### Sub ###\nsub\n#### deep\nfolded\n```sh\n# no\n````\n## Last\nend\n\nBig\n===\n### Orphan\n"
    rows = extract.read_file("d/R.md", "Markdown", md)
    assert short(rows, "record", "name", "start", "end", "owner") == [("module", "R", 1, 22, None), ("class", "Setext", 7, 16, None), ("function", "Sub", 10, 16, "Setext"), ("class", "Last", 17, 19, None), ("function", "Orphan", 22, 22, None)]
    assert rows[0]["docstring"] == "# Top\nintro" and rows[2]["docstring"].startswith("sub\n#### deep") and rows[1]["docstring"].endswith("body")


def test_ignore_patterns():
    m = lambda pattern, path: bool(files.gitignore_regex(pattern)[1].match(path))
    for pattern, yes, no in [
        ("*.log", ["a.log", "x/a.log"], ["a.logs"]), ("/a", ["a", "a/b"], ["x/a"]), ("a/", ["a/b", "x/a/b"], ["a"]), ("a/*.py", ["a/x.py"], ["a/b/x.py", "z/a/x.py"]), ("**/t", ["t", "a/b/t"], ["tt"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("a/**", ["a/x", "a/x/y"], ["a"]), ("[ab]?.c", ["a1.c", "x/b2.c"], ["c1.c", "a/.c"]), ("[!a].c", ["b.c"], ["a.c"]), (r"\!x", ["!x"], ["x"]), (r"\#x", ["#x"], ["x"]), (r"a\*", ["a*"], ["ab"]), ("x\\ ", ["x "], ["x"]), ("y  ", ["y"], ["y  "]),
    ]:
        assert all(m(pattern, p) for p in yes) and not any(m(pattern, p) for p in no), pattern
    assert files.gitignore_regex("# c") is None and files.gitignore_regex("  ") is None and files.gitignore_regex("/") is None
    assert files.in_docs_scope("docs/a/b.md", files.read_docs_scope(None)) and files.in_docs_scope("README.de.md", files.read_docs_scope(None)) and not files.in_docs_scope("x/docs/a.md", files.read_docs_scope(None))
    scope = files.read_docs_scope('{"docs": {"include": ["*.md", "!secret.md"], "exclude": ["/old/"]}}')
    assert files.in_docs_scope("a/b.md", scope) and not files.in_docs_scope("a/secret.md", scope) and not files.in_docs_scope("old/x.md", scope)
    for bad in ("[", '{"docs": 1}', '{"docs": {"include": "x"}}', "[]"):
        with pytest.raises(ValueError):
            files.read_docs_scope(bad)


def test_scan(spark, tmp_path):
    tree = {
        ".gitignore": "*.tmp\n!keep.tmp\n/gen/\nbuild/\n!build/\n", "a.py": "x=1\n", "keep.tmp": "t", "b.tmp": "t", "gen/c.py": "", "build/d.py": "y", "dist/e.py": "", "sub/.gitignore": "*.py\n!f.py\n", "sub/f.py": "z", "sub/g.py": "",
        ".hidden/h.py": "h", "README.md": "# r", "notes/n.md": "# n", "run": "#!/usr/bin/env node\n", "data.bin": "a\0b", "plain.txt": "t",
    }
    for name, text in tree.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    scanned = files.scan_files(spark, str(tmp_path))
    got = {r["relative_path"]: (r["verdict"], r["language"]) for r in scanned.collect()}
    assert {k for k, v in got.items() if v[0] == "included"} == {"a.py", "build/d.py", "sub/f.py", ".hidden/h.py", "README.md", "run"}
    assert got["notes/n.md"][0] == got["plain.txt"][0] == got["keep.tmp"][0] == "unsupported" and got["data.bin"][0] == "binary" and got["b.tmp"][0] == got["sub/g.py"][0] == "ignored"
    assert "gen/c.py" not in got and "dist/e.py" not in got  # pruned folders are not entered
    out = json.loads(files.scan_json("r", scanned))
    assert out["summary"] == {"total_candidates": len(got), "included_files": 6, "ignored_files": 2, "binary_files": 1, "unsupported_files": len(got) - 9} and [f["relative_path"] for f in out["files"]] == sorted(f["relative_path"] for f in out["files"])


SAMPLE = [
    ("alpha.py", "Python", "from beta import beta_helper\n\n\ndef run_alpha():\n    return beta_helper()\n"),
    ("beta.py", "Python", "from gamma import BaseThing\n\n\ndef beta_helper():\n    return 1\n\n\nclass Child(BaseThing):\n    def run(self):\n        return beta_helper()\n"),
    ("gamma.py", "Python", "class BaseThing:\n    pass\n\n\ndef shared_value():\n    return 3\n"), ("bad.py", "Python", "def ("),
]


def test_from_files_to_graph(spark, tmp_path):
    src = spark.createDataFrame(SAMPLE, "path string, language string, text string")
    records = extract.extract(src).cache()
    assert [r["path"] for r in records.where("status = 'failure'").collect()] == ["bad.py"]
    symbols, imports, calls, inherits = extract.graph_tables(records)
    nodes, edges = cg.build_graph(src.select("path", "language"), symbols.select("id", "kind", "name", "file"), imports, calls, inherits)
    name = {r["id"]: r["name"] for r in nodes.collect()}
    got = {(r["type"], name[r["src"]], name[r["dst"]]) for r in edges.collect()}
    assert got == {("import", "alpha", "beta"), ("import", "beta", "gamma"), ("call", "run_alpha", "beta_helper"), ("call", "run", "beta_helper"), ("inheritance", "Child", "BaseThing")}
    called = edges.where("type = 'call'").select("dst")
    entry = {r["use_case"]: r["kind"] for r in cg.entry_points(symbols, called, src.select("path")).collect()}
    assert entry == {"alpha.run_alpha": "function", "beta.Child.run": "function", "gamma.shared_value": "function"}
    root = str(tmp_path)
    assert state.load_graph(spark, root, "g") is None
    state.save_graph(spark, root, "g", nodes, edges)
    state.save_graph(spark, root, "g", nodes.where("kind <> 'file'"), edges)
    stored, stored_edges = state.load_graph(spark, root, "g")
    assert stored.count() == nodes.where("kind <> 'file'").count() and stored_edges.count() == 5
    with pytest.raises(ValueError):
        state.Published(spark, f"{root}/g").publish(lambda folder: (_ for _ in ()).throw(ValueError("stop")))
    assert state.load_graph(spark, root, "g")[1].count() == 5 and not [f for f in os.listdir(tmp_path / "g") if f.startswith(".staging")]


def test_states(spark, tmp_path):
    root = str(tmp_path)
    entries = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long").orderBy("name")
    path = f"{root}/index.json"
    assert state.write_search_index(spark, path, entries, "t0") and not state.write_search_index(spark, path, entries, "t1") and json.load(open(path))["generatedAt"] == "t0"
    state.write_text(spark, path, "{")
    assert state.write_search_index(spark, path, entries, "t2")
    for s, rows in {"s1": [("/r1", "2024"), ("/r1", "2025")], "s2": [("/r2", "2026")], "s3": [("/r3", None)], "s4": [("", "2027")]}.items():
        spark.createDataFrame(rows, "root_path string, last_indexed_at string").write.parquet(f"{root}/h/{s}/repositories")
    os.makedirs(f"{root}/h/broken/repositories")
    open(f"{root}/h/broken/repositories/x.parquet", "w").write("no")
    os.makedirs(f"{root}/h/none")
    assert [tuple(r) for r in state.history(spark, f"{root}/h").collect()] == [("s2", "/r2", "2026"), ("s1", "/r1", "2025"), ("s3", "/r3", None)]
    sha = "a" * 40
    git = tmp_path / "repo" / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    assert state.commit_of(spark, f"{root}/repo") == ""
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert state.commit_of(spark, f"{root}/repo") == ""
    (git / "packed-refs").write_text(f"# pack\n{sha} refs/heads/main\n^{'b' * 40}\n")
    assert state.commit_of(spark, f"{root}/repo") == sha
    (git / "refs" / "heads" / "main").write_text("c" * 40 + "\n")
    assert state.commit_of(spark, f"{root}/repo") == "c" * 40
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: ../repo/.git\n")
    assert state.commit_of(spark, f"{root}/tree") == "c" * 40


def test_pages_and_redirects(spark, tmp_path):
    pages = spark.createDataFrame([("p1", "feature", "f/one", "# One", "<h1>", ["s", "s"], ["p2"], ["p2", "p3"]), ("p2", "module", "m/two", "# Two", "<h1>", [], [], [])], "page string, kind string, path string, markdown string, html string, sources array<string>, links array<string>, mentioned array<string>")
    m = {r["page"]: r for r in state.write_pages(spark, str(tmp_path), pages).collect()}
    assert m["p1"]["links"] == ["p2", "p3"] and m["p1"]["sources"] == ["s"] and len(m["p1"]["content_hash"]) == 64
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/pages").collect()} == {"f/one.md", "f/one.html", "m/two.md", "m/two.html"}
    aliases = spark.createDataFrame([("old", "mid"), ("mid", "p1"), ("p2", "p1"), ("lost", "nowhere")], "old string, new string")
    titled = pages.select("page", "path").withColumnRenamed("page", "page").selectExpr("page", "path", "concat('T ', page) title")
    assert {r["old"]: r["markdown"] for r in state.redirect_stubs(aliases, titled).collect()} == {x: "This page has moved to [T p1](f/one.md).\n" for x in ("old", "mid")}
    removed = spark.createDataFrame([("p1",), ("p2",)], "page string")
    assert [r["path"] for r in state.deletable(removed, pages.select("page", "path"), spark.createDataFrame([("f/one",)], "old_path string")).collect()] == ["m/two"]


def test_mermaid(spark):
    nodes = spark.createDataFrame([("d", "x", 'A "q"'), ("d", "y", "B"), ("d", "unresolved::function::z", "Z"), ("e", "only", "O")], "diagram string, id string, label string")
    edges = spark.createDataFrame([("d", "y", "x", None, 2), ("d", "x", "y", "calls", 1), ("d", "x", "unresolved::function::z", "no", 3)], "diagram string, src string, dst string, label string, seq long")
    got = {r["diagram"]: r["text"] for r in state.mermaid(nodes, edges).collect()}
    assert got["d"] == "flowchart LR\n    n1[\"A 'q'\"]\n    n2[\"B\"]\n    n1 -->|calls| n2\n    n2 --> n1" and got["e"] == 'flowchart LR\n    n1["O"]'
    assert "n2 <|-- n1: calls" in state.mermaid(nodes, edges, "class").where("diagram = 'd'").first()["text"]
    assert re.search(r"participant n1 as A 'q'", state.mermaid(nodes, edges, "sequence").where("diagram = 'd'").first()["text"])


def test_small_table_of_files_is_dealt_over_the_cores(spark):
    from tessera.plans import source_queries as q

    for name in ("python_symbols", "brace_symbols", "binary_sniff"):
        assert getattr(q, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
