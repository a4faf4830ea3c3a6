"""Symbols, imports, calls and inheritance of source files, one row a record; a file that fails is one row with status ``failure``.

Python is read by its own grammar, brace languages by patterns and brace matching, Markdown by its headings, all
others as a module alone. Every reader passes a file once.
"""

from __future__ import annotations

import ast
import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

SCHEMA = (
    "path string, record string, id string, name string, qualified string, ordinal int, owner string, nested boolean, parent string, parameters array<string>, "
    "returns string, decorators array<string>, docstring string, text string, start long, end long, status string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def symbol_id(kind: str, path: str, qualified: str, ordinal: int) -> str:
    return f"{kind}_{hashlib.sha1(f'{kind}|{path}|{qualified}|{ordinal}'.encode()).hexdigest()[:16]}"


@dataclass
class Inventory:
    """The records of one file; symbols of one kind and qualified name are numbered in the order of the document."""

    path: str
    rows: list[dict] = field(default_factory=list)
    seen: dict = field(default_factory=dict)

    def symbol(self, kind: str, name: str, qualified: str, start: int, end: int, **more) -> str:
        n = self.seen.get((kind, qualified), 0)
        self.seen[kind, qualified] = n + 1
        ident = symbol_id(kind, self.path, qualified, n)
        self.rows.append({"record": kind, "id": ident, "name": name, "qualified": qualified, "ordinal": n, "start": start, "end": end, **more})
        return ident

    def relation(self, record: str, source: str | None, name: str, start: int, end: int, text: str | None = None) -> None:
        self.rows.append({"record": record, "id": source, "name": name, "start": start, "end": end, "text": text})


def read_python(inv: Inventory, text: str) -> None:
    tree = ast.parse(text)
    lines = text.splitlines()
    module = inv.symbol("module", inv.path.rpartition("/")[2].rpartition(".")[0] or inv.path, inv.path, 1, max(len(lines), 1), docstring=ast.get_docstring(tree) or "")
    show = lambda n: ast.unparse(n) if n is not None else None

    def parameters(a: ast.arguments) -> list[str]:
        plain = [x.arg for x in (*a.posonlyargs, *a.args)]
        return plain + ([a.vararg.arg] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([a.kwarg.arg] if a.kwarg else [])

    def define(node, scope: list[str], in_class: bool, in_function: bool) -> None:
        names = [*scope, node.name]
        more = {"docstring": ast.get_docstring(node) or "", "decorators": [show(d) for d in node.decorator_list]}
        if isinstance(node, ast.ClassDef):
            bases = [show(b) for b in node.bases]
            ident = inv.symbol("class", node.name, ".".join(names), node.lineno, node.end_lineno, parent=", ".join(bases) or None, nested=in_function, owner=scope[-1] if in_class else None, **more)
            for b in bases:
                inv.relation("inherit", ident, b, node.lineno, node.end_lineno)
        else:
            ident = inv.symbol("function", node.name, ".".join(names), node.lineno, node.end_lineno, parameters=parameters(node.args), returns=show(node.returns), nested=in_function, owner=scope[-1] if in_class else None, **more)
        body(node.body, ident, names, isinstance(node, ast.ClassDef), in_function or not isinstance(node, ast.ClassDef))

    def body(statements, owner: str, scope: list[str], in_class: bool, in_function: bool) -> None:
        inside = [s for s in statements if not isinstance(s, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
        for s in inside:
            for n in ast.walk(s):
                if isinstance(n, ast.Call):
                    inv.relation("call", owner, show(n.func), n.lineno, n.end_lineno)
        for s in statements:
            if isinstance(s, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                define(s, scope, in_class, in_function)

    for n in ast.walk(tree):
        if isinstance(n, ast.Import | ast.ImportFrom):
            inv.relation("import", module, show(n), n.lineno, n.end_lineno, "\n".join(lines[n.lineno - 1 : n.end_lineno]).strip())
    body(tree.body, module, [], False, False)


_DECLARE = {
    "class": re.compile(r"\b(?:class|interface|struct|enum|trait|type)\s+([A-Za-z_$][\w$]*)"),
    "impl": re.compile(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([A-Za-z_]\w*)"),
    "function": re.compile(
        r"\bfunc\s+\(\s*\w+\s+\*?(?P<recv>\w+)\s*\)\s*(?P<method>\w+)\s*\(|\b(?:func|fn|function)\s*\*?\s+(?P<named>[A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>"
        r"|^\s*(?:[\w<>\[\],.?@\s]+?\s)?(?P<plain>[A-Za-z_$][\w$]*)\s*\([^;{}=]*\)\s*(?::\s*[\w<>\[\]|\s.]+)?(?:throws\s+[\w,\s.]+)?\{"
    ),
    "import": re.compile(r"^\s*(?:import|use|extern crate)\b.*"),
}
_EXTENDS = re.compile(r"\b(?:extends|implements)\s+([\w.$<>,\s]+?)(?=\bimplements\b|\{|$)")
_CALL = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function func fn new else do try match loop typeof sizeof super constructor class".split())
_NOISE = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)


def blanked(text: str) -> str:
    """The text with comments and quoted strings as spaces, line breaks kept, so that their braces count for nothing."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def split_arguments(text: str) -> list[str]:
    """Parameters of a list: commas inside brackets of any kind do not part them."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        depth = max(depth, 0)
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def parameter_name(item: str, language: str) -> str:
    """The name in one parameter of a brace language."""
    item = item.split("=", 1)[0].strip()
    if ":" in item:
        name = item.split(":", 1)[0]
    elif language == "Java":
        name = item.rsplit(" ", 1)[-1]
    else:
        name = item.split(" ", 1)[0]
    return re.sub(r"^(?:mut\s+|\.\.\.|[*&]+)+", "", name.strip()).rstrip("?")


def delimiters_balance(text: str) -> bool:
    """Whether round, curly and square brackets close in the order in which they open."""
    pairs, stack = {")": "(", "}": "{", "]": "["}, []
    for c in text:
        if c in "({[":
            stack.append(c)
        elif c in pairs and (not stack or stack.pop() != pairs[c]):
            return False
    return not stack


def read_braces(inv: Inventory, text: str, language: str) -> None:
    clean = blanked(text)
    if not delimiters_balance(clean):
        raise ValueError("unbalanced delimiters")
    lines, source = clean.split("\n"), text.split("\n")
    module = inv.symbol("module", inv.path.rpartition("/")[2].rpartition(".")[0] or inv.path, inv.path, 1, len(lines), docstring="")
    found = []  # (line, kind, name, receiver)
    for i, line in enumerate(lines):
        if _DECLARE["import"].match(source[i]):
            inv.relation("import", module, source[i].strip().rstrip(";"), i + 1, i + 1, source[i].strip())
            continue
        c, p, f = _DECLARE["class"].search(line), _DECLARE["impl"].match(line), _DECLARE["function"].search(line)
        if p:
            found.append((i, "impl", p[1], None))
        elif c and not (f and f["named"]):
            found.append((i, "class", c[1], None))
        elif f and (name := f["method"] or f["named"] or f["arrow"] or f["plain"]) and name not in _KEYWORDS:
            found.append((i, "function", name, f["recv"]))
    at = {d[0]: k for k, d in enumerate(found)}
    ends, inside, stack, waiting = [d[0] for d in found], [None] * len(lines), [], None
    for i, line in enumerate(lines):  # one pass: each brace belongs to the declaration that waits for it
        waiting = at.get(i, waiting)
        for c in line:
            if c == "{":
                stack.append(waiting)
                waiting = None
            elif c == "}" and stack and (k := stack.pop()) is not None:
                ends[k] = i
            elif c == ";" and waiting is not None:
                waiting = None
        inside[i] = next((k for k in reversed(stack) if k is not None), None)
    parents, open_ = [], []
    for k, (i, *_) in enumerate(found):
        while open_ and ends[open_[-1]] < i:
            open_.pop()
        parents.append(open_[-1] if open_ else None)
        open_.append(k)
    ids: list[str | None] = []
    for k, (i, kind, name, receiver) in enumerate(found):
        up = parents[k]
        holder = receiver or (found[up][2] if up is not None and found[up][1] in ("class", "impl") else None)
        if kind == "impl":
            ids.append(None)
            continue
        if kind == "class":
            bases = [b for m in _EXTENDS.finditer(lines[i]) for b in split_arguments(m[1])]
            ids.append(inv.symbol("class", name, name, i + 1, ends[k] + 1, parent=", ".join(bases) or None, owner=holder))
            for b in bases:
                inv.relation("inherit", ids[-1], re.sub(r"<.*", "", b), i + 1, ends[k] + 1)
            continue
        head = "\n".join(lines[i : min(ends[k], i + 20) + 1])
        opened = head.find("(", head.find(name) + len(name))
        depth, close = 0, opened
        for close in range(opened, len(head)) if opened >= 0 else ():  # noqa: B007
            depth += (head[close] == "(") - (head[close] == ")")
            if depth == 0:
                break
        args = [parameter_name(x, language) for x in split_arguments(head[opened + 1 : close])] if opened >= 0 else []
        nested = up is not None and found[up][1] == "function"
        ids.append(inv.symbol("function", name, f"{holder}.{name}" if holder else name, i + 1, ends[k] + 1, owner=holder, nested=nested, parameters=[x for x in args if x not in ("self", "")]))
    callers = [k if d[1] == "function" else None for k, d in enumerate(found)]
    for i, line in enumerate(lines):
        k = at.get(i, inside[i])
        while k is not None and callers[k] is None:
            k = parents[k]
        for m in _CALL.finditer(line):
            if m[1] not in _KEYWORDS and not (i in at and found[at[i]][2] == m[1].rpartition(".")[2]):
                inv.relation("call", ids[k] if k is not None else module, m[1], i + 1, i + 1)


def markdown_headings(lines: list[str]) -> list[tuple[int, str, int]]:
    """(level, title, line) of the headings in both forms; front matter and fenced code have none."""
    out: list[tuple[int, str, int]] = []
    rule = re.compile(r"---\s*$")
    start = next((i + 1 for i in range(1, len(lines)) if rule.match(lines[i])), 0) if lines and rule.match(lines[0]) else 0
    fence = ""
    for i in range(start, len(lines)):
        line = lines[i]
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence):
                fence = ""
            continue
        if fence:
            continue
        atx = re.match(r" {0,3}(#{1,6})(?:\s+(.*))?$", line)
        under = re.match(r" {0,3}(=+|-+)\s*$", line)
        if atx:
            out.append((len(atx[1]), (atx[2] or "").strip().rstrip("#").strip(), i + 1))
        elif under and i > start and lines[i - 1].strip() and not re.match(r" {0,3}(#{1,6}(\s|$)|`{3,}|~{3,})", lines[i - 1]) and not (out and out[-1][2] == i):
            out.append((1 if under[1][0] == "=" else 2, lines[i - 1].strip(), i))
    return out


def read_markdown(inv: Inventory, text: str) -> None:
    """Level-2 headings as classes, level-3 ones as functions of the class they lie in; deeper ones are text of what is above.

    A section ends before the next heading of its level or above, its own text before the next section.
    """
    lines = text.splitlines()
    heads = markdown_headings(lines)
    total = max(len(lines), 1)
    sections = [k for k, h in enumerate(heads) if h[0] in (2, 3)]
    intro = heads[sections[0]][2] - 1 if sections else total
    start = next((i + 1 for i in range(1, len(lines)) if re.match(r"---\s*$", lines[i])), 0) if lines and re.match(r"---\s*$", lines[0]) else 0
    inv.symbol("module", inv.path.rpartition("/")[2].rpartition(".")[0] or inv.path, inv.path, 1, total, docstring="\n".join(lines[start:intro]).strip())
    holder, until = None, 0
    for n, k in enumerate(sections):
        level, title, line = heads[k]
        end = next((h[2] - 1 for h in heads[k + 1 :] if h[0] <= level), total)
        body_end = heads[sections[n + 1]][2] - 1 if n + 1 < len(sections) else total
        slug = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
        body = "\n".join(lines[line:body_end]).strip()
        if level == 2:
            holder, until = title or "Section", max(line, end)
            inv.symbol("class", holder, slug, line, until, docstring=body)
        else:
            inv.symbol("function", title or "Section", slug, line, max(line, end), owner=holder if line <= until else None, docstring=body)


def read_file(path: str, language: str | None, text: str | None) -> list[dict]:
    """All records of one file, each with its path and status."""
    text = text or ""
    inv = Inventory(path)
    try:
        if language == "Python":
            read_python(inv, text)
        elif language == "Markdown":
            read_markdown(inv, text)
        elif language in ("JavaScript", "TypeScript", "Java", "Go", "Rust"):
            read_braces(inv, text, language)
        else:
            inv.symbol("module", path.rpartition("/")[2].rpartition(".")[0] or path, path, 1, max(text.count("\n") + 1, 1), docstring="")
        status = "success"
    except (SyntaxError, ValueError, RecursionError):
        inv = Inventory(path)
        inv.symbol("module", path, path, 1, 1)
        status = "failure"
    return [{"nested": False, **r, "path": path, "status": status} for r in inv.rows]


def extract(files: DataFrame) -> DataFrame:
    """files(path, language, text) -> the records of SCHEMA."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for x in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) for r in read_file(*x)]
            yield pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in rows], columns=_COLUMNS).astype({"ordinal": "Int32"})

    ship_package(files.sparkSession)
    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)


def graph_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, calls, inherits) of extract()'s records, as build_graph() takes them."""
    of = lambda *kinds: records.where(F.col("record").isin(*kinds))
    file = F.col("path").alias("file")
    symbols = of("class", "function").select("id", F.col("record").alias("kind"), "name", file, "owner", "nested", F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"))
    imports = of("import").select(file, "text", F.col("start").alias("seq"))
    calls = of("call").select(file, F.col("id").alias("caller"), F.col("name").alias("callee"), F.col("start").alias("line"))
    return symbols, imports, calls, of("inherit").select(file, F.col("id").alias("subclass"), F.col("name").alias("parent"), F.col("start").alias("line"))


def python_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """(record, qualified name or name, first line, last line) of a Python text."""
    return _short("x.py", "Python", text)


def brace_symbols(text: str, language: str = "Java") -> list[tuple[str, str, int, int]]:
    return _short("x.java", language, text)


def markdown_sections(text: str) -> list[tuple[str, str, int, int]]:
    return _short("x.md", "Markdown", text)


def _short(path: str, language: str, text: str) -> list[tuple[str, str, int, int]]:
    inv = Inventory(path)
    {"Python": read_python, "Markdown": read_markdown}.get(language, lambda i, t: read_braces(i, t, language))(inv, text)
    return [(r["record"], r["name"] if language == "Markdown" else r.get("qualified") or r["name"], r["start"], r["end"]) for r in inv.rows if r["record"] != "module"]
