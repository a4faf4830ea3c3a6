"""Repository scan: ignore rules, documentation scope, binary sniffing, language detection."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXCLUDED_FOLDERS, language_of
from ..session import ship_package


def _segment_regex(p: str) -> str:
    """One pattern as a regular expression: ``*`` and ``?`` stay within a segment, ``**`` crosses, ``[...]`` is a class, a backslash takes the next character as it is."""
    out, i = "", 0
    while i < len(p):
        close = p.find("]", i + 2) if p[i] == "[" else -1
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + len(p[i:]) - len(p[i:].lstrip("*"))
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif close > 0:
            body = p[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", close + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return out


def gitignore_regex(pattern: str) -> tuple[bool, re.Pattern] | None:
    """(negated, matcher over relative paths) of one ignore line; None for blanks and comments.

    ``!`` negates, ``\\!`` and ``\\#`` are literal, spaces at the end count only behind a backslash.
    """
    p = re.sub(r"(?<!\\) +$", "", pattern.rstrip("\r\n"))
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    folder_only = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    if not p:
        return None
    return negated, re.compile(("" if anchored else "(?:.*/)?") + _segment_regex(p) + ("/.*" if folder_only else "(?:/.*)?") + r"\Z", re.S)


#: Which documents belong to a repository's documentation unless it says otherwise.
DOCS_INCLUDE = ["/README*.md", "/README*.markdown", "/docs/", "/doc/", "/documentation/"]


def read_docs_scope(text: str | None) -> tuple[list[str], list[str]]:
    """(include, exclude) patterns of a configuration ``{"docs": {"include": [...], "exclude": [...]}}``; the defaults without one. A malformed one raises ValueError."""
    if text is None:
        return DOCS_INCLUDE, []
    config = json.loads(text)
    docs = config.get("docs", {}) if isinstance(config, dict) else None
    if not isinstance(docs, dict):
        raise ValueError("docs must be an object")
    out = docs.get("include", DOCS_INCLUDE), docs.get("exclude", [])
    if not all(isinstance(x, list) and all(isinstance(p, str) for p in x) for x in out):
        raise ValueError("include and exclude must be lists of patterns")
    return out


def in_docs_scope(path: str, scope: tuple[list[str], list[str]]) -> bool:
    """The last include pattern that matches must not be negated, and no exclude pattern may hold."""
    include, exclude = (ignored(path, {"": list(patterns)}) for patterns in scope)
    return include is True and exclude is not True


@lru_cache(maxsize=10_000)
def _compiled(line: str) -> tuple[bool, re.Pattern] | None:
    return gitignore_regex(line)


def ignored(path: str, rules: dict[str, list[str]]) -> bool | None:
    """The nearest folder's rules that have an opinion decide, the last matching line of them; None without one."""
    folder = path.rpartition("/")[0]
    while True:
        rel = path[len(folder) + 1 :] if folder else path
        for line in reversed(rules.get(folder, [])):
            got = _compiled(line)
            if got and got[1].match(rel):
                return not got[0]
        if not folder:
            return None
        folder = folder.rpartition("/")[0]


def is_binary(head: bytes) -> bool:
    if b"\0" in head:
        return True
    for cut in range(4):
        try:
            text = head[: len(head) - cut].decode("utf-8")
            return sum(c < " " and c not in "\t\n\r\f\b" or c == "\x7f" for c in text) > 0.3 * max(len(text), 1)
        except UnicodeDecodeError:
            continue
    return sum(c < 32 and c not in b"\t\n\r\f\b" or c >= 127 for c in head) > 0.3 * len(head)


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path).toString().rstrip("/")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file through the file system that Spark uses; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place) or fs.getFileStatus(place).isDirectory():
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def walk(spark: SparkSession, root: str) -> tuple[list[str], dict[str, list[str]]]:
    """(relative paths of all files, hidden ones too; folder -> lines of its .gitignore).

    Folders are entered one by one, so an ignored or excluded folder is pruned, and an unreadable one is skipped.
    What the driver holds is names, not contents.
    """
    fs, base = _file_system(spark, root)
    rules: dict[str, list[str]] = {}
    paths, stack = [], [""]
    while stack:
        folder = stack.pop()
        try:
            found = list(fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}" if folder else base)))
        except Exception as unreadable:  # noqa: BLE001
            if "AccessControl" in str(unreadable) or "Permission" in str(unreadable) or "FileNotFound" in str(unreadable):
                continue
            raise
        names = sorted((f.getPath().getName(), f.isDirectory()) for f in found)
        if (".gitignore", False) in names:
            rules[folder] = (read_text(spark, f"{base}/{folder}/.gitignore" if folder else f"{base}/.gitignore") or "").splitlines()
        for name, is_folder in names:
            path = f"{folder}/{name}" if folder else name
            if not is_folder:
                paths.append(path)
            elif not shut_out(path, rules, True):
                stack.append(path)
    return sorted(paths), rules


def shut_out(path: str, rules: dict[str, list[str]], is_folder: bool = False) -> bool:
    """Whether a path is ignored by a rule or, where no rule has an opinion, lies in an excluded folder."""
    said = ignored(path + "/x" if is_folder else path, rules)
    return any(part in EXCLUDED_FOLDERS for part in path.split("/")) if said is None else said


def scan_files(spark: SparkSession, root: str, scope: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """relative_path, verdict (included, ignored, binary or unsupported), language and content of every file of a repository."""
    paths, rules = walk(spark, root)
    fs, base = _file_system(spark, root)
    ship_package(spark)
    listed = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    docs = scope or read_docs_scope(read_text(spark, f"{base}/.docs.json"))
    rest = F.substring("path", len(base) + 2, 1 << 20)
    plain = [p for p in paths if not any(part.startswith((".", "_")) for part in p.split("/"))]
    hidden = [p for p in paths if p not in set(plain)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base) if plain else spark.createDataFrame([], "path string, content binary")
    # Spark's listing leaves out hidden files; named one by one they are read
    files = files.select("path", "content")
    if hidden:
        files = files.unionByName(spark.read.format("binaryFile").load([f"{base}/{p}" for p in hidden]).select("path", "content"))
    content = files.select(rest.alias("relative_path"), "content").dropDuplicates(["relative_path"])

    @F.pandas_udf("boolean")
    def out_of_reach(p):
        return p.map(lambda x: shut_out(x, rules))

    @F.pandas_udf("boolean")
    def documented(p):
        return p.map(lambda x: in_docs_scope(x, docs))

    @F.pandas_udf("boolean")
    def binary(c):
        return c.map(lambda x: x is not None and is_binary(bytes(x[:4096])))

    head = F.decode(F.substring("content", 1, 8192), "UTF-8")
    shebang = F.when(head.rlike(r"(?i)^#!/[^\n]*python"), "Python").when(head.rlike(r"(?i)^#!/[^\n]*node"), "JavaScript")
    found = listed.join(content, "relative_path", "left").withColumn("language", F.coalesce(language_of(F.col("relative_path")), shebang))
    in_scope = (F.col("language") != "Markdown") | documented("relative_path")
    verdict = F.when(out_of_reach("relative_path"), "ignored").when(binary("content"), "binary").when(F.coalesce(in_scope, F.lit(False)), "included").otherwise("unsupported")
    return found.select("relative_path", verdict.alias("verdict"), "language", "content")


def scan_repository(spark: SparkSession, root: str, scope: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """relative_path, language, content of the files that belong to the repository's code and documents, by path."""
    return scan_files(spark, root, scope).where("verdict = 'included'").select("relative_path", "language", "content").orderBy("relative_path")


def scan_summary(scanned: DataFrame) -> DataFrame:
    """The five counters of a scan, one row."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return scanned.agg(F.count("*").alias("total_candidates"), n("included").alias("included_files"), n("ignored").alias("ignored_files"), n("binary").alias("binary_files"), n("unsupported").alias("unsupported_files"))


def scan_json(root: str, scanned: DataFrame) -> str:
    """The scan as JSON with sorted keys. The list of files is what a user reads, so it comes to the driver."""
    files = [r.asDict() for r in scanned.where("verdict = 'included'").select("relative_path", "language").orderBy("relative_path").collect()]
    return json.dumps({"root": root, "files": files, "summary": scan_summary(scanned).first().asDict()}, sort_keys=True, indent=2)
