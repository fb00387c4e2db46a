"""Symbols, calls and base types of source files, one file per row, and the graph built from them.

Python files are parsed with the standard library. Rust, Go, JavaScript and TypeScript files are cut into tokens (strings
and comments fall away) and read item by item with balanced brackets; that covers the items listed for each reader and
nothing else. Known gaps: calls within template strings and JSX, generic calls written with type arguments, and files
that do not parse, which keep their file node only.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .tables import ensure_importable, ordinals, stored

# File extensions by language, and folders that are never entered.
LANGUAGES = {"rs": "rust", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "go": "go", "py": "python"}
SKIPPED_FOLDERS = ("target", "node_modules", "dist", "build", "__pycache__", "vendor")

_TOKEN = {
    "rust": re.compile(r"""//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\])'|'\w+|(?P<w>[A-Za-z_]\w*)|\d[\w.]*|::|->|=>|(?P<p>\S)""", re.S),
    "go": re.compile(r"""//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|(?P<w>[A-Za-z_]\w*)|\d[\w.]*|(?P<p>\S)""", re.S),
    "script": re.compile(r"""//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|(?<=[=(,:;!&|?{}\[])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+/\w*|(?P<w>[A-Za-z_$][\w$]*)|\d[\w.]*|=>|\?\.|(?P<p>\S)""", re.S),
}
_NO_CALL = {
    "rust": frozenset("if while match for return loop in as fn let move unsafe else impl dyn where mut ref".split()),
    "go": frozenset("if for switch return func range select case go defer else map chan var type".split()),
    "script": frozenset("if for while switch catch return function new typeof await super import do else with in of void delete yield throw case".split()),
}
_CLOSES = {"(": ")", "[": "]", "{": "}"}

Row = tuple[str, str, str]


class Tokens:
    """Tokens with their places, and the end of each bracket group."""

    def __init__(self, source: str, language: str) -> None:
        self.source, self.language = source, language
        self.text: list[str] = []
        self.at: list[int] = []
        for m in _TOKEN[language].finditer(source):
            t = m[0]
            if t.startswith(("//", "/*")):
                continue
            plain = m["w"] or m["p"] or (t if t in ("::", "->", "=>", "?.") else None)
            self.text.append(plain or '""')  # a literal keeps its place, not its text
            self.at.append(m.start())
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.text):
            if t in _CLOSES:
                open_.append(i)
            elif t in ")]}" and open_ and _CLOSES[self.text[open_[-1]]] == t:
                self.close[open_.pop()] = i

    def __len__(self) -> int:
        return len(self.text)

    def get(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def after(self, i: int) -> int:
        """Behind the bracket group at i, or behind i."""
        return self.close.get(i, i) + 1

    def until(self, i: int, stops: str) -> int:
        """The next token among ``stops`` outside of bracket groups that are no stop themselves."""
        while i < len(self) and self.text[i] not in stops:
            i = self.after(i)
        return i

    def slice(self, a: int, b: int) -> str:
        """The source from token a to before token b, trimmed."""
        end = self.at[b] if b < len(self) else len(self.source)
        return self.source[self.at[a] : end].strip() if a < b else ""

    def calls(self, a: int, b: int) -> Iterator[str]:
        """Short names of what is called between two tokens."""
        i, skip = a, _NO_CALL[self.language]
        while i < b:
            t = self.text[i]
            if self.language == "rust" and t == "!" and re.match(r"\w", self.get(i - 1)) and self.get(i + 1) in _CLOSES:
                i = self.after(i + 1)  # what a macro is given is no code yet
                continue
            if re.match(r"[A-Za-z_$]", t) and self.get(i + 1) == "(" and t not in skip:
                before = self.get(i - 1)
                defines = self.language == "script" and before in ("{", ",", "}", ";") and self.get(self.close.get(i + 1, i) + 1) == "{" and before not in (";", "}")
                if before not in ("fn", "func", "function", "new", "*") and not defines:
                    yield t
            i += 1


def _function(out: list[Row], tokens: Tokens, rel: str, id_: str, name: str, body: int | None) -> None:
    out.append(("node", id_, f"Function\t{name}"))
    out.append(("contains", rel, id_))
    if body is not None:
        out.extend(("call", id_, c) for c in tokens.calls(body + 1, tokens.close.get(body, len(tokens))))


def _item(out: list[Row], rel: str, kind: str, name: str) -> str:
    id_ = f"{rel}::{name}"
    out.append(("node", id_, f"{kind}\t{name}"))
    out.append(("contains", rel, id_))
    return id_


def read_rust(out: list[Row], t: Tokens, rel: str, a: int, b: int, owner: str | None = None) -> None:
    """Functions with a body, structs, enums, traits (without their methods) and impl blocks with theirs."""
    i = a
    while i < b:
        word = t.get(i)
        if word == "#":
            i = t.after(i + 1 + (t.get(i + 1) == "!"))
        elif word == "pub":
            i = t.after(i + 1) if t.get(i + 1) == "(" else i + 1
        elif word in ("async", "unsafe", "default") or word == "const" and t.get(i + 1) in ("fn", "unsafe", "async", "extern") or word == "extern" and t.get(i + 1) == '""' and t.get(i + 2) == "fn":
            i += 1 + (word == "extern")
        elif word == "fn":
            name, end = t.get(i + 1), t.until(i + 2, "{;")
            if t.get(end) == "{":
                _function(out, t, rel, f"{rel}::{owner}::{name}" if owner else f"{rel}::{name}", name, end)
            i = t.after(end)
        elif word in ("struct", "enum", "trait"):
            _item(out, rel, word.capitalize(), t.get(i + 1))
            i = t.after(t.until(i + 2, "{;"))
        elif word == "impl":
            i = _read_impl(out, t, rel, i)
        else:  # not read: everything up to the item's end
            end = t.until(i, "{;")
            i = t.after(end)
            if word in ("const", "static", "let", "type", "use") and t.get(end) == "{":
                i = t.until(i, ";") + 1
    return None


def _read_impl(out: list[Row], t: Tokens, rel: str, i: int) -> int:
    body = t.until(i + 1, "{;")
    start, depth, split, stop = i + 1, 0, None, body
    if t.get(start) == "<":
        while start < body:
            depth += {"<": 1, ">": -1}.get(t.get(start), 0)
            start += 1
            if not depth:
                break
    depth = 0
    for j in range(start, body):
        word = t.get(j)
        depth += {"<": 1, ">": -1}.get(word, 0)
        if not depth and word == "for" and split is None:
            split = j
        if not depth and word == "where":
            stop = j
            break
    type_ = t.slice(start if split is None else split + 1, stop)
    if split is not None:
        out.append(("impl", f"{rel}::{type_}", t.slice(start, split)))
    if t.get(body) == "{":
        read_rust(out, t, rel, body + 1, t.close.get(body, len(t)), type_)
    return t.after(body)


def read_go(out: list[Row], t: Tokens, rel: str) -> None:
    """Struct and interface types, functions, methods by their receiver's type."""
    i = 0
    while i < len(t):
        word = t.get(i)
        if word == "type":
            group = t.get(i + 1) == "("
            j, end = (i + 2, t.close.get(i + 1, len(t))) if group else (i + 1, len(t))
            while j < end:
                name, k = t.get(j), j + 1
                if t.get(k) == "[":
                    k = t.after(k)
                if (kind := {"struct": "Struct", "interface": "Trait"}.get(t.get(k))) and re.match(r"\w", name):
                    _item(out, rel, kind, name)
                    j = t.after(k + 1)
                elif group:
                    j += 1
                    continue
                if not group:
                    j = max(j, k)
                    break
            i = end + 1 if group else j
        elif word == "func":
            j, owner = i + 1, None
            if t.get(j) == "(":
                inside = t.text[j + 1 : t.close.get(j, j + 1)]
                names = [x for x in inside if re.match(r"[A-Za-z_]", x)]
                pointer = "*" in inside
                owner = None if pointer and "[" in inside else (names[1] if len(names) > 1 else names[0] if names else None)
                j = t.after(j)
            name = t.get(j)
            if not re.match(r"[A-Za-z_]", name):
                i = j + 1
                continue
            end = j + 1
            while end < len(t) and not (t.get(end) == "{" and t.get(end - 1) not in ("struct", "interface")) and t.get(end) not in ("func", "type", "var", "const", "import"):
                end = t.after(end)
            _function(out, t, rel, f"{rel}::{owner}::{name}" if owner else f"{rel}::{name}", name, end if t.get(end) == "{" else None)
            i = t.after(end) if t.get(end) == "{" else end
        else:
            i = t.after(i)


def read_script(out: list[Row], t: Tokens, rel: str, typed: bool) -> None:
    """Functions, classes with methods and bases, interfaces; only at the top of a file and not exported."""
    i = 0
    while i < len(t):
        word = t.get(i)
        if word in ("export", "abstract", "@"):
            end = t.until(i + 1, "{;")
            i = t.after(end)
        elif word == "function" and t.get(i + 1) != "*" and t.get(i + 2) in ("(", "<"):
            end = t.until(i + 2, "{;")
            _function(out, t, rel, f"{rel}::{t.get(i + 1)}", t.get(i + 1), end if t.get(end) == "{" else None)
            i = t.after(end)
        elif word == "class" and re.match(r"[A-Za-z_$]", t.get(i + 1)) and t.get(i - 1) not in ("=", "(", ",", "return"):
            i = _read_class(out, t, rel, i, typed)
        elif word == "interface" and re.match(r"[A-Za-z_$]", t.get(i + 1)):
            _item(out, rel, "Trait", t.get(i + 1))
            i = t.after(t.until(i + 2, "{;"))
        else:
            i = t.after(i)


def _read_class(out: list[Row], t: Tokens, rel: str, i: int, typed: bool) -> int:
    id_ = _item(out, rel, "Struct", t.get(i + 1))
    body = t.until(i + 2, "{;")
    clause, parts, start = None, [], None
    depth = 0
    for j in range(i + 2, body + 1):
        word = t.get(j)
        depth += {"<": 1, ">": -1}.get(word, 0)
        if not depth and (word in ("extends", "implements", ",") or j == body):
            if clause and start is not None:
                parts.append((clause, [x for x in t.text[start:j]]))
            clause = word if word in ("extends", "implements") else clause
            start = j + 1
    for clause, words in parts:
        plain = words[: words.index("<")] if "<" in words else words
        if clause == "extends" and plain and (typed or len(plain) == 1):
            out.append(("impl", id_, "".join(plain)))
        elif clause == "implements" and len(words) == 1:
            out.append(("impl", id_, words[0]))
    end = t.close.get(body, len(t))
    j = body + 1
    while j < end:
        word = t.get(j)
        if re.match(r"[A-Za-z_$#]", word) and t.get(j + 1) == "(":
            after = t.after(j + 1)
            at = t.until(after, "{;=")
            if t.get(at) == "{" and at < end:
                _function(out, t, rel, f"{id_}::{word}", word, at)
                j = t.after(at)
                continue
        if word == "=":
            j = min(t.until(j, ";"), end) + 1
            continue
        j = t.after(j)
    return t.after(body)


def _python_calls(node: ast.AST) -> Iterator[str]:
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name):
            yield node.func.id
        elif isinstance(node.func, ast.Attribute):
            yield node.func.attr
    for child in ast.iter_child_nodes(node):
        yield from _python_calls(child)


def read_python(out: list[Row], body: list[ast.stmt], rel: str, owner: str | None = None) -> None:
    """Undecorated functions and classes, with methods and bases that are plain names."""
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not node.decorator_list:
            id_ = f"{rel}::{owner}::{node.name}" if owner else f"{rel}::{node.name}"
            out.append(("node", id_, f"Function\t{node.name}"))
            out.append(("contains", rel, id_))
            out.extend(("call", id_, c) for statement in node.body for c in _python_calls(statement))
        elif isinstance(node, ast.ClassDef) and not node.decorator_list:
            id_ = _item(out, rel, "Struct", node.name)
            out.extend(("impl", id_, b.id) for b in node.bases if isinstance(b, ast.Name))
            read_python(out, node.body, rel, node.name)


def read_file(rel: str, source: str) -> list[Row]:
    """(what, a, b) in order: node (id, kind and name), contains (file, id), call (id, name), impl (id, name)."""
    language = LANGUAGES.get(rel.rsplit(".", 1)[-1]) if "." in rel.rsplit("/", 1)[-1] else None
    if language is None:
        return []
    out: list[Row] = [("node", rel, f"File\t{rel.rsplit('/', 1)[-1]}")]
    if language == "python":
        try:
            read_python(out, ast.parse(source).body, rel)
        except (SyntaxError, ValueError, RecursionError):
            pass
        return out
    t = Tokens(source, language)
    if language == "rust":
        read_rust(out, t, rel, 0, len(t))
    elif language == "go":
        read_go(out, t, rel)
    else:
        read_script(out, t, rel, rel.endswith((".ts", ".tsx")))
    return out


def extract(files: DataFrame) -> DataFrame:
    """(rel, seq, what, a, b) of ``files`` (rel, content); content null is skipped."""
    ensure_importable(files.sparkSession)

    def read(batches):
        for batch in batches:
            rows = [(rel, i, *row) for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if content is not None for i, row in enumerate(read_file(rel, content))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rel", "seq", "what", "a", "b"])

    return files.select("rel", "content").mapInArrow(read, "rel string, seq long, what string, a string, b string")


def _nodes(rows: DataFrame, base: int) -> DataFrame:
    """Nodes in order of insertion: files by the components of their path, then by place; an id keeps its first place."""
    order = ordinals(rows.select("rel").distinct(), [F.split("rel", "/")], "file")
    placed = rows.where("what = 'node'").join(order, "rel").withColumn("ord", F.lit(base) + F.col("file") * (1 << 32) + F.col("seq"))
    parts = F.split("b", "\t")
    return graph.upsert_nodes(placed.select(F.col("a").alias("id"), parts[0].alias("kind"), parts[1].alias("name"), "ord"), placed.limit(0).select(F.col("a").alias("id"), F.col("b").alias("kind"), F.col("b").alias("name"), "ord"))


def _edges(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    contains = rows.where("what = 'contains'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("Contains").alias("kind"))
    pending = lambda what: rows.where(F.col("what") == what).select(F.col("a").alias("src"), F.col("b").alias("name"))
    return contains.unionByName(graph.resolve_impls(nodes, pending("impl"))).unionByName(graph.resolve_calls(nodes, pending("call")))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files`` (rel, content)."""
    rows = stored(extract(files), "symbols")
    nodes = stored(_nodes(rows, 0), "nodes")
    return nodes, _edges(nodes, rows)


def manifest(files: DataFrame) -> DataFrame:
    """(rel, hash) of readable files."""
    from ..functions.hashing import content_hash

    return files.where("content is not null").select("rel", content_hash(F.col("content")).alias("hash"))


def update(nodes: DataFrame, edges: DataFrame, old: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, manifest) after ``files`` took the place of those in the manifest ``old``.

    Only changed and new files are read again. Their nodes go to the end, and only their own calls and bases are looked
    up: an edge from an unchanged file into a changed one is lost until the next build. ``code_index.update`` keeps them.
    """
    from ..functions.hashing import content_hash

    now = files.select("rel", content_hash(F.col("content")).alias("hash"))
    status = stored(graph.manifest_diff(now, old), "diff")
    changed, deleted = (status.where(F.col("status") == s).select("rel") for s in ("changed", "deleted"))
    kept, kept_edges = graph.remove_files(nodes, edges, changed.unionByName(deleted))
    kept = stored(kept, "nodes")
    base = (kept.agg(F.max("ord")).first()[0] or 0) + 1
    rows = stored(extract(files.join(changed, "rel", "left_semi")), "symbols")
    every = stored(kept.unionByName(_nodes(rows, base)), "nodes")
    left = old.join(changed.unionByName(deleted), "rel", "left_anti")
    return every, kept_edges.unionByName(_edges(every, rows)), left.unionByName(now.join(changed, "rel", "left_semi"))
