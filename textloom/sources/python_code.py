"""Reader of Python sources: definitions, calls, imports and tables they name."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import referenced_tables

NODE = """path string, node_id string, display string, simple_name string, kind string, container string, package string, supers array<string>, arity_min int, arity_max int,
start_byte long, end_byte long, start_line int, hash string, calls array<struct<name: string, recv: string, args: int>>, imports array<string>, tables array<string>, literals array<string>, partial boolean"""
_ARROW = pa.schema([
    ("path", pa.string()), ("node_id", pa.string()), ("display", pa.string()), ("simple_name", pa.string()), ("kind", pa.string()), ("container", pa.string()), ("package", pa.string()),
    ("supers", pa.list_(pa.string())), ("arity_min", pa.int32()), ("arity_max", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int32()), ("hash", pa.string()),
    ("calls", pa.list_(pa.struct([("name", pa.string()), ("recv", pa.string()), ("args", pa.int32())]))), ("imports", pa.list_(pa.string())), ("tables", pa.list_(pa.string())), ("literals", pa.list_(pa.string())), ("partial", pa.bool_()),
])
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_name(path: str) -> str:
    """F16: the module of a path; a package's own file is the package."""
    return path.removesuffix(".py").removesuffix("/__init__").removeprefix("./").replace("/", ".")


def _statements(data: bytes) -> tuple[list[ast.stmt], bool]:
    """A file's statements and whether some are lost: if it doesn't parse as a whole, its top-level blocks one by one."""
    try:
        return ast.parse(data).body, False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    lines, out, partial = data.split(b"\n"), [], False
    starts = [i for i, x in enumerate(lines) if re.match(rb"[^\s#)\]}]", x)]
    starts = [i for i in starts if not (i and i - 1 in starts and lines[i - 1].startswith(b"@"))]
    for a, b in zip(starts, starts[1:] + [len(lines)]):
        try:
            body = ast.parse(b"\n".join(lines[a:b])).body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            partial = True
            continue
        for s in body:
            ast.increment_lineno(s, a)
        out += body
    return out, partial or not out


class _Reader:
    def __init__(self, path: str, data: bytes):
        self.path, self.data, self.package = path, data, module_name(path)
        self.lines = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", data))]
        self.seen: Counter = Counter()
        self.nodes: list[dict] = []
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body, self.partial = _statements(data)
        self.imports = [name for s in body for name in self.imported(s)]
        self.visit(body, "")

    def span(self, n) -> tuple[int, int]:
        return self.lines[n.lineno - 1] + n.col_offset, self.lines[n.end_lineno - 1] + n.end_col_offset

    def text(self, n) -> str:
        a, b = self.span(n)
        return self.data[a:b].decode("utf-8", "replace")

    def imported(self, s) -> list[str]:
        if isinstance(s, ast.Import):
            return [f"{a.name} as {a.asname}" if a.asname else a.name for a in s.names]
        if not isinstance(s, ast.ImportFrom) or s.module == "__future__":
            return []
        module = "." * s.level + (s.module or "")
        return [f"{module}.{a.name}" for a in s.names if not a.asname and a.name not in ("*", module)] or [module]

    def visit(self, body, container: str):
        for s in body:
            if isinstance(s, (*_FUNCTION, ast.ClassDef)):
                self.define(s, container)

    def define(self, s, container: str):
        inside = f"{container}.{s.name}" if container else s.name
        self.seen[container, s.name] += 1
        again = self.seen[container, s.name]
        start, end = self.span(s)
        node = {
            "path": self.path, "node_id": ".".join(filter(None, (self.package, container, s.name))) + (f"#{again}" if again > 1 else ""), "display": f"{container.rpartition('.')[2]}.{s.name}" if container else s.name, "simple_name": s.name, "container": container, "package": self.package,
            "supers": [], "arity_min": 0, "arity_max": 0, "start_byte": start, "end_byte": end, "start_line": s.lineno, "hash": hashlib.sha256(self.data[start:end]).hexdigest(),
            "calls": [], "imports": self.imports, "tables": [], "literals": [], "partial": self.partial,
        }
        if isinstance(s, ast.ClassDef):
            node |= {"kind": "class", "supers": [self.text(b) for b in s.bases if isinstance(b, (ast.Name, ast.Attribute))], "tables": tables(s.body)}
        else:
            low, high = arity(s.args, bool(container))
            node |= {"kind": "method" if container else "function", "arity_min": low, "arity_max": high}
            self.uses(s.body, node["calls"], node["literals"])
        self.nodes.append(node)
        self.visit(s.body, inside)

    def uses(self, body, calls, literals):
        """Calls and literals below statements, in order; literals are not entered."""
        todo = list(reversed(body))
        while todo:
            n = todo.pop()
            if isinstance(n, ast.JoinedStr) or (isinstance(n, ast.Constant) and isinstance(n.value, str)):
                literals.append(self.text(n))
                continue
            if isinstance(n, ast.Call):
                args = len(n.args) + len(n.keywords)
                if isinstance(n.func, ast.Name):
                    calls.append({"name": n.func.id, "recv": "", "args": args})
                elif isinstance(n.func, ast.Attribute):
                    calls.append({"name": n.func.attr, "recv": self.text(n.func.value), "args": args})
            todo.extend(reversed(list(ast.iter_child_nodes(n))))


def arity(a: ast.arguments, method: bool) -> tuple[int, int]:
    """least and greatest number of arguments, without a first self or cls; -1: no greatest.

    Annotated ``*args`` and ``**kwargs`` count as one required argument each.
    """
    plain = a.posonlyargs + a.args
    optional = len(a.defaults) + sum(d is not None for d in a.kw_defaults)
    required = len(plain) + len(a.kwonlyargs) - optional
    if method and plain and plain[0].arg in ("self", "cls") and plain[0].annotation is None and len(a.defaults) < len(plain):
        required -= 1
    rest = [x for x in (a.vararg, a.kwarg) if x]
    required += sum(x.annotation is not None for x in rest)
    return required, -1 if any(x.annotation is None for x in rest) else required + optional


def tables(body) -> list[str]:
    """Tables that a class names: ``__tablename__``, or ``db_table`` of its Meta."""

    def assigned(s, name):
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
        if isinstance(target, ast.Name) and target.id == name and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            yield s.value.value

    found = []
    for s in body:
        found += assigned(s, "__tablename__")
        if isinstance(s, ast.ClassDef) and s.name == "Meta":
            found += [x for m in s.body for x in assigned(m, "db_table")]
    return list(dict.fromkeys(filter(None, found)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = _Reader(path, content.encode()).nodes
            if nodes:
                yield pa.RecordBatch.from_pylist(nodes, schema=_ARROW)


def python_nodes(files: DataFrame) -> DataFrame:
    """The classes, methods and functions of (path, content); nested ones belong to their scope, repeated names get #2, #3.

    ``db_refs`` are explicit tables of a class and tables in a function's SQL literals.  A file that doesn't
    parse gives the definitions of its top-level blocks that do, marked ``partial``.  Null paths and contents
    give nothing; a file's nodes are built in one task.
    """
    some = files.filter("path is not null and content is not null").select("path", "content")
    nodes = some.mapInArrow(_read, NODE)
    names = F.array_distinct(F.flatten(F.transform("literals", referenced_tables)))
    ref = lambda xs, source: F.transform(xs, lambda n: F.struct(n.alias("name"), F.lit(source).alias("source")))
    return nodes.withColumn("db_refs", F.concat(ref(F.col("tables"), "explicit"), ref(names, "sql"))).drop("tables", "literals")
