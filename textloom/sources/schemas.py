"""Readers of schemas written as DDL, Prisma models or JSON, and the manifest that routes files to them."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import definition_names, plain_nodes, snapshot_nodes

NODE = """path string, node_id string, display string, simple_name string, kind string, container string, package string, params array<string>, supers array<string>,
logical_refs array<string>, aliases array<string>, definition string, start_byte long, end_byte long, hash string, partial boolean"""
_LISTS = ("params", "supers", "logical_refs", "aliases")
_ARROW = pa.schema([(c, pa.list_(pa.string()) if c in _LISTS else pa.int64() if c.endswith("_byte") else pa.bool_() if c == "partial" else pa.string()) for c in re.findall(r"(\w+) (?:string|array|long|boolean)", NODE)])

#: Files are read as Latin-1, so places are bytes; names turn back to UTF-8.
_SQL = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:[^']|'')*(?:'|\Z)|\$(?P<tag>[A-Za-z0-9_]*)\$.*?(?:\$(?P=tag)\$|\Z))
    |(?P<quoted>"[^"]*(?:"|\Z)|`[^`]*(?:`|\Z))|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<mark>.)""",
    re.S | re.X | re.ASCII,
)
#: Words that stand between CREATE and what it creates, that open a constraint, and that end a column's type.
MODIFIERS = {"OR", "REPLACE", "TEMP", "TEMPORARY", "UNLOGGED", "GLOBAL", "LOCAL", "MATERIALIZED"}
CONSTRAINTS = {"PRIMARY", "UNIQUE", "CHECK", "EXCLUDE", "LIKE"}
AFTER_TYPE = {"NOT", "NULL", "DEFAULT", "PRIMARY", "REFERENCES", "UNIQUE", "CHECK", "CONSTRAINT", "GENERATED", "COLLATE"}


def _utf8(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


def _squeeze(text: str) -> str:
    return " ".join(_utf8(text).split())


class _Schema:
    """The nodes of one file of a datasource."""

    def __init__(self, path: str, data: bytes, datasource: str, schema: str):
        self.path, self.data, self.ds, self.schema = path, data, datasource, schema
        self.nodes: list[dict] = []
        self.partial = False

    def fqn(self, schema: str, name: str) -> str:
        return f"db.{self.ds}.{schema}.{name}"

    def add(self, kind: str, schema: str, name: str, span: tuple[int, int], inside: tuple[str, ...] = (), simple: str | None = None, **more) -> dict:
        names = (self.ds, schema, name, *inside)
        node = dict.fromkeys(_LISTS, ()) | {
            "path": self.path, "node_id": "db." + ".".join(names), "display": ".".join(names), "simple_name": simple or names[-1], "kind": kind, "container": f"{schema}.{name}" if inside else schema,
            "package": f"db.{self.ds}", "definition": None, "start_byte": span[0], "end_byte": span[1], "hash": hashlib.sha256(self.data[span[0] : span[1]]).hexdigest(),
        }
        self.nodes.append(node | more)
        return self.nodes[-1]


class _Tokens:
    """What is left of a statement: (kind, text, start, end), white space and comments gone."""

    def __init__(self, tokens: list[tuple]):
        self.rest = tokens[::-1]

    def word(self) -> str | None:
        """The next name, lower-cased unless quoted."""
        if self.rest and self.rest[-1][0] in ("word", "quoted"):
            kind, text, _, _ = self.rest.pop()
            return text.lower() if kind == "word" else _utf8(text.strip(text[0]))
        return None

    def peek(self) -> str:
        return self.rest[-1][1].upper() if self.rest and self.rest[-1][0] in ("word", "mark") else ""

    def accept(self, *words: str) -> bool:
        """Take these words if all of them stand next."""
        ahead = [t[1].upper() if t[0] in ("word", "mark") else "" for t in self.rest[-1 : -1 - len(words) : -1]]
        if ahead == list(words):
            del self.rest[-len(words) :]
            return True
        return False

    def name(self, schema: str) -> tuple[str, str] | None:
        """(schema, name) of a dotted name."""
        parts = [self.word()]
        while parts[-1] is not None and self.accept("."):
            parts.append(self.word())
        parts = [p for p in parts if p is not None]
        return ((parts[-2] if len(parts) > 1 else schema), parts[-1]) if parts else None

    def group(self) -> list[tuple] | None:
        """The tokens in the parentheses that open here; None if none do or they don't close."""
        if self.peek() != "(":
            return None
        depth = 0
        for n, t in enumerate(reversed(self.rest), 1):
            depth += (t[:2] == ("mark", "(")) - (t[:2] == ("mark", ")"))
            if not depth:
                inner = self.rest[-2:-n:-1]
                del self.rest[-n:]
                return inner
        return None

    def seek(self, *words: str) -> str | None:
        """Take all up to and with the first of these words."""
        while self.rest:
            t = self.rest.pop()
            if t[0] == "word" and t[1].upper() in words:
                return t[1].upper()
        return None


def statements(text: str) -> Iterator[tuple[int, int, list[tuple]]]:
    """(start, end, tokens) of each statement; semicolons in quotes, comments and dollar quotes end none."""
    tokens: list[tuple] = []
    for m in _SQL.finditer(text):
        if m.lastgroup == "skip" or m["skip"] is not None:
            continue
        kind = "text" if m["text"] is not None else m.lastgroup
        if kind == "mark" and m[0] == ";":
            if tokens:
                yield tokens[0][2], tokens[0][2] + len(text[tokens[0][2] : m.start()].rstrip()), tokens
            tokens = []
        else:
            tokens.append((kind, m[0], m.start(), m.end()))
    if tokens:
        yield tokens[0][2], len(text.rstrip()), tokens


def _entries(tokens: list[tuple]) -> Iterator[list[tuple]]:
    depth, entry = 0, []
    for t in tokens:
        depth += (t[:2] == ("mark", "(")) - (t[:2] == ("mark", ")"))
        if t[:2] == ("mark", ",") and not depth:
            yield entry
            entry = []
        else:
            entry.append(t)
    yield entry


class _Ddl(_Schema):
    """State-style DDL; later foreign keys of ALTER TABLE belong to their table and its hash."""

    def read(self) -> None:
        self.text = self.data.decode("latin-1")
        self.tables: dict[str, dict] = {}
        for start, end, tokens in statements(self.text):
            t = _Tokens(tokens)
            if t.accept("CREATE"):
                while t.peek() in MODIFIERS:
                    t.rest.pop()
                build = {"TABLE": self.table, "VIEW": self.view, "FUNCTION": self.routine, "PROCEDURE": self.routine, "TRIGGER": self.trigger, "POLICY": self.policy}.get(t.peek())
                if build and not build(t, (start, end), t.word()):
                    self.partial = True
            elif t.accept("ALTER", "TABLE"):
                self.alter(t, self.data[start:end])
        for table in self.tables.values():
            if table.get("altered"):
                table["hash"] = hashlib.sha256(self.data[table["start_byte"] : table["end_byte"]] + b"".join(table["altered"])).hexdigest()

    def named(self, t: _Tokens) -> tuple[str, str] | None:
        t.accept("IF", "NOT", "EXISTS")
        return t.name(self.schema)

    def referred(self, t: _Tokens) -> list[str]:
        found = t.name(self.schema)
        return [self.fqn(*found)] if found else []

    def table(self, t: _Tokens, span, _) -> bool:
        name = self.named(t)
        body = t.group() if name else None
        if body is None:
            return False
        columns, keys = [], []
        for entry in _entries(body):
            self.entry(_Tokens(entry), columns, keys)
        node = self.add("table", *name, span, params=columns, supers=keys)
        self.tables[node["node_id"]] = node
        return True

    def entry(self, t: _Tokens, columns: list[str], keys: list[str]) -> None:
        """One entry of a table: a column with its type and what it refers to, or a constraint."""
        if t.accept("CONSTRAINT"):
            t.word()
            if t.peek() != "FOREIGN":
                return
        if t.peek() in CONSTRAINTS:
            return
        if t.accept("FOREIGN"):
            t.accept("KEY")
            t.group()
            if t.accept("REFERENCES"):
                keys.extend(self.referred(t))
            return
        name = t.word()
        if name is None:
            return
        start = end = None
        while t.rest:
            kind, text, a, b = t.rest[-1]
            if kind in ("word", "quoted") and not (kind == "word" and text.upper() in AFTER_TYPE):
                start = a if start is None else start
                end = b
                t.rest.pop()
            elif start is not None and text == "(" and (inner := t.group()) is not None:
                end = self.text.index(")", inner[-1][3] if inner else b) + 1
            elif start is not None and text in ("[", "]") and kind == "mark":
                end = b
                t.rest.pop()
            else:
                break
        columns.append(f"{name} {_squeeze(self.text[start:end]) if start is not None else ''}".strip())
        if t.seek("REFERENCES"):
            keys.extend(self.referred(t))

    def view(self, t: _Tokens, span, _) -> bool:
        name = self.named(t)
        return bool(name and self.add("view", *name, span, definition=_utf8(self.text[slice(*span)])))

    def routine(self, t: _Tokens, span, kind: str) -> bool:
        name = self.named(t)
        if not name:
            return False
        args = t.group()
        params = [_squeeze(self.text[args[0][2] : args[-1][3]])] if args else []
        self.add("procedure" if kind == "procedure" else "db_function", *name, span, params=params, definition=_utf8(self.text[slice(*span)]))
        return True

    def trigger(self, t: _Tokens, span, _) -> bool:
        name, over, runs = t.word(), None, []
        while found := t.seek("ON", "EXECUTE"):
            if found == "ON":
                over = over or t.name(self.schema)
            elif t.accept("FUNCTION") or t.accept("PROCEDURE"):
                runs = self.referred(t)
        return bool(name and over and self.add("trigger", *over, span, (name,), supers=[self.fqn(*over), *runs]))

    def policy(self, t: _Tokens, span, _) -> bool:
        name = t.word()
        over = t.name(self.schema) if name and t.accept("ON") else None
        if not over:
            return False
        command = t.word() if t.seek("FOR") else None
        self.add("rls_policy", *over, span, ("rls", name), over[1], supers=[self.fqn(*over)], params=[f"{name} {command.upper()}" if command else name])
        return True

    def alter(self, t: _Tokens, statement: bytes) -> None:
        while t.peek() in ("IF", "EXISTS", "ONLY"):
            t.rest.pop()
        name = t.name(self.schema)
        table = self.tables.get(self.fqn(*name)) if name else None
        while table is not None and t.seek("REFERENCES"):
            if more := self.referred(t):
                table["supers"] = [*table["supers"], *more]
                table.setdefault("altered", []).append(statement)


_PRISMA = re.compile(r'//[^\n]*|"[^"]*(?:"|\Z)|[{}]|(?<!\w)(model|view|enum|datasource|generator|type)[ \t]+([A-Za-z_]\w*)[ \t]*(?=\{)', re.ASCII)


class _Prisma(_Schema):
    """Models and views; a relation with ``fields:`` is a foreign key, the model's name an alias of its table."""

    def blocks(self, text: str):
        depth, head = 0, None
        for m in _PRISMA.finditer(text):
            if m[1] and not depth:
                head = m
            elif m[0] == "{":
                depth += 1
            elif m[0] == "}" and depth:
                depth -= 1
                if not depth and head:
                    yield head[1], head[2], text[head.end() + 1 : m.start()], (head.start(), m.end())
                    head = None
        if depth and head:
            yield head[1], head[2], text[head.end() + 1 :], (head.start(), len(text))

    def read(self) -> None:
        attr = lambda s, name: m[1] if (m := re.search(rf'{name}\([^"]*"([^"]*)"', s)) else ""
        blocks = [b for b in self.blocks(self.data.decode("latin-1")) if b[0] in ("model", "view")]
        place = {name: (attr(body, "@@schema") or self.schema, _utf8(attr(body, "@@map")) or name) for _, name, body, _ in blocks}
        for kind, model, body, span in blocks:
            schema, table = place[model]
            columns, keys = [], []
            for line in map(str.strip, _utf8(body).split("\n")):
                words = line.split()
                if len(words) < 2 or line.startswith("@@") or not re.match("[A-Za-z_]", line):
                    continue
                rest = " ".join(words[2:])
                to = place.get(words[1].removesuffix("?").removesuffix("[]"))
                if to is None:
                    columns.append(f"{attr(rest, '@map') or words[0]} {words[1]}")
                elif "@relation" in rest and "fields:" in rest:
                    keys.append(self.fqn(*to))
            lower = model[:1].lower() + model[1:]
            aliases = [a for a in dict.fromkeys((model, lower)) if a != table]
            self.add("table" if kind == "model" else "view", schema, table, span, params=columns, supers=keys, aliases=aliases)


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def value_places(data: bytes) -> dict[str, tuple[int, int]]:
    """The bytes of each value of a JSON text, by its path (a/b/#0); raises ValueError for other texts."""
    json.loads(data)
    places, stack = {}, []  # a frame: path, start, is a list, key or index
    for m in _JSON.finditer(data.decode("latin-1")):
        token, top = m[0], stack[-1] if stack else None
        if token == ",":
            top[3] = top[3] + 1 if top[2] else None
        elif token in ("}", "]"):
            places[top[0]] = (top[1], m.end())
            stack.pop()
        elif token != ":":
            if top and not top[2] and top[3] is None:
                top[3] = json.loads(token.encode("latin-1"))
                continue
            path = "" if top is None else "/".join(filter(None, (top[0], f"#{top[3]}" if top[2] else top[3])))
            if token in ("{", "["):
                stack.append([path, m.start(), token == "[", 0 if token == "[" else None])
            else:
                places[path] = m.span()
    return places


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def _dicts(x) -> list[tuple[int, dict]]:
    return [(i, v) for i, v in enumerate(x) if isinstance(v, dict)] if isinstance(x, list) else []


class _Tbls(_Schema):
    """A dump of tables, relations and functions; virtual relations are logical references."""

    def split(self, name: str) -> tuple[str, str]:
        schema, dot, simple = name.partition(".")
        return (schema, simple) if schema and dot else (self.schema, name)

    def read(self) -> None:
        doc, places = json.loads(self.data), value_places(self.data)
        if not isinstance(doc, dict) or not _dicts(doc.get("tables")):
            return
        relations: dict[str, list[dict]] = {}
        for _, r in _dicts(doc.get("relations")):
            relations.setdefault(_text(r.get("table")), []).append(r)
        for i, t in _dicts(doc["tables"]):
            schema, simple = self.split(_text(t.get("name")))
            to = lambda xs, c: [self.fqn(*self.split(_text(x.get(c)))) for x in xs]
            if "VIEW" in _text(t.get("type")).upper():
                self.add("view", schema, simple, places[f"tables/#{i}"], definition=_text(t.get("def")))
                continue
            found = relations.get(_text(t.get("name"))) or relations.get(simple) or []
            stated = [c for _, c in _dicts(t.get("constraints")) if _text(c.get("type")).upper() == "FOREIGN KEY" and c.get("referenced_table")]
            real = to([r for r in found if not r.get("virtual")], "parent_table") if found else to(stated, "referenced_table")
            columns = [f"{_text(c.get('name'))} {_text(c.get('type'))}".strip() for _, c in _dicts(t.get("columns"))]
            node = self.add("table", schema, simple, places[f"tables/#{i}"], params=columns, supers=real, logical_refs=to([r for r in found if r.get("virtual")], "parent_table"))
            for j, g in _dicts(t.get("triggers")):
                if name := _text(g.get("name")):
                    runs = re.search(r"(?i)execute (?:function|procedure) ([^(]*\S)\s*\(", _text(g.get("def")))
                    self.add("trigger", schema, simple, places[f"tables/#{i}/triggers/#{j}"], (name,), supers=[node["node_id"], *([self.fqn(*self.split(runs[1].strip()))] if runs else [])])
        for i, f in _dicts(doc.get("functions")):
            kind = "procedure" if "PROCEDURE" in _text(f.get("type")).upper() else "db_function"
            self.add(kind, *self.split(_text(f.get("name"))), places[f"functions/#{i}"], params=[a] if (a := _text(f.get("arguments"))) else [])


def select(value, steps: list[str], path: str = "", names: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(value, path, names) that a selector such as ``schemas.*.tables[]`` finds; names are what * stood for."""
    if not steps:
        yield value, path, names
        return
    key, rest = steps[0], steps[1:]
    join = lambda *xs: "/".join(filter(None, (path, *xs)))
    if not isinstance(value, dict):
        return
    if key.removesuffix("[]") == "*":
        for k in sorted(value):
            yield from select(value[k], rest, join(k), (*names, k))
    elif not key.endswith("[]"):
        if key in value:
            yield from select(value[key], rest, join(key), names)
    elif isinstance(items := value.get(key[:-2]), list):
        for i, v in enumerate(items):
            yield from select(v, rest, join(key[:-2], f"#{i}"), names)


def leaf(value, rule: str, names: tuple[str, ...] = ()):
    """What ``key``, ``field:a.b`` or ``const:x`` gives for a found value; None for nothing."""
    kind, _, arg = rule.partition(":")
    if rule in ("", "key"):
        return names[-1] if names else None
    if kind == "const":
        return arg
    for step in arg.split(".") if kind == "field" else [""]:
        value = value.get(step) if isinstance(value, dict) else None
    return value


class _Mapped(_Schema):
    """Tables that the selectors of a mapping find in any JSON document."""

    def __init__(self, *args, mapping: dict):
        super().__init__(*args)
        self.mapping = mapping

    def ref(self, text) -> str | None:
        """The table a reference means: [db.datasource.]schema.name, whatever column follows."""
        parts = _text(text).strip().split(".")
        if parts[0] == "db":
            return ".".join(parts[:4]) if len(parts) >= 4 else None
        return self.fqn(*parts[:2]) if len(parts) >= 2 and parts[0] else None

    def read(self) -> None:
        rule = lambda name, default="": self.mapping.get(name) or default
        doc, places = json.loads(self.data), value_places(self.data)
        inside = lambda value, path, sel: select(value, sel.split("."), path) if sel else ()
        by_name = rule("column_name", "field:name" if rule("columns").endswith("[]") else "key")
        for value, path, names in inside(doc, "", rule("tables")):
            schema, dot, name = _text(leaf(value, rule("table_name"), names)).rpartition(".")
            if not schema:
                schema, name = names[-2] if len(names) >= 2 else self.schema, dot + name
            if not name:
                continue
            pairs = ((_text(leaf(v, by_name, ns)), _text(leaf(v, rule("column_type", "field:type"), ns))) for v, _, ns in inside(value, path, rule("columns")))
            keys, loose = [], []
            for v, _, ns in inside(value, path, rule("foreign_keys")):
                enforced = leaf(v, rule("fk_enforced"), ns) if rule("fk_enforced") else True
                if to := self.ref(leaf(v, rule("fk_references", "field:references"), ns)):
                    (loose if enforced is False else keys).append(to)
            self.add("table", schema, name, places[path], params=[f"{n} {t}".strip() for n, t in pairs if n], supers=keys, logical_refs=loose)


def routes(manifest: str) -> tuple[list[dict], list[str]]:
    """(routes, errors) of a manifest; of two datasources, by name, that claim a path the first keeps it.

    A manifest is ``{"datasources": {name: {engine, default_schema, sources: [{path, format}], json: {preset | mapping}}}}``;
    errors leave the rest standing.
    """
    try:
        sources = json.loads(manifest).get("datasources")
    except (ValueError, AttributeError) as error:
        return [], [f"manifest: {error}"]
    if not isinstance(sources, dict) or not sources:
        return [], ["manifest: no datasources"]
    found: dict[str, dict] = {}
    errors = []
    for name in sorted(sources):
        config = sources[name] if isinstance(sources[name], dict) else {}
        rules = config.get("json") if isinstance(config.get("json"), dict) else {}
        default = "public" if _text(config.get("engine")).lower() in ("postgresql", "postgres") else "main"
        if not _dicts(config.get("sources")):
            errors.append(f"{name}: no sources")
        for _, s in _dicts(config.get("sources")):
            path = posixpath.normpath(_text(s.get("path")))
            kind = s.get("format") or next((k for end, k in ((".schema.json", "snapshot"), (".sql", "sql"), (".prisma", "prisma"), (".json", "json")) if path.endswith(end)), "")
            kind = "prisma" if kind == "schema" else kind
            if path == "." or path.startswith(".."):
                errors.append(f"{name}: bad path {s.get('path')!r}")
            elif kind not in ("snapshot", "sql", "prisma", "json"):
                errors.append(f"{name}: unknown format {kind!r} of {path}")
            elif kind == "json" and not (rules.get("preset") == "tbls" or (rules.get("mapping") and not rules.get("preset"))):
                errors.append(f"{name}: {path} needs the preset tbls or a mapping")
            elif path in found:
                errors.append(f"{name}: {path} belongs to {found[path]['datasource']}")
            else:
                found[path] = {"path": path, "datasource": name, "default_schema": config.get("default_schema") or default, "format": kind, "rules": json.dumps(rules)}
    return list(found.values()), errors


def reader(kind: str, rules: dict):
    """The reader of a format."""
    if kind != "json":
        return {"sql": _Ddl, "prisma": _Prisma}.get(kind)
    return _Tbls if rules.get("preset") == "tbls" else partial(_Mapped, mapping=rules["mapping"]) if rules.get("mapping") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules = json.loads(row["rules"] or "{}")
            make = reader(row["format"], rules)
            file = make and make(row["path"], row["content"].encode(), row["datasource"], row["default_schema"])
            try:
                if file:
                    file.read()
            except (ValueError, RecursionError):
                file.nodes = []
            nodes = file.nodes if file else []
            # A file that gives nothing stays as one plain node, so that it can be found.
            out = [n | {"partial": file.partial} for n in nodes] or [dict.fromkeys(_ARROW.names) | {"path": row["path"], "kind": "file"}]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def schema_nodes(files: DataFrame, routed: list[dict]) -> DataFrame:
    """(path, node_id, display, simple_name, kind, container, package, params, supers, logical_refs, aliases, calls, start_byte, end_byte, hash, partial).

    ``files`` are (path, content), ``routed`` what ``routes`` gives.  Files without a route and null paths
    give nothing; null contents count as empty.  A routed file without a node gives one plain node, marked
    partial, as does one of a wrong shape; a broken CREATE marks the nodes of its file.  Snapshots go
    to ``snapshot_nodes``, without places.  A file's nodes are built in one task, and nothing but paths is shuffled.
    """
    spark: SparkSession = files.sparkSession
    table = spark.createDataFrame([tuple(r[c] for c in ("path", "datasource", "default_schema", "format", "rules")) for r in routed], "path string, datasource string, default_schema string, format string, rules string")
    known = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(table, "path")
    read = known.filter("format <> 'snapshot'").mapInArrow(_read, NODE)
    lost = read.filter("kind = 'file'").select("path")
    nodes = read.filter("kind <> 'file'").withColumn("calls", F.when(F.col("definition").isNotNull(), definition_names(F.col("definition"))).otherwise(F.array().cast("array<string>"))).drop("definition")
    plain = plain_nodes(known.join(lost, "path", "left_semi").select("path", "content"), True)
    shots = snapshot_nodes(known.filter("format = 'snapshot'").select("path", "content"))
    return nodes.unionByName(plain, allowMissingColumns=True).unionByName(shots, allowMissingColumns=True)


def json_values(files: DataFrame) -> DataFrame:
    """(path, value_path, start_byte, end_byte) of all values of JSON files (path, content); others give nothing."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    places = value_places(content.encode())
                except (ValueError, RecursionError):
                    continue
                yield pa.RecordBatch.from_pylist([{"path": path, "value_path": p, "start_byte": a, "end_byte": b} for p, (a, b) in places.items()], schema=pa.schema([("path", pa.string()), ("value_path", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))

    some = files.filter("path is not null and content is not null").select("path", "content")
    return some.mapInArrow(read, "path string, value_path string, start_byte long, end_byte long")
