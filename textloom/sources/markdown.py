"""Readers of Markdown: files and sections as nodes (S11, W9), and files of knowledge sets and terms."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize_capped

_STRINGS = pa.list_(pa.string())
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t](.*))?$", re.S)
#: An entry of a set, and what separates a thing from what is said of it.
_ENTRY = re.compile(r"\s*-\s+\[([^\]]+)\]\(([^)\s]+)\)\s*(.*)$", re.S)
SEPARATORS = (" — ", " – ", " -- ", " - ")


def _lines(text: str) -> Iterator[tuple[int, str, bool]]:
    """(start, line, whether it belongs to a fenced block); a fence ends at one of its kind, as long or longer."""
    fence, at = "", 0
    for raw in text.split("\n"):
        m = _FENCE.match(raw)
        inside = bool(fence or m)
        if m and not fence:
            fence = m[1]
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
            fence = ""
        yield at, raw, inside
        at += len(raw) + 1


def slug(title: str) -> str:
    """the anchor of a heading: letters, digits, _ and -, a hyphen for each white space; empty ones are ``section``."""
    kept = ("-" if c.isspace() else c for c in title.lower() if c.isspace() or c in "_-" or c.isalpha() or c.isdecimal())
    return "".join(kept) or "section"


def sections(path: str, data: bytes) -> list[dict]:
    """The file's node and one for each heading outside fences; a section ends at the next heading."""
    text = data.decode("latin-1")  # places are bytes
    heads = [(start, len(m[1]), (m[2] or "").strip().rstrip("#").strip().encode("latin-1").decode("utf-8", "replace")) for start, line, inside in _lines(text) if not inside and (m := _HEADING.match(line))]
    base, _, folder = posixpath.basename(path), 0, posixpath.dirname(path)
    node = lambda start, end, **more: {"path": path, "package": folder.strip("/").replace("/", "."), "start_byte": start, "end_byte": end, "contains": [], **more}
    first = heads[0][0] if heads else len(data)
    out = [node(0, len(data), node_id=path, display=base, simple_name=base, kind="file", container="", level=0, ordinal=0, start_line=1, hash=hashlib.sha256(data[:first]).hexdigest(), body=data[:first].decode("utf-8", "replace"))]
    seen: Counter = Counter()
    above: list[dict] = [out[0]]  # the sections around a place, levels rising
    line, counted = 1, 0
    for n, (start, level, title) in enumerate(heads, 1):
        end = heads[n][0] if n < len(heads) else len(data)
        line, counted = line + text.count("\n", counted, start), start
        base = slug(title)
        anchor = f"{base}-{seen[base]}" if seen[base] else base
        seen[base] += 1
        while above[-1]["level"] >= level:
            above.pop()
        body = text.find("\n", start, end) + 1 or end
        out.append(node(start, end, node_id=f"{path}#{anchor}", display=title, simple_name=title, kind="section", container=above[-1]["node_id"].partition("#")[2], level=level, ordinal=n, start_line=line, hash=hashlib.sha256(data[start:end]).hexdigest(), rename_key=hashlib.sha256(data[body:end]).hexdigest(), body=data[start:end].decode("utf-8", "replace")))
        above[-1]["contains"].append(out[-1]["node_id"])
        above.append(out[-1])
    return out


def _reader(read, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(read(path, content.encode()), schema=schema)

    return run


def _files(files: DataFrame) -> DataFrame:
    return files.filter("path is not null and content is not null").select("path", "content")


_NODE = {"path": "string", "node_id": "string", "display": "string", "simple_name": "string", "kind": "string", "container": "string", "package": "string", "level": "int", "ordinal": "int", "start_line": "int", "start_byte": "long", "end_byte": "long", "hash": "string", "rename_key": "string", "body": "string", "contains": "array<string>"}
_NODE_ARROW = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}.get(t, _STRINGS)) for c, t in _NODE.items()])


def markdown_nodes(files: DataFrame, most: int = 256) -> DataFrame:
    """Nodes of (path, content): the file, with the hash and tokens of what stands before its first heading, and its sections.

    ``container`` is the anchor of the section around, ``contains`` the sections directly below, ``rename_key`` the
    hash of a section without its heading.  Null paths and contents give nothing; a file's nodes are built in one task.
    """
    nodes = _files(files).mapInArrow(_reader(sections, _NODE_ARROW), ", ".join(f"{c} {t}" for c, t in _NODE.items()))
    return nodes.withColumn("body_tokens", tokenize_capped(F.col("body"), most)).drop("body")


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, ordinal, level, title, anchor, start_line, parent) of headings; the parent is an anchor, empty for the file."""
    nodes = _files(files).mapInArrow(_reader(sections, _NODE_ARROW), ", ".join(f"{c} {t}" for c, t in _NODE.items())).filter("kind = 'section'")
    anchor = F.expr("substr(node_id, length(path) + 2)")
    return nodes.select("path", "ordinal", "level", F.col("display").alias("title"), anchor.alias("anchor"), "start_line", F.col("container").alias("parent"))


def front_matter(text: str) -> tuple[dict[str, str], dict[str, list[str]], str]:
    """(scalars, lists, body) of a file; one without a closed block at its start is all body."""
    m = re.match(r"---\r?\n(.*?)^---\r?(?:\n|\Z)", text, re.S | re.M)
    if not m:
        return {}, {}, text
    bare = lambda s: s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s
    scalars, lists, key = {}, {}, None
    for line in map(str.strip, m[1].split("\n")):
        if not line or line.startswith("#"):
            continue
        if line == "-" or line.startswith("- "):
            if key and (item := bare(line[1:].strip())):
                lists[key].append(item)
            continue
        name, colon, value = map(str.strip, line.partition(":"))
        if not colon or not name:
            continue
        key = None
        if not value:
            key = name
            lists.setdefault(name, [])
        elif value[0] == "[" and value[-1] == "]":
            lists[name] = [x for x in (bare(v.strip()) for v in value[1:-1].split(",")) if x]
        else:
            scalars[name] = bare(value)
    return scalars, lists, text[m.end() :]


def pair(text: str) -> tuple[str, str]:
    """What stands before and after the first kind of dash that occurs."""
    dash = next((s for s in SEPARATORS if s in text), None)
    left, _, right = text.partition(dash) if dash else (text, "", "")
    return left.strip(), right.strip()


def _summary(text: str) -> str:
    text = text.strip()
    return text[1:].strip() if text[:1] in ("—", "–", "-", ":") else text


def read_set(path: str, data: bytes) -> list[dict]:
    """One knowledge set: its front matter, and the entries below each heading of level two or more."""
    text = data.decode("utf-8", "replace")
    scalars, lists, body = front_matter(text)
    skipped = len(text[: len(text) - len(body)].encode())
    anchors = {n["start_byte"]: n["node_id"] for n in sections(path, data)}
    title, intro, groups, entry = scalars.get("title", ""), [], [], None
    for no, (at, line, inside) in enumerate(_lines(body), 1):
        m, e = _HEADING.match(line.rstrip("\r")), _ENTRY.match(line.rstrip("\r"))
        if inside or not line.strip():
            entry = None
        elif m and m[2]:
            entry, name = None, m[2].strip().rstrip("#").strip()
            if len(m[1]) == 1:
                title = title or name
            else:
                groups.append({"title": name, "node_id": anchors.get(skipped + len(body[:at].encode())), "entries": []})
        elif e:
            target, _, anchor = e[2].partition("#")
            if not groups:  # entries before any group are kept
                groups.append({"title": "", "node_id": anchors.get(skipped), "entries": []})
            entry = {"title": e[1].strip(), "node_id": posixpath.normpath(posixpath.join(posixpath.dirname(path), target)) + (f"#{anchor}" if anchor else ""), "summary": _summary(e[3]), "line": no}
            groups[-1]["entries"].append(entry)
        elif entry and line[0] in " \t":
            entry["summary"] = f"{entry['summary']} {_summary(line)}".strip()
        else:
            entry = None
            if not groups:
                intro.append(line.strip())
    return [{
        "path": path, "name": posixpath.basename(path).removesuffix(".md"), "title": title, "description": scalars.get("description", ""), "mode": scalars.get("mode") or "live", "stale_after": scalars.get("stale_after", ""),
        "tags": lists.get("tags", []), "roles": lists.get("roles", []), "prerequisites": lists.get("prerequisites", []), "intro": " ".join(intro), "groups": groups,
    }]


def read_term(path: str, data: bytes) -> list[dict]:
    """One term: named by its front matter, else by its file; stable unless it says otherwise."""
    scalars, lists, body = front_matter(data.decode("utf-8", "replace"))
    name = scalars.get("canonical") or posixpath.basename(path).removesuffix(".md")
    pairs = lambda key, a, b: [{a: x, b: y} for x, y in map(pair, lists.get(key, [])) if x]
    plain = {c: scalars.get(c, "") for c in ("description", "stale_after", "derives_from", "last_verified")}
    many = {c: lists.get(c, []) for c in ("tags", "aliases", "scope", "evidence")}
    return [{"path": path, "canonical": name, "title": scalars.get("title") or name, "status": scalars.get("status") or "stable", **plain, **many, "reviewed": pairs("reviewed", "by", "at"), "confusions": pairs("not_to_be_confused_with", "term", "why"), "body": body.strip()}]


_ENTRIES = pa.list_(pa.struct([("title", pa.string()), ("node_id", pa.string()), ("summary", pa.string()), ("line", pa.int32())]))
_SET = pa.schema([*((c, pa.string()) for c in ("path", "name", "title", "description", "mode", "stale_after")), *((c, _STRINGS) for c in ("tags", "roles", "prerequisites")), ("intro", pa.string()), ("groups", pa.list_(pa.struct([("title", pa.string()), ("node_id", pa.string()), ("entries", _ENTRIES)])))])
_PAIRS = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
_TERM = pa.schema([*((c, pa.string()) for c in ("path", "canonical", "title", "status", "description", "stale_after", "derives_from", "last_verified")), *((c, _STRINGS) for c in ("tags", "aliases", "scope", "evidence")), ("reviewed", _PAIRS("by", "at")), ("confusions", _PAIRS("term", "why")), ("body", pa.string())])


def knowledge_sets(files: DataFrame) -> DataFrame:
    """(path, name, title, description, mode, stale_after, tags, roles, prerequisites, intro, groups) of set files (path, content)."""
    entry = "struct<title: string, node_id: string, summary: string, line: int>"
    text = "path string, name string, title string, description string, mode string, stale_after string, tags array<string>, roles array<string>, prerequisites array<string>, intro string"
    return _files(files).mapInArrow(_reader(read_set, _SET), f"{text}, groups array<struct<title: string, node_id: string, entries: array<{entry}>>>")


def terms(files: DataFrame) -> DataFrame:
    """One row of each term file (path, content), with ``reviewed`` (by, at) and ``confusions`` (term, why)."""
    plain = ", ".join(f"{c} string" for c in _TERM.names[:8]) + ", " + ", ".join(f"{c} array<string>" for c in _TERM.names[8:12])
    return _files(files).mapInArrow(_reader(read_term, _TERM), f"{plain}, reviewed array<struct<by: string, at: string>>, confusions array<struct<term: string, why: string>>, body string")


def agent_roles(content: str) -> dict[str, str]:
    """Roles by agent, from the ``agents`` list of one small page; an agent without a role is exempt."""
    return {name: role or "exempt" for name, role in map(pair, front_matter(content)[1].get("agents", [])) if name}


PINS = "v int, pins map<string, map<string, struct<h: string, r: string>>>"


def pins(files: DataFrame) -> DataFrame:
    """(set_name, node_id, hash, rename_key) of lock files (path, content) of version 1; others give nothing."""
    doc = files.select(F.from_json("content", PINS).alias("d")).filter("d.v = 1")
    return doc.select(F.explode("d.pins").alias("set_name", "p")).select("set_name", F.explode("p").alias("node_id", "q")).select("set_name", "node_id", F.col("q.h").alias("hash"), F.col("q.r").alias("rename_key"))
