"""Readers of Markdown, sets and terms."""

import hashlib

from textloom.sources import markdown

TEXT = "intro é\n# Top\ntext\n## Same\n~~~\n# code\n```\n~~~~\n## Same ##\r\n### Deep `x`!\n#hashtag\n#### \n# 한글 제목\n####### no\n"


def test_nodes(spark):
    df = spark.createDataFrame([("a/b.md", TEXT), ("plain.md", "only text"), (None, "x"), ("null.md", None), ("empty.md", "")], "path string, content string")
    rows = {r["node_id"]: r for r in markdown.markdown_nodes(df).collect()}
    # Parents are anchors, and the file for headings with no higher one above.
    assert [(i, r["container"], r["start_line"]) for i, r in rows.items() if r["path"] == "a/b.md"] == [("a/b.md", "", 1), ("a/b.md#top", "", 2), ("a/b.md#same", "top", 4), ("a/b.md#same-1", "top", 9), ("a/b.md#deep-x", "same-1", 10), ("a/b.md#section", "deep-x", 12), ("a/b.md#한글-제목", "", 13)]
    data = TEXT.encode()
    for r in rows.values():
        if r["path"] == "a/b.md":
            part = data[r["start_byte"] : r["end_byte"]]
            assert r["package"] == "a" and r["hash"] == hashlib.sha256(part if r["kind"] == "section" else "intro é\n".encode()).hexdigest()
    assert rows["a/b.md"]["contains"] == ["a/b.md#top", "a/b.md#한글-제목"] and rows["a/b.md"]["body_tokens"] == ["intro", "é"]
    assert rows["a/b.md#top"]["contains"] == ["a/b.md#same", "a/b.md#same-1"] and rows["a/b.md#same"]["rename_key"] == hashlib.sha256(b"~~~\n# code\n```\n~~~~\n").hexdigest()
    assert rows["plain.md"]["body_tokens"] == ["only", "text"] and rows["empty.md"]["end_byte"] == 0 and len(rows) == 9
    assert markdown.markdown_sections(df).count() == 6 and markdown.markdown_nodes(df.limit(0)).count() == 0


SET = """---
title: "Orders"
roles: [dev, 'ops']
prerequisites:
  - base
  # none else
tags:
---
# Heading
Some words
about it
- [Early](x.md) before any group
## Code é
- [Parse](../src/a.py#f) — how it
  is parsed
```
- [No](no.md)
```
- [Bare](b.md)
not more
"""
TERM = "---\nstatus: draft\naliases: [po, purchase order]\nreviewed:\n- ann — 2024-01-01\n- bob\nnot_to_be_confused_with:\n- sale - paid\n---\n\nA term.\n"


def test_sets_terms_and_pins(spark):
    df = spark.createDataFrame([("k/orders.md", SET), ("k/none.md", "---\nopen: block\n")], "path string, content string")
    s, none = markdown.knowledge_sets(df).orderBy("path", ascending=False).collect()
    assert (s["name"], s["title"], s["roles"], s["prerequisites"], s["tags"], s["mode"], s["intro"]) == ("orders", "Orders", ["dev", "ops"], ["base"], [], "live", "Some words about it")
    first, code = s["groups"]
    assert first["title"] == "" and [tuple(e)[:3] for e in first["entries"]] == [("Early", "k/x.md", "before any group")]
    assert code["node_id"] == "k/orders.md#code-é" and [tuple(e)[:3] for e in code["entries"]] == [("Parse", "src/a.py#f", "how it is parsed"), ("Bare", "k/b.md", "")]
    assert none["groups"] == [] and none["intro"] == "--- open: block"
    t = markdown.terms(spark.createDataFrame([("t/order.md", TERM)], "path string, content string")).first()
    assert (t["canonical"], t["title"], t["status"], t["aliases"], t["body"]) == ("order", "order", "draft", ["po", "purchase order"], "A term.")
    assert [tuple(r) for r in t["reviewed"]] == [("ann", "2024-01-01"), ("bob", "")] and [tuple(r) for r in t["confusions"]] == [("sale", "paid")]
    assert markdown.agent_roles("---\nagents:\n- tester — dev\n- free\n---\n") == {"tester": "dev", "free": "exempt"}
    lock = '{"v": 1, "pins": {"orders": {"a.b": {"h": "1", "r": "2"}, "c": {"h": "3"}}}}'
    got = markdown.pins(spark.createDataFrame([("p", lock), ("q", lock.replace("1,", "2,", 1)), ("r", "x")], "path string, content string")).orderBy("node_id").collect()
    assert [tuple(r) for r in got] == [("orders", "a.b", "1", "2"), ("orders", "c", "3", None)]
