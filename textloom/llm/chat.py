"""Chat formatting by schema fingerprints.

A record is a JSON text of any layout.  The paths of its fields, with ``[]`` for
array items, sorted and hashed, are its fingerprint; fields that no mapping names (ids,
names, sources) don't count.  A fingerprint selects a declarative mapping: which path
holds the list of turns and where role and text are inside an item, or which fields
become which turns.  Unknown fingerprints have no mapping: the record is returned
with a null format and its fingerprint.

The template marks turns ``<s>[ROLE] text </s>``.  Control strings inside
texts are escaped reversibly, by a backslash before each backslash, ``<``, ``[`` and
``]``, so the formatted text parses back to exactly the same turns.  The loss mask
is a list of (start, end) of the escaped assistant texts.

Defined cases: null texts and roles are empty; turns with null or equal numbers
are ordered null first, then by role and text; repeated rows are turns each;
conversations without rows don't exist; a field that one item of a list lacks is
empty there; a value that is no text stands as JSON; items that aren't objects have no
role and are all text; an empty list has no turns; a conversation is one text, so its
turns meet in one task; an empty table gives an empty result (but
for extra conversations); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, table


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(fields) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


def listed(items: str, role: str, text: str) -> tuple[str, dict]:
    return fingerprint({f"{items}[].{role}", f"{items}[].{text}"}), {"items": items, "role": role, "text": text, "fields": (f"{items}[].{role}", f"{items}[].{text}")}


def none_in(items: str) -> tuple[str, dict]:
    return fingerprint({f"{items}[]"}), {"items": items, "role": "", "text": "", "fields": (f"{items}[]",)}


def flat(*turns: tuple[str, tuple[str, ...]]) -> tuple[str, dict]:
    return fingerprint({f for _, fields in turns for f in fields}), {"turns": turns, "fields": tuple(f for _, fields in turns for f in fields)}


#: Declarative mappings by fingerprint.
MAPPINGS = dict(
    [
        listed("messages", "role", "content"),
        listed("conversations", "from", "value"),
        listed("turns", "role", "text"),
        none_in("messages"),
        none_in("conversations"),
        none_in("turns"),
        flat(("user", ("prompt",)), ("assistant", ("response",))),
        flat(("user", ("prompt",)), ("assistant", ("completion",))),
        flat(("user", ("question",)), ("assistant", ("answer",))),
        flat(("user", ("instruction",)), ("assistant", ("output",))),
        flat(("user", ("instruction", "input")), ("assistant", ("output",))),
        flat(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ]
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def turns_of(record: dict, mappings: dict) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, canonical turns or None) of a record."""
    own = paths(record)
    named = own & {f for rule in mappings.values() for f in rule["fields"]}
    named -= {f for f in named if f.endswith("[]") and any(o != f and o.startswith(f) for o in named)}  # bare items beside objects
    mark = fingerprint(named or own)
    rule = mappings.get(mark)
    if rule is None:
        return fingerprint(own), None
    if "items" in rule:
        got = [(x.get(rule["role"]), x.get(rule["text"])) if isinstance(x, dict) else ("", x) for x in record[rule["items"]]]
    else:
        got = [(role, "\n".join(plain(record[f]) for f in fields if record[f] not in (None, ""))) for role, fields in rule["turns"]]
    return mark, [(ROLES.get(plain(r), plain(r)), plain(t)) for r, t in got]


def plain(value) -> str:
    """A value as text: null is empty, and what is no text stands as JSON."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


_SPECIAL = re.compile(r"[\\<\[\]]")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns, loss_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"<s>[{escape(role)}] ", escape(text)
        if role in loss_roles and body:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, " </s>"]
        at += len(head) + len(body) + 5
    return "".join(out), mask


_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\] ((?:[^\\<\[]|\\.)*) </s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; an error if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _format(batches, mappings, roles):
    for batch in batches:
        marks, texts, masks = [], [], []
        for raw in batch.column("record").to_pylist():
            try:
                record = json.loads(raw) if raw else None
            except ValueError:
                record = None
            mark, turns = turns_of(record, mappings) if isinstance(record, dict) else (None, None)
            text, mask = render(turns, roles) if turns is not None else (None, None)
            marks.append(mark)
            texts.append(text)
            masks.append(None if mask is None else [{"start": a, "end": b} for a, b in mask])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.string()), pa.array(texts, pa.string()), pa.array(masks, kind)], names=["id", "fingerprint", "formatted", "loss"])


def format_chats(records: DataFrame, mappings: dict | None = None, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, fingerprint, formatted, loss) of (id, record), where record is a JSON text."""
    lean(records)
    return records.select(F.col("id").cast("long").alias("id"), "record").mapInArrow(partial(_format, mappings=mappings or MAPPINGS, roles=roles), "id long, fingerprint string, formatted string, loss array<struct<start:long,end:long>>")


def _read_back(batches):
    for batch in batches:
        cols = [[] for _ in range(5)]
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = parse(text)
            learnt = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for col, x in zip(cols, (len(turns), sha, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text))):
                col.append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(id, record): one JSON record in the messages layout for each conv_id."""
    blank = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("content"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("id")).agg(turns.alias("messages"))
    return grouped.select("id", F.to_json(F.struct("messages")).alias("record"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    formatted = format_chats(conversations_as_records(rows.unionByName(more)))
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: formatted_chars: each turn adds its marks, 11 characters and the role, to its escaped text.
SQL = r"""
with t as (
  select conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(11 + length(role) + length(regexp_replace(text, '([\\<\[\]])', '\\\1', 'g')))::bigint as formatted_chars
from t group by conv_id
"""
