"""Readers that turn files into rows (S1-S3, S5, S22, S23; S13 in part)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

#: Languages by suffix, plain files by suffix and name, and folders and files never read.
SUFFIXES = {".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".tsx": "tsx", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".md": "markdown", ".markdown": "markdown"}
MINIFIED = (".min.js", ".min.mjs", ".min.cjs")
PLAIN_SUFFIXES = (".yml", ".yaml", ".properties", ".json", ".xml", ".sql", ".toml", ".txt", ".conf", ".ini", ".cfg", ".gradle", ".sh", ".prisma")
PLAIN_NAMES = ("Dockerfile", "Makefile", "makefile", "Jenkinsfile")
SKIPPED_DIRS = ("build", "out", "target", ".gradle", "__pycache__", "venv", ".venv", "node_modules", "dist", ".next", "coverage", ".git")
SKIPPED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "uv.lock", "gradle.lockfile", "composer.lock", "Gemfile.lock")


def language(path: Column, schema_suffix: str = ".schema.json") -> Column:
    """Language by suffix; minified scripts have none; snapshots of databases end in ``schema_suffix``."""
    ends = lambda xs: reduce(or_, (F.endswith(path, F.lit(x)) for x in xs))
    out = F.when(ends(MINIFIED), None)
    for suffix, name in SUFFIXES.items():
        out = out.when(F.endswith(path, F.lit(suffix)), name)
    name = F.substring_index(path, "/", -1)
    return out.when(F.endswith(path, F.lit(schema_suffix)), "dbschema").when(name.isin(*PLAIN_NAMES) | ends(PLAIN_SUFFIXES), "plain")


def admissible(path: Column, length: Column, most: int = 1 << 20, own_dir: str = ".textloom") -> Column:
    """Whether a file is read; ``own_dir`` is the folder of the engine's own files."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return language(path).isNotNull() & (length <= most) & ~F.exists(folders, lambda p: p.isin(*SKIPPED_DIRS, own_dir)) & ~F.element_at(parts, -1).isin(*SKIPPED_FILES)


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of the admissible files below a folder; ``ignore`` has the rules of ignore files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(admissible(F.col("path"), F.col("length"))).select("path", "length", F.decode("content", "UTF-8").alias("content"))


def sql_tables(text: Column) -> Column:
    """Names with their qualifiers, as written; ``referenced_tables`` has S22's rules: tables named after FROM, JOIN, INTO, UPDATE or TABLE in a SQL literal."""
    sql = text.rlike(r"(?i)\b(select|insert|update|delete|create)\b")
    names = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    return F.when(sql, F.array_distinct(names)).otherwise(F.array().cast("array<string>"))


#: Words after an anchor that are no tables.
NO_TABLES = ("select", "where", "values", "set", "lateral", "only", "unnest", "generate_series")


def referenced_tables(text: Column) -> Column:
    """The tables a SQL literal reads or writes, without qualifiers, the first of each whatever its case.

    Names follow FROM or JOIN if the literal selects or deletes, INSERT INTO, and UPDATE if it has SET.
    """
    has = lambda w: text.rlike(f"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])")
    after = lambda anchor, ok: F.when(ok, F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{anchor})\s+([A-Za-z_][A-Za-z0-9_$.]*)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.concat(after("from|join", (has("select") | has("delete")) & has("from")), after(r"insert\s+into", has("insert")), after("update", has("update") & has("set")))
    names = F.filter(F.transform(found, lambda n: F.substring_index(n, ".", -1)), lambda n: (n != "") & ~F.lower(n).isin(*NO_TABLES))
    return let(names, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, F.lower), F.lower(x)) == i + 1))


def snapshot_tables(files: DataFrame) -> DataFrame:
    """(path, schema, name, column, type) of database snapshots; malformed files give none."""
    shape = "schemas map<string, struct<tables: map<string, struct<columns: array<struct<name: string, type: string>>>>>>"
    doc = files.select("path", F.from_json("content", shape).alias("d"))
    tables = doc.select("path", F.explode("d.schemas").alias("schema", "s")).select("path", "schema", F.explode("s.tables").alias("name", "t"))
    return tables.select("path", "schema", "name", F.explode_outer("t.columns").alias("c")).select("path", "schema", "name", F.col("c.name").alias("column"), F.col("c.type").alias("type"))


EVENT = "v int, ts string, session_id string, prompt_id string, tool_use_id string, parallel boolean, agent_id string, agent_type string, cwd string, tool string, p struct<query: string, top_k: int, result_count: int, result_ids: array<string>, node_id: string, pattern: string, path: string, file_path: string, search: boolean>"


def usage_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected lines) of a JSON-lines log."""
    rows = spark.read.text(path).filter("trim(value) != ''").select("value", F.from_json("value", EVENT).alias("e"))
    ok = F.col("e").isNotNull() & (F.coalesce("e.v", F.lit(0)) <= 1) & (F.coalesce("e.session_id", F.lit("")) != "") & (F.coalesce("e.tool", F.lit("")) != "")
    return rows.filter(ok).select("e.*"), rows.filter(~ok).select("value")
