"""Structured files as rows: manifests, JSON, TOML, YAML lines, tables, run logs, patches."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (
    "task string, repo string, mode string, model string, repetition int, num_turns int, num_tool_calls int, tool_calls map<string,int>, total_cost_usd double, duration_ms long, "
    "context_tokens long, output_tokens long, input_tokens long, cache_creation_tokens long, cache_read_tokens long, per_turn_context_tokens array<long>, correct boolean, "
    "correctness_reason string, result_text string, tool_sequence array<struct<name:string,args:map<string,string>>>, version string, error string"
)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of measured runs."""
    return spark.read.schema(RUNS).json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an agent's event stream: kind, turn, tool (one row for each tool use), usage."""
    raw = spark.read.schema("type string, message struct<id:string,content:array<struct<type:string,name:string,text:string>>,usage:struct<input_tokens:long,output_tokens:long>>").json(path)
    each = raw.select("type", "message.id", F.explode_outer("message.content").alias("c"), "message.usage")
    return each.select(F.col("type").alias("kind"), F.col("id").alias("turn"), F.when(F.col("c.type") == "tool_use", F.col("c.name")).alias("tool"), F.col("c.text").alias("text"), "usage.input_tokens", "usage.output_tokens")


def patches(spark: SparkSession, path: str) -> DataFrame:
    """patch_id, text of whole patch files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.xxhash64(F.input_file_name()).alias("patch_id"), F.col("value").alias("text"))


def manifest(name: str, text: str) -> tuple[str | None, str | None, list[str]]:
    """Name, version and at most ten dependencies (sorted) of a project by its manifest."""
    try:
        if name == "Cargo.toml":
            d = tomllib.loads(text)
            p = d.get("package", {})
            return p.get("name"), p.get("version") if isinstance(p.get("version"), str) else None, sorted(d.get("dependencies", {}))[:10]
        if name == "package.json":
            d = json.loads(text)
            return d.get("name"), d.get("version"), sorted(d.get("dependencies", {}))[:10]
        if name == "pyproject.toml":
            d = tomllib.loads(text)
            p = d.get("project", {}) or d.get("tool", {}).get("poetry", {})
            deps = p.get("dependencies", [])
            return p.get("name"), p.get("version"), sorted({re.split(r"[\s<>=!~\[;(]", x)[0] for x in deps if x})[:10]
    except (ValueError, AttributeError, TypeError):
        return None, None, []
    if name == "go.mod":
        own = re.search(r"^module\s+(\S+)", text, re.M)
        block = re.findall(r"^(?:require\s+)?\t?([\w.-]+\.[\w.-]+/\S+)\s+v\S+", text, re.M)
        return own and own[1], None, sorted(block)[:10]
    return None, None, []


def manifests(files: DataFrame) -> DataFrame:
    """path, name, version, dependencies of the manifests among files (path, text)."""
    own = F.substring_index("path", "/", -1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *manifest(p.rpartition("/")[2], t)) for p, t in zip(frame["path"], frame["text"], strict=True)], columns=["path", "name", "version", "dependencies"])

    found = files.where(own.isin("Cargo.toml", "package.json", "pyproject.toml", "go.mod")).select("path", "text")
    return found.mapInPandas(run, "path string, name string, version string, dependencies array<string>")


def preview(value, most: int = 40) -> str:
    text = json.dumps(value, ensure_ascii=False)
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


def kind(value) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def keys(value, depth: int = 2, prefix: str = "") -> Iterator[tuple[str, str, int, str]]:
    """(path, kind, size, preview) of a document's values down to a depth; keys sorted, five of them for objects below."""
    items = sorted(value.items()) if isinstance(value, dict) else [(f"[{i}]", v) for i, v in enumerate(value[:1])] if isinstance(value, list) else []
    for k, v in items if not prefix else items[:5]:
        path = f"{prefix}.{k}" if prefix else str(k)
        yield path, kind(v), len(v) if isinstance(v, (dict, list, str)) else 1, preview(v)
        if depth > 1:
            yield from keys(v, depth - 1, path)


def yaml_keys(text: str) -> Iterator[tuple[str, str, int, str]]:
    """Keys of the first two levels by indent; no YAML is parsed."""
    above = ""
    for line in text.split("\n"):
        if m := re.match(r"^( {0,2})([\w.-]+):\s*(.*)$", line):
            above = m[2] if not m[1] else above
            yield (m[2] if not m[1] else f"{above}.{m[2]}"), "string" if m[3] else "object", len(m[3]), m[3][:40]


def outline(files: DataFrame) -> DataFrame:
    """path, key, kind, size, preview of JSON, TOML and YAML files (path, text)."""

    def of(path: str, text: str) -> list[tuple]:
        try:
            ext = path.rpartition(".")[2]
            if ext == "json":
                return list(keys(json.loads(text)))
            return list(keys(json.loads(json.dumps(tomllib.loads(text), default=str)))) if ext == "toml" else list(yaml_keys(text))
        except ValueError:
            return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *r) for p, t in zip(frame["path"], frame["text"], strict=True) for r in of(p, t)]
            yield pd.DataFrame(rows, columns=["path", "key", "kind", "size", "preview"]).astype({"size": "int64"})

    found = files.where(F.col("path").rlike(r"\.(?:json|toml|ya?ml)$")).select("path", "text")
    return found.mapInPandas(run, "path string, key string, kind string, size long, preview string")


def table_view(rows: DataFrame) -> DataFrame:
    """Lines of CSV and TSV files: header, rows (line ends, so one too many after a final one), five first and three last."""
    from ..operators import lines as L

    return L.head_tail(rows.where(F.col("path").rlike(r"\.[ct]sv$")), ["path"], "line", 6, 3)
