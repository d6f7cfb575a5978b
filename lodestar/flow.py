"""Declared pipelines: named steps with parameters, plug-in queries, and checks of what a stage has left."""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]


def interpolated(value, params: dict):
    """A value with every ${name} replaced; one that is nothing but ${name} keeps the parameter's type."""
    if isinstance(value, dict):
        return {k: interpolated(v, params) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolated(v, params) for v in value]
    if not isinstance(value, str):
        return value
    whole = re.fullmatch(r"\$\{(\w+)\}", value)
    if whole:
        return params[whole[1]]
    return re.sub(r"\$\{(\w+)\}", lambda m: str(params[m[1]]), value)


def run_flow(spec: dict, tools: dict[str, Step], inputs: dict[str, DataFrame], params: dict | None = None) -> dict[str, DataFrame]:
    """The frames that a flow's steps make, by label; they are planned lazily, as one graph.

    spec: parameters (name -> {default}) and steps (tool, label, input, with, args). input names a frame or an earlier
    label, with names further frames by argument. An unknown tool, input or parameter is an error before anything runs.
    """
    values = {name: (meta or {}).get("default") for name, meta in (spec.get("parameters") or {}).items()}
    unknown = set(params or {}) - set(values)
    if unknown:
        raise KeyError(f"unknown parameters {sorted(unknown)}")
    values |= params or {}
    frames = dict(inputs)
    for k, step in enumerate(spec.get("steps") or []):
        if not step.get("tool"):
            raise ValueError(f"step {k} names no tool")
        if step["tool"] not in tools:
            raise KeyError(f"unknown tool {step['tool']}")
        more = {name: frames[label] for name, label in (step.get("with") or {}).items()}
        frames[step.get("label") or step["tool"]] = tools[step["tool"]](frames[step["input"]], **more, **interpolated(step.get("args") or {}, values))
    return frames


def discover(folders: list[str]) -> dict[str, str]:
    """Plug-ins in folder/skills/*.py by name (underscores as dashes); the first of a name counts, names with _ first do not."""
    found: dict[str, str] = {}
    for folder in folders:
        for path in sorted(Path(folder, "skills").glob("*.py")):
            if not path.name.startswith("_"):
                found.setdefault(path.stem.replace("_", "-"), str(path))
    return found


def load(path: str) -> ModuleType:
    """Import a plug-in from its file; it contributes QUERIES, name -> function."""
    spec = importlib.util.spec_from_file_location(f"lodestar_plugin_{Path(path).stem}", path)
    if spec is None or spec.loader is None:
        raise ImportError(f"cannot load {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def manifest_tools(folders: list[str]) -> dict[str, dict]:
    """Tools that folder/tools/*.json declare (name, description, sql), by name; the first of a name counts."""
    found: dict[str, dict] = {}
    for folder in folders:
        for path in sorted(Path(folder, "tools").glob("*.json")):
            spec = json.loads(path.read_text())
            if not spec.get("name") or not spec.get("sql"):
                raise ValueError(f"{path}: a tool has a name and sql")
            found.setdefault(spec["name"], spec)
    return found


def run_tool(spark: SparkSession, spec: dict, tables: dict[str, DataFrame], args: dict) -> DataFrame:
    """A declared tool: its SQL reads the tables by {name} and its arguments by :name."""
    from lodestar.warehouse import guarded

    return spark.sql(guarded(spec["sql"]), args=args, **tables)


def check(spark: SparkSession, spec: dict) -> tuple[bool, str]:
    """Whether a stage has left what it should: rows (path, min), or where (path, condition, which must hold for all rows)."""
    df = spark.read.parquet(spec["path"])
    if spec["kind"] == "rows":
        n, least = df.count(), int(spec.get("min", 1))
        return n >= least, f"{n} rows (need >= {least})"
    if spec["kind"] == "where":
        bad = df.where(~F.coalesce(F.expr(spec["condition"]), F.lit(False))).count()
        return bad == 0, f"{bad} rows against {spec['condition']}"
    return False, f"unknown check {spec['kind']}"


def content_hash(df: DataFrame) -> str:
    """Digest of a table's rows in any order: the number and the sum of their hashes; columns by name."""
    rows = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(rows.cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s or 0}"


def stale_stages(spark: SparkSession, stages: list[dict]) -> list[str]:
    """Names of done stages (name, status, evidence: path -> hash) whose tables are not what they were."""
    out = []
    for s in stages:
        if s["status"] == "done" and any(_hash_or_none(spark, p) != h for p, h in s["evidence"].items()):
            out.append(s["name"])
    return out


def _hash_or_none(spark: SparkSession, path: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return content_hash(spark.read.parquet(path))
