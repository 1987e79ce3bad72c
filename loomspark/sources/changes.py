"""Changed files of a git work tree, and lists of tasks and marks from JSON."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession

TASKS = "id string, cmd string, cwd string, env map<string,string>, timeout bigint, depends_on array<string>, tags array<string>, description string"
MARKS = "path string, start_line bigint, end_line bigint, id string, tags array<string>, version int"


def git_arguments(staged: bool = False, commit: str | None = None, diff: str | None = None) -> list[str]:
    """The git call for one kind of change; staged goes before commit, commit before diff, else unstaged changes."""
    if staged:
        return ["diff", "--name-only", "--cached"]
    if commit:
        return ["diff", "--name-only", f"{commit}^", commit]
    if diff:
        return ["diff", "--name-only", *diff.split()]
    return ["diff", "--name-only"]


def git_changes(spark: SparkSession, root: str, timeout: int = 60, **kind) -> DataFrame:
    """``path`` of every changed file, relative to the top of the work tree; a first commit shows all of its files."""
    run = lambda args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    done = run(git_arguments(**kind))
    if done.returncode and kind.get("commit"):
        done = run(["show", "--name-only", "--format=", kind["commit"]])
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return spark.createDataFrame([(p,) for p in done.stdout.splitlines() if p], "path string")


def parse_tasks(text: str) -> list[dict]:
    """Tasks from JSON: one task, a list of tasks, or a set with ``tasks`` and ``groups``."""
    found = json.loads(text)
    if isinstance(found, dict) and "id" in found and "cmd" in found:
        found = [found]
    elif isinstance(found, dict):
        found = [*found.get("tasks", []), *(t for g in found.get("groups", []) for t in g.get("tasks", []))]
    if not isinstance(found, list) or not all(isinstance(t, dict) and t.get("id") and t.get("cmd") for t in found):
        raise ValueError("neither a task, nor a list nor a set of tasks")
    return [{"cwd": None, "env": {}, "timeout": 300, "depends_on": [], "tags": [], "description": None} | t for t in found]


def parse_marks(text: str) -> list[dict]:
    """Marks from JSON: a list, or an object with ``marks``."""
    found = json.loads(text)
    found = found.get("marks", []) if isinstance(found, dict) else found
    return [{"tags": [], "version": 1} | m for m in found]


def marks_table(spark: SparkSession, text: str) -> DataFrame:
    """The marks as specs for ``anchors.mark``."""
    rows = [(m.get("path") or m.get("file"), m.get("start_line") or m.get("start"), m.get("end_line") or m.get("end"), m["id"], m["tags"], m["version"]) for m in parse_marks(text)]
    return spark.createDataFrame(rows, MARKS)
