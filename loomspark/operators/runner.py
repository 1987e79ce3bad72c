"""Running of named tasks with dependencies, and a check of what the engine needs."""

from __future__ import annotations

import graphlib
import importlib.metadata
import importlib.util
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession

RESULT = "id string, status string, seconds double, output string, reason string"


def log_name(task_id: str) -> str:
    """A file name for a task's log: letters, digits, _ and - stay."""
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in task_id) + ".log"


def run_tasks(spark: SparkSession, tasks: list[dict], run: Callable[[dict], str], parallel: int = 4, keep_going: bool = False, tag: str | None = None, dry_run: bool = False) -> DataFrame:
    """``id, status, seconds, output, reason`` of every task: succeeded, failed, skipped or planned.

    Tasks start as soon as those they depend on have succeeded, up to ``parallel`` at once, each in a scheduler pool of
    its own so that Spark jobs of tasks share the cluster fairly. What depends on a failed, skipped or unknown task is
    skipped; without ``keep_going`` nothing new starts after a failure. A cycle of dependencies is an error.
    """
    chosen = {t["id"]: t for t in tasks if tag is None or tag in (t.get("tags") or [])}
    order = graphlib.TopologicalSorter({i: [d for d in t.get("depends_on") or [] if d in chosen] for i, t in chosen.items()})
    order.prepare()
    done: dict[str, tuple] = {}
    failed = False

    def one(task: dict) -> str:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", log_name(task["id"])[:-4])
        return run(task)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        running: dict = {}
        while order.is_active():
            for i in order.get_ready():
                t = chosen[i]
                bad = [d for d in t.get("depends_on") or [] if d not in chosen or done.get(d, ("",))[0] not in ("succeeded", "planned")]
                if bad:
                    done[i] = ("skipped", 0.0, None, f"Skipped: dependency failed: {', '.join(bad)}")
                    order.done(i)
                elif failed and not keep_going:
                    done[i] = ("skipped", 0.0, None, "Skipped: an earlier task failed")
                    order.done(i)
                elif dry_run:
                    done[i] = ("planned", 0.0, None, None)
                    order.done(i)
                else:
                    running[pool.submit(one, t)] = (i, time.time(), t.get("timeout") or 300)
            if running:
                soonest = max(0.05, min(s + limit - time.time() for _, s, limit in running.values()))
                ended, _ = wait(running, timeout=soonest, return_when=FIRST_COMPLETED)
                late = [f for f, (_, s, limit) in running.items() if f not in ended and time.time() - s >= limit]
                for f in [*ended, *late]:
                    i, began, limit = running.pop(f)
                    if f in late:
                        f.cancel()
                        done[i] = ("failed", time.time() - began, None, f"Timed out after {limit} s")
                    else:
                        error = f.exception()
                        done[i] = ("failed", time.time() - began, None, f"{type(error).__name__}: {error}") if error else ("succeeded", time.time() - began, str(f.result())[:4096], None)
                    failed |= done[i][0] == "failed"
                    order.done(i)
    return spark.createDataFrame([(i, *done[i]) for i in chosen], RESULT)


def summary(results: DataFrame) -> DataFrame:
    """``status, n``."""
    return results.groupBy("status").count().withColumnRenamed("count", "n")


#: Packages the engine needs, and those that only some operators do.
REQUIRED, OPTIONAL = ("pyspark", "pyarrow", "pandas", "numpy", "xxhash"), ("ahocorasick", "regex", "tiktoken", "tokenizers", "sentencepiece", "duckdb")


def doctor(spark: SparkSession) -> DataFrame:
    """``name, required, present, version, code``: packages and Spark itself; a missing required one has MISSING_DEPENDENCY."""
    rows = [("spark", True, True, spark.version, None)]
    for name in (*REQUIRED, *OPTIONAL):
        there = importlib.util.find_spec(name) is not None
        version = None
        if there:
            try:
                version = importlib.metadata.version({"ahocorasick": "pyahocorasick"}.get(name, name))
            except importlib.metadata.PackageNotFoundError:
                version = None
        rows.append((name, name in REQUIRED, there, version, None if there or name not in REQUIRED else "MISSING_DEPENDENCY"))
    return spark.createDataFrame(rows, "name string, required boolean, present boolean, version string, code string")


