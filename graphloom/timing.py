"""Build times of the engine (EV-33): medians of full, idle and one-file scans, and whether the ratio reaches its gate."""

from __future__ import annotations

import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from graphloom.api import Engine

#: Fixed value: a full scan takes so many times a scan after one change, at least.
GATE = 3.0


def timed(f: Callable[[], object]) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def ratios(full: list[float], idle: list[float], one: list[float]) -> dict:
    """Medians, their ratio and the gate's verdict; worst is the largest of the samples, which reports call p95."""
    m = {"full": statistics.median(full), "idle": statistics.median(idle), "one_file": statistics.median(one)}
    ratio = m["full"] / m["one_file"] if m["one_file"] else None
    return {**{k: round(v, 4) for k, v in m.items()}, "worst": round(max(full), 4), "ratio": ratio and round(ratio, 2), "passed": ratio is not None and ratio >= GATE}


def measure(spark: SparkSession, root: str, store: str, changed: str, times: int = 5) -> dict:
    """Scans a tree afresh, again without a change, and after a comment in one file (put back at the end), so often each."""
    path = os.path.join(root, changed)
    with open(path, encoding="utf-8") as f:
        before = f.read()
    full, idle, one = [], [], []
    try:
        for i in range(times):
            engine = Engine(spark, f"{store}/{i}")
            full.append(timed(lambda e=engine: e.scan(root)))
            idle.append(timed(lambda e=engine: e.scan(root)))
            with open(path, "w", encoding="utf-8") as f:
                f.write(f"{before}\n# {i}\n")
            one.append(timed(lambda e=engine: e.scan(root)))
            with open(path, "w", encoding="utf-8") as f:
                f.write(before)
    finally:
        with open(path, "w", encoding="utf-8") as f:
            f.write(before)
    return ratios(full, idle, one)
