"""An ordered list of steps that stops at the first failure, and keeps the results of those before it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Done:
    name: str
    seconds: float
    error: str | None


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[SparkSession, str], DataFrame]]], sf_dir: str, out_dir: str) -> list[Done]:
    """Write each step's result to out_dir/name as Parquet; later steps do not start after a failure."""
    done: list[Done] = []
    for name, step in steps:
        began = time.perf_counter()
        try:
            step(spark, sf_dir).write.mode("overwrite").parquet(f"{out_dir}/{name}")
        except Exception as e:  # the failure is the step's result
            done.append(Done(name, time.perf_counter() - began, f"{type(e).__name__}: {e}"[:500]))
            break
        done.append(Done(name, time.perf_counter() - began, None))
    return done
