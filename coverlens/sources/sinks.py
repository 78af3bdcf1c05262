"""Writing result tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame


def write_metrics(
    metrics: dict[str, DataFrame], folder: str, fmt: str = "csv", mode: str = "overwrite", at_once: int = 6
) -> list[str]:
    """One headed table per metric under ``folder``; returns the paths.

    The tables are independent, so ``at_once`` of them are submitted side by side: each is a few short
    stages that would leave most of a cluster idle. A metric that fits one partition lands in one file,
    as adaptive execution merges the small partitions of its final sort; nothing is forced through one task.
    """

    def write(name: str) -> str:
        path = f"{folder.rstrip('/')}/{name}"
        writer = metrics[name].write.mode(mode)
        (writer.option("header", True).csv if fmt == "csv" else writer.format(fmt).save)(path)
        return path

    if not metrics:
        return []
    session = next(iter(metrics.values())).sparkSession
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(session)(write), metrics))
