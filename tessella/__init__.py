"""Spark-native search, recommendation and catalogue analytics."""

import os
from pathlib import Path


def _reach_workers() -> None:
    """Let Python workers import this package wherever the driver was started: of this context and of later ones."""
    from pyspark import SparkContext

    root = str(Path(__file__).resolve().parents[1])

    def joined(known: str) -> str:
        paths = [p for p in known.split(os.pathsep) if p]
        return os.pathsep.join(paths if root in paths else [root, *paths])

    os.environ["PYTHONPATH"] = joined(os.environ.get("PYTHONPATH", ""))
    context = SparkContext._active_spark_context
    if context is not None:
        context.environment["PYTHONPATH"] = joined(context.environment.get("PYTHONPATH", ""))


_reach_workers()
