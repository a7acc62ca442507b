"""Counts, sums and times of a plan's stages, taken while it runs, without a second pass."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "stage string, figure string, value double"


class Observed:
    """Figures of stages that are watched, and seconds of actions that are run."""

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watch(self, df: DataFrame, stage: str, **figures: Column) -> DataFrame:
        """df, whose figures (aggregates) are known once an action has run over it."""
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], *(x.alias(name) for name, x in figures.items()))

    def run(self, name: str, action: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def rows(self) -> list[tuple[str, str, float | None]]:
        """(stage, figure, value); waits for stages that no action has reached."""
        return [(stage, k, None if v is None else float(v)) for stage, seen in self.stages.items() for k, v in seen.get.items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    def within(self, baseline: dict[tuple[str, str], float], most: float = 2.0) -> dict[tuple[str, str], bool]:
        """By stage and figure of a baseline: whether this run's value is at most `most` times as large."""
        own = {(stage, k): v for stage, k, v in self.rows()} | {("seconds", k): v for k, v in self.seconds.items()}
        return {k: own.get(k) is not None and own[k] <= most * v for k, v in baseline.items()}


def of_stream(query: StreamingQuery) -> list[tuple[int, str, str, Any]]:
    """(batch, stage, figure, value) of what a stream's batches have observed, as far as its progress is kept."""
    return [(p["batchId"], stage, k, v) for p in query.recentProgress for stage, row in (p["observedMetrics"] or {}).items() for k, v in (row if isinstance(row, dict) else row.asDict()).items()]
