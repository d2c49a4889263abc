"""Counters of a run, gathered in the passes that do the work."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


class Counters:
    """Aggregates over frames on their way; ``values`` has them once an action has read these frames to the end.

    No job runs for them: Spark adds them up while the rows pass. A partitioning by range draws its sample by running what is before it
    once more, which would be counted twice: watch a frame that is checkpointed before it is dealt to ranges."""

    def __init__(self):
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        self._seen.append(Observation())
        return df.observe(self._seen[-1], *[a.alias(name) for name, a in aggregates.items()])

    def values(self) -> dict:
        """All counters by name; waits for the actions over their frames."""
        return {name: n for seen in self._seen for name, n in seen.get.items()}
