"""A plan is an ordered list of named DataFrame -> DataFrame stages; users add, replace and remove them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plan:
    stages: tuple[tuple[int, str, Stage], ...] = ()

    def add(self, order: int, name: str, stage: Stage) -> Plan:
        return replace(self, stages=(*self.stages, (order, name, stage)))

    def swap(self, name: str, stage: Stage) -> Plan:
        return replace(self, stages=tuple((o, n, stage if n == name else s) for o, n, s in self.stages))

    def without(self, name: str) -> Plan:
        return replace(self, stages=tuple(x for x in self.stages if x[1] != name))

    def run(self, df: DataFrame) -> DataFrame:
        for _, _, stage in sorted(self.stages, key=lambda x: (x[0], x[1])):
            df = df.transform(stage)
        return df
