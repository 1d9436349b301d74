"""A summary kept at a fine grain and answered at any coarser one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SketchArgumentError


@dataclass(frozen=True)
class SketchTable:
    """state: a state by the columns in `by`; merge(state, by=...) merges its groups into those of a coarser grouping.

    The fine state is far smaller than the rows it sums up, so each question is a small aggregation
    instead of a scan.
    """

    state: DataFrame
    by: Sequence[str]
    merge: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)

    def rollup(self, by: Sequence[str] = ()) -> DataFrame:
        missing = [c for c in by if c not in self.by]
        if missing:
            raise SketchArgumentError("these columns are no groups of the table", missing=missing)
        dropped = [c for c in self.by if c not in by]
        return self.merge(self.state.drop(*dropped), by=list(by), **self.options)

    def where(self, condition: str) -> SketchTable:
        """Only some groups: a filter on group columns, pushed down to the stored table."""
        return SketchTable(self.state.where(condition), self.by, self.merge, self.options)

    def cube(self, by: Sequence[str], answer: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
        """answer(state, by) for every subset of by; columns that are summed over are null."""
        out = None
        for n in range(len(by), -1, -1):
            for some in combinations(by, n):
                one = answer(self.rollup(list(some)), list(some))
                rest = [c for c in one.columns if c not in by]
                kinds = dict(self.state.dtypes)
                one = one.select(*[F.col(c) if c in some else F.lit(None).cast(kinds[c]).alias(c) for c in by], *rest)
                out = one if out is None else out.unionByName(one)
        return out
