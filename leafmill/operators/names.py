"""Columns of any names to group by."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def own_names(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets the columns of `by` have any names: within, they are called _by0, _by1, .."""

    @wraps(run)
    def named(rows: DataFrame, by: list[str], *more: object) -> DataFrame:
        inner = {c: f"_by{i}" for i, c in enumerate(by)}
        return run(rows.withColumnsRenamed(inner), list(inner.values()), *more).withColumnsRenamed({v: k for k, v in inner.items()})

    return named
