"""Arrow-batched wrappers of plain Python functions, for what built-in functions can't express."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ship


def vectorised(fn: Callable, returns: str) -> Callable[..., Column]:
    """A pandas UDF that applies ``fn`` to each distinct row of arguments in a batch once."""

    def run(*columns: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for key in zip(*(c.where(c.notna(), None) for c in columns), strict=True):
            if key not in memo:
                memo[key] = fn(*key)
            out.append(memo[key])
        return pd.Series(out, dtype=object)

    made: list = []

    def call(*columns: Column) -> Column:
        ship(SparkSession.active())
        if not made:  # a session is needed for this
            made.append(F.pandas_udf(run, returns))
        return made[0](*columns)

    return call
