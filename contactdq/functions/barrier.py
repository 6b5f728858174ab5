"""Holding the optimizer back where moving an expression would repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` computed here, once.

    A filter above a chain of projections is pushed below it with every expression written out, which repeats the long
    ones, within lambdas once for each element. The columns come out of a one-row generator instead, which no filter on them passes.
    """
    some = [c for c in df.columns if c in columns]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in some]))))
