"""Joins in which some keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: A key of more rows is joined apart from the others.
HOT = 500


def join_hot(rows: DataFrame, table: DataFrame, on: str, size: str, work: Workspace, name: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined to ``table``, which has a row for each key ``on`` and says in ``size`` how many rows hold it.

    Keys of more than ``hot`` rows, of which there can be one in ``hot`` rows at
    most, make up a table of their own. Spark sends that one to all tasks where it
    is below its broadcast limit, so that the rows of a hot key stay where they
    are; a larger one is shuffled, and adaptive execution may split its keys. Null
    keys match nothing.
    """
    table = work.write(table, name)
    few = work.write(table.where(F.col(size) > hot), f"{name}-hot")
    if not few.head(1):
        return rows.join(table, on)
    rest = rows.join(few.select(on), on, "left_anti").join(table.where(F.col(size) <= hot), on)
    return rows.join(few, on).unionByName(rest)
