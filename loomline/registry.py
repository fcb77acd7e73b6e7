"""All relational and streaming queries by name, and the oracle's SQL for them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .plans import oracle, sql
from .plans.frames import FRAMES
from .plans.relational import QUERIES as STATEMENTS
from .plans.stored import STORED
from .streaming.queries import STREAMS


def _statement(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: partial(_statement, text) for name, (text, _) in STATEMENTS.items()},
    **{name: f for name, (f, _) in {**FRAMES, **STREAMS, **STORED}.items()},
}

ORACLES: dict[str, str] = {
    **{name: oracle(other or text) for name, (text, other) in STATEMENTS.items()},
    **{name: text for name, (_, text) in {**FRAMES, **STREAMS, **STORED}.items() if text},
}
