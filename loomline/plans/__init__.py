"""SQL over the tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import read


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement whose ``{table}`` names are tables of the folder. Only the tables it names are opened."""
    names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in names})


def oracle(text: str) -> str:
    """The same statement with plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
