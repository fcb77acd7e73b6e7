"""Tables written between steps, in the folder that driver and executors share.

A written table cuts lineage: when an executor is lost, later steps read the
table again instead of recomputing what came before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import remove, remove_at_end, shared_folder, ship


class Workspace:
    """One run's tables under the shared folder. What a run doesn't drop goes when the driver's Python ends, also where the session was stopped before; a result may read it until then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        remove_at_end(spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table, read back with its own schema. A name that is used again gets a table of its own."""
        path = self.paths[name] = f"{self.path}/{len(self.paths)}-{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the last table of this name, which no later step reads."""
        remove(self.paths.pop(name), self.spark.sparkContext._jsc.hadoopConfiguration())


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a shuffle that must be dealt by hand, from the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
