"""Tables in and out. Schemas are stated, so no pass over the data infers them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import remove_at_end, shared_folder

#: Schemas of the tables that are also read as text or as streams.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. What is there goes when the driver's Python ends, as a result may read it until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """``df`` written as csv, json, orc, parquet or text and read back with its own schema."""
    path = scratch(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def write_partitioned(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written in folders by column values, and read back; filters on these columns then skip folders.

    Rows are first dealt by the columns and a hash of the rest of the row, so that a
    frequent value is written by several tasks and a rare one by few.
    """
    path = scratch(df.sparkSession, "partitioned")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(*[F.col(b) for b in by], salt).write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, some at a time."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", 16).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` stored as a table in sorted buckets of ``key``. Tables with the same number of buckets join on their keys without moving rows."""
    spark = df.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"bucketed_{uuid.uuid4().hex}"
    # A task for each bucket, or each task would write a file in all of them.
    df.repartition(buckets, key).write.format("parquet").option("path", scratch(spark, name)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def upsert(path: str, schema: StructType, changes: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The table at ``path``, partitioned by ``by``, with the rows of ``changes`` in place of those with the same key in the same partition, or added.

    Only partitions that ``changes`` names are read and written again; the files of
    all others stay as they are. The new rows are stored apart first, as a partition
    can't be read while it is replaced.
    """
    spark = changes.sparkSession
    places = changes.select(*by).distinct().collect()  # folders, not rows
    table = spark.read.schema(schema).parquet(path)
    if not places:
        return table
    touched = F.lit(False)
    for place in places:
        one = F.lit(True)
        for c in by:
            one = one & F.col(c).eqNullSafe(F.lit(place[c]))
        touched = touched | one
    names = [f.name for f in schema]
    gone = changes.select(F.struct(*key, *by).alias("_gone"))
    kept = table.where(touched).join(gone, F.struct(*key, *by).eqNullSafe(F.col("_gone")), "left_anti")
    staged = scratch(spark, "changed")
    kept.select(*names).union(changes.select(*names)).write.parquet(staged)
    fresh = spark.read.schema(schema).parquet(staged)
    fresh.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def objects(reader, path: str, glob: str = "*.txt", folders: str = "page_id long") -> DataFrame:
    """Files as they are (path, modificationTime, length, content, and the folders' columns). Filters on length and time are applied before a file is opened."""
    schema = "path string, modificationTime timestamp, length long, content binary" + (folders and f", {folders}")
    return reader.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
