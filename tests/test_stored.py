"""Stored tables: what a change rewrites, what a plan reads or moves, and that temporary folders go."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.plans import stored
from loomline.registry import QUERIES
from loomline.sources import read
from loomline.sources.tables import bucketed, objects, scratch, upsert

ROOT = Path(__file__).resolve().parents[1]


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_upsert_rewrites_what_changes_alone(spark):
    path = scratch(spark, "table")
    rows = [(k, v, p) for k in range(20) for v in ("a",) for p in [None if k % 4 == 3 else f"p{k % 4}"]]
    df = spark.createDataFrame(rows, "k int, v string, p string")
    df.write.partitionBy("p").parquet(path)
    stored_ = spark.read.schema(df.schema).parquet(path)
    before = {p: files(stored_.where(F.col("p").eqNullSafe(F.lit(p)))) for p in ("p0", "p1", "p2", None)}
    changes = spark.createDataFrame([(0, "b", "p0"), (100, "new", "p0"), (3, "c", None), (7, "d", "p9")], df.schema)
    after = upsert(path, df.schema, changes, ["k"], ["p"])
    want = [(k, {(0, "p0"): "b", (3, None): "c"}.get((k, p), v), p) for k, v, p in rows] + [(100, "new", "p0"), (7, "d", "p9")]
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(want, key=repr)
    now = {p: files(after.where(F.col("p").eqNullSafe(F.lit(p)))) for p in before}
    assert now["p1"] == before["p1"] and now["p2"] == before["p2"] and not now["p0"] & before["p0"] and not now[None] & before[None]
    assert sorted(map(tuple, upsert(path, df.schema, changes.limit(0), ["k"], ["p"]).collect()), key=repr) == sorted(want, key=repr)


def test_bucketed_tables_join_without_moving_rows(spark, capsys):
    a = bucketed(spark.range(200).withColumn("v", F.col("id") % 7), "id", 4)
    b = bucketed(spark.range(100, 300).withColumnRenamed("id", "other"), "other", 4)
    joined = a.hint("merge").join(b, a["id"] == b["other"])
    plan = plan_of(joined, capsys)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 100


def test_ranges_of_days_come_from_sketches_alone(spark, sf_dir, capsys):
    path = scratch(spark, "sketches")
    days = stored.daily_sketches(read(spark, sf_dir, "events"), path)
    plan = plan_of(stored.merged(days, F.month("day")), capsys)
    assert path.removeprefix("file://") in plan and "events.parquet" not in plan
    assert days.count() == read(spark, sf_dir, "events").select(F.to_date("ts")).distinct().count()


def test_objects_are_left_out_before_they_are_opened(spark, capsys):
    path = scratch(spark, "objects")
    spark.createDataFrame([(k, "x" * 10 * k) for k in range(1, 9)], "page_id long, value string").write.partitionBy("page_id").text(path)
    some = objects(spark.read, path).where("length > 40 and page_id > 2")
    plan = plan_of(some, capsys)
    assert "GreaterThan(length,40)" in plan and "page_id" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert {(r.page_id, r.length) for r in some.collect()} == {(k, 10 * k + 1) for k in range(4, 9)}


def test_pages_share_objects_and_come_back_whole(spark):
    """Line ends, quotes, marks and missing texts; fewer objects than pages."""
    rows = [(k, t * k) for k, t in enumerate(["", "a\n\r\n", '"\\', "\u00e9\u2028\u0000", "\U0001f600", " x "])] + [(9, None)] + [(k, "page" * 9) for k in range(10, 300)]
    for most, files_ in ((400, range(9, 40)), (5_000, range(1, 10))):
        path = scratch(spark, "objects")
        stored.put_pages(spark.createDataFrame(rows, "page_id long, html string"), path, most)
        made = objects(spark.read, path, folders="")
        assert made.count() in files_
        assert sorted(map(tuple, stored.pages_of(made).collect())) == rows


def test_pages_near_the_limit_of_length(spark, tmp_path, duck):
    """Pages of 1,999 and 2,000 bytes, in letters of one and two bytes, both halves."""
    rows = [(k, letter * n) for k, (letter, n) in enumerate([("a", 1999), ("a", 1999), ("a", 2000), ("a", 2000), ("\u00e9", 999), ("\u00e9", 1000), ("b", 9000), ("\n", 2000)])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = stored.STORED["d06_page_objects"][1].replace("from pages", f"from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for most in (4_000, stored.OBJECT):
        got = stored.page_objects(spark, str(tmp_path), most).select("page_id", "length", "digest", "batch")
        assert sorted(map(tuple, got.collect())) == sorted(duck.execute(sql).fetchall())


def test_a_stopped_backlog_goes_on(spark, sf_dir):
    got = stored.backlog(spark, sf_dir, files=5, stop_after=3).collect()
    assert {r.batches for r in got} <= set(range(1, 6)) and max(r.batches for r in got) == 5
    assert sum(r.n for r in got) == sum(r.events for r in got) == read(spark, sf_dir, "events").count()


@pytest.mark.parametrize("stop", [True, False])
def test_temporary_folders_go_with_the_driver(tmp_path, stop):
    """Also where the session is stopped first, as scripts do."""
    code = f"""
from loomline.session import build_session
from loomline.sources.tables import round_trip
spark = build_session("local[1]", "ends", 1, spark__checkpoint__dir="file://{tmp_path}")
assert round_trip(spark.range(3), "orc").count() == 3
try:
    from loomline.llm.workspace import Workspace
    Workspace(spark, "w").write(spark.range(2), "t")
except ModuleNotFoundError:
    pass
import os
assert os.listdir("{tmp_path}")
{"spark.stop()" if stop else ""}
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=120)
    assert [x for x in os.listdir(tmp_path) if x.startswith(("orc-", "w-"))] == []  # Spark makes an empty folder of its own


def test_all_stored_queries_are_registered():
    assert set(stored.STORED) <= set(QUERIES)
