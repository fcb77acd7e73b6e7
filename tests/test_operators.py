"""Operators and functions on small made-up rows: ties, nulls, empty sides."""

from __future__ import annotations

import html
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.functions import cosine, feed_items
from loomline.functions.html import text_of
from loomline.operators import as_of_join, distinct_on, interval_join, unpivot
from loomline.registry import QUERIES
from loomline.sources import read
from loomline.sources.tables import scratch
from loomline.streaming.queries import drain, emitted

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k long, ts timestamp_ntz, v double"


def rows(spark, *items):
    return spark.createDataFrame([(i, k, None if s is None else T0 + timedelta(seconds=s), v) for i, k, s, v in items], SCHEMA)


def test_as_of_ties_nulls_and_missing(spark):
    left = rows(spark, (1, 1, 10, 0.0), (2, 1, 5, 0.0), (3, 2, 10, 0.0), (4, None, 10, 0.0), (5, 1, 20, 0.0))
    right = rows(spark, (10, 1, 10, 1.0), (11, 1, 10, 2.0), (12, 1, 12, 3.0), (13, None, 1, 4.0), (14, 1, None, 9.0))
    got = {r.id: r.last_v for r in as_of_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None, 5: 3.0}


def test_as_of_empty_right(spark):
    left = rows(spark, (1, 1, 10, 0.0))
    assert [r.last_v for r in as_of_join(left, left.limit(0), ["k"], "ts", ["v"]).collect()] == [None]


@pytest.mark.parametrize("span", [7, 60, 10_000])
def test_as_of_over_ranges_matches_brute_force(spark, span):
    """Few keys over many time ranges: what a range begins with is carried over its border, also over ranges without rows."""
    left = [(i, i % 3 if i % 11 else None, (i * 37) % 400 if i % 13 else None, 0.0) for i in range(90)]
    right = [(100 + i, i % 2, (i * 53) % 300, float(i)) for i in range(12)]
    got = {r.id: r.last_v for r in as_of_join(rows(spark, *left), rows(spark, *right), ["k"], "ts", ["v"], span=span).collect()}
    want = {}
    for i, k, s, _ in left:
        earlier = [(b[2], b[3]) for b in right if None not in (k, s) and b[1] == k and b[2] <= s]
        want[i] = max(earlier)[1] if earlier else None
    assert got == want


def test_interval_join_matches_brute_force(spark):
    left = [(i, i % 3, (i * 37) % 500, 0.0) for i in range(60)]
    right = [(100 + i, i % 3, (i * 53) % 500, 0.0) for i in range(60)]
    got = {(r.id, r.r_id) for r in interval_join(rows(spark, *left), rows(spark, *right), ["k"], "ts", "ts", 30).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and 0 <= b[2] - a[2] <= 30}


def test_distinct_on_and_unpivot(spark):
    df = rows(spark, (1, 1, 5, 1.0), (2, 1, 3, 2.0), (3, None, 1, 3.0))
    assert {r.id for r in distinct_on(df, ["k"], [F.col("ts")]).collect()} == {2, 3}
    assert unpivot(df.select("id", "v", F.col("v").alias("w")), ["id"], ["v", "w"], "name", "value").count() == 6


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_feed_items(spark):
    feeds = ["<rss><channel><item><title>a &amp; b</title><link>u</link><pubDate>03 Jan 2024 08:00:00</pubDate></item><item><title>c</title><pubDate>soon</pubDate></item></channel></rss>", "<rss><channel><item><title>a</ti", None, "", "<rss><channel></channel></rss>"]
    df = spark.createDataFrame(list(enumerate(feeds)), "k int, xml string")
    got = {r.k: r.found and [tuple(i) for i in r.found] for r in df.select("k", feed_items(F.col("xml")).alias("found")).collect()}
    assert got == {0: [("a & b", "u", datetime(2024, 1, 3, 8)), ("c", None, None)], 1: None, 2: None, 3: None, 4: None}


@pytest.mark.parametrize(("name", "node"), [("b15_join_hints", "ShuffledHashJoin"), ("b15_join_hints", "BroadcastHashJoin"), ("b15_merge_hint", "SortMergeJoin"), ("b15_replicate_hint", "CartesianProduct"), ("b10_theta_join", "BroadcastNestedLoopJoin")])
def test_join_hints_reach_the_plan(spark, sf_dir, capsys, name, node):
    QUERIES[name](spark, sf_dir).explain()
    assert node in capsys.readouterr().out


def test_a_retried_batch_replaces_what_it_wrote(spark):
    """Two streams over the same files with the same batch number and one output: the rows are there once."""
    source, out = scratch(spark, "source"), scratch(spark, "out")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    for _ in range(2):
        drain(stream, "append", out, scratch(spark, "state"))
    assert emitted(spark, stream, "append", out).count() == 5


def test_page_text():
    page = "<html><head><title>t</title><script>var a = '</p>';</script><style>p{}</style></head><body><p>One <b>two<p>three &amp; four<br>five</body></html>"
    assert text_of(page) == "One two\nthree & four\nfive"
    assert text_of("") == "" and text_of(None) is None


def test_page_texts_against_an_independent_reading(spark, sf_dir):
    """All pages: no script or style text, all words outside them in order, those with marks within them in one piece."""

    def words(page):
        for pattern, by in ((r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</?(b|i|a|em|strong|span)\b[^>]*>", ""), (r"<[^>]*>", " ")):
            page = re.sub(pattern, by, page)
        return html.unescape(page).split()

    pages = {r.page_id: r.html for r in read(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r.text for r in QUERIES["b54_page_text"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys() and len(got) >= 50
    assert all(got[k].split() == words(p) for k, p in pages.items())


@pytest.mark.parametrize(("x", "y", "want"), [("", "", 0), ("", "abc", 3), ("abc", "", 3), ("ab", "ba", 1), ("ca", "abc", 2), ("kitten", "sitting", 3), ("aa", "aa", 0)])
def test_edits_with_swaps(x, y, want):
    from loomline.plans.frames import edits

    assert edits(x, y) == edits(y, x) == want
