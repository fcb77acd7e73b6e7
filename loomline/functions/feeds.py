"""RSS feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "channel struct<title: string, item: array<struct<title: string, link: string, pubDate: string>>>"


def feed_items(xml: Column) -> Column:
    """The items of a feed as an array of (title, link, published), missing fields null; null where the XML is malformed or null."""
    items = F.from_xml(xml, SCHEMA, {"mode": "PERMISSIVE"})["channel"]["item"]
    return F.transform(items, lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), F.try_to_timestamp(i["pubDate"], F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz").alias("published")))
