"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows of a key range, about.
RANGE = 4000


def words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of a table of sources (source, source_size).

    Weights go round the sources in code-point order, null last. Together the
    sources get ``share`` of all words, by weight; a source whose part would exceed
    ``most`` times its size gets that, and the excess goes to the others by weight.
    With sources ordered by how early they fill up, the level at which the k
    fullest are capped follows from running sums, so no loop is needed. The table
    has a row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    table = sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("fills", F.col("cap") / F.col("w"))
    order = W.orderBy("fills", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = table.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(share),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    # The level if this source and all that fill up later are below their caps; the first source that stays below its cap sets it.
    table = table.withColumns({"level": (F.col("total") - F.col("capped")) / F.col("open"), "place": F.row_number().over(order)})
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("place", "level"))).over(every)["level"]
    return table.withColumn("at", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", F.least(F.col("cap"), F.col("at") * F.col("w")).alias("target"))


def random_key(epoch: Column) -> Column:
    """60 hash bits of doc_id and epoch: each epoch has an order of its own, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), epoch.cast("string"))), 1, 15), 16, 10).cast("long")


def _link(source: Column) -> Column:
    """A source as a key that null has too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _placed(docs: DataFrame, work: Workspace, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """A row per row of ``docs`` with its source's budget and with ``left``, the words that the last epoch still has at its place."""
    sized = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("print"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    sized = work.write(sized, "sizes")
    per = work.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    ranges = 1 << max(0, (sized.count() // RANGE).bit_length())
    rows = sized.withColumn("link", _link(F.col("source")))
    per = per.withColumns({"link": _link(F.col("source")), "budget": F.floor("target")}).withColumn("whole", F.expr(f"case when source_size = 0 then 0L else least(budget div source_size, {int(most)}L) end"))
    rows = rows.join(per.drop("source"), "link")
    rows = rows.withColumn("key", random_key(F.col("whole"))).withColumn("range", F.shiftright("key", 60 - (ranges.bit_length() - 1)))
    rows = work.write(rows, "keyed")
    sums = rows.groupBy("link", "range").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("link").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("link", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("link", "range").orderBy("key", "doc_id", "print").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.col("whole") * F.col("source_size") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    return rows.join(sums, ["link", "range"]).withColumn("left", left)


def mixture(docs: DataFrame, work: Workspace, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, print, size, source, source_size, target, taken), one row per row of ``docs``; print is a hash of the text.

    A source's whole epochs take each of its documents once. Its last epoch takes
    documents in hash order up to the exact budget (the target rounded down); of
    the document at the cut only the words before it. The order within a source is
    held in key ranges of some RANGE rows: the sums of the ranges before a range
    and the running sum within it give each row's place, so a hot source spreads
    over many tasks.

    Null text has no words; a null source is a source of its own; sizes of zero
    take nothing. Rows that repeat a doc_id follow each other in any order, with
    the same sum. An empty table gives an empty result.
    """
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    return _placed(docs, work, share, most, weights).select("doc_id", "print", "size", "source", "source_size", "target", taken.alias("taken"))


def cuts(docs: DataFrame, work: Workspace, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per source: its whole epochs and the row at which its last one ends, by key, doc_id and print.

    ``left`` is the number of words that this row gives; ``same`` rows are equal to
    it in all three, ``full`` of them before it.
    """
    placed = _placed(docs, work, share, most, weights)
    place = F.struct("key", "doc_id", "print")
    ends = (F.col("left") >= 0) & (F.col("left") < F.col("size"))
    # One row of a source, or none where it has no words.
    at = work.write(placed.groupBy("link").agg(F.max("whole").alias("whole"), F.max(F.when(ends, F.struct("left", place.alias("cut")))).alias("end")), "ends")
    near = placed.select("link", "left", place.alias("place")).join(at.select("link", "end"), "link").where("place <=> end.cut")
    near = near.groupBy("link").agg(F.count("*").alias("same"), F.count(F.when(F.col("left") > F.col("end.left"), 1)).alias("full"))
    return work.write(at.join(near, "link", "left").select("link", "whole", "end.cut", "end.left", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("full", F.lit(0)).alias("full")), "cuts")


def mixed(docs: DataFrame, work: Workspace, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one for each whole repeat, and for the document at a cut its first words.

    A row tells from its own key and the cut of its source what it gives, so no
    text moves. Of rows that repeat both doc_id and text at a cut, the other
    columns are those of one of them.
    """
    table = cuts(docs, work, share, most, weights).withColumnRenamed("link", "_to")
    # The row as one value: no column of its own can clash with the others.
    row = F.struct(*docs.columns).alias("row")
    own = docs.select(row, words(F.col("text")).alias("size"), F.xxhash64("text").alias("print"), F.col("doc_id").cast("long").alias("doc_id"), _link(F.col("source")).alias("link")).where("size > 0")
    # A row a source: Spark sends it to all tasks where it is below its broadcast limit.
    own = own.join(table, F.col("link") == F.col("_to")).withColumn("place", F.struct(random_key(F.col("whole")).alias("key"), "doc_id", "print"))
    at = F.coalesce(F.col("place") == F.col("cut"), F.lit(False))
    rounds = lambda n, k: F.flatten(F.array(F.array_repeat(F.col("size"), n.cast("int")), F.when(k > 0, F.array(k)).otherwise(F.array().cast("array<bigint>"))))
    more = F.when(F.col("place") < F.col("cut"), F.col("size")).when(at, F.col("left")).otherwise(F.lit(0).cast("long"))
    given = own.where(~(at & (F.col("same") > 1))).select("row", "size", rounds(F.col("whole"), more).alias("words"))
    if table.where("same > 1").head(1):
        equal = own.where(at & (F.col("same") > 1)).groupBy("link").agg(F.first("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "whole", "same", "full", "left")])
        given = given.unionByName(equal.select("row", "size", rounds(F.col("whole") * F.col("same") + F.col("full"), F.col("left")).alias("words")))
    given = given.withColumn("words", F.explode("words"))
    size = F.col("size")
    text = F.when(F.col("words") >= size, F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("words")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("words") >= size, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return given.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, white space between them as it stands there."""
    words_ = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(words_, F.lit(1), n.cast("int")), "")
