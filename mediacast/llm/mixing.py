"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The points of a van der Corput sequence are mapped through the cumulative targets of the sources: slot ``i`` belongs to
the source whose interval holds ``bits of i reversed / 2^k``. Slots are ranked per source. The documents of a source,
in a shuffled order, form one stream of words that is cut into blocks of equal size and starts again when it ends; the
slot of rank ``r`` takes block ``r``. The last slot of a source ends where its target does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 256
BUCKETS = 4096


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(id, source, size)``: the number of words, 0 for null."""
    return docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``(source, number, source_size, target)``, one row per source, null being one.

    Sources in code point order, null last, take the weights in turn. A target stops at ``repeats`` times the source's
    size and the rest is shared by weight again: the sources sorted by size per weight are full up to the first whose
    share of what is left fits. These windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "number")
    total = F.sum("source_size").over(Window.partitionBy())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("budget", total * float(share))
        .withColumn("weight", weight)
        .withColumn("most", (F.col("source_size") * repeats).cast("double"))
        .withColumn("room", F.col("most") / F.col("weight"))
    )
    left = F.col("budget") - F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = table.withColumn("level", left / weights_left)
    first_fit = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "number", "level"))).over(Window.partitionBy())
    fits = first_fit["level"]
    return level.select(
        "source", "number", "source_size", F.least("most", F.coalesce(fits, F.lit(0.0)) * F.col("weight")).alias("target")
    )


def _running(df: DataFrame, group: str, order: list, bucket: Column, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the earlier rows of the group, by way of bounded buckets, so that no large group is one task.

    Buckets have to follow the order. A group has at most ``BUCKETS`` of them.
    """
    with_bucket = df.withColumn("bucket", bucket)
    totals = with_bucket.groupBy(group, "bucket").agg(F.sum(amount).alias("amount"))
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "bucket", F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_bucket.join(offsets, [group, "bucket"])
        .withColumn(name, F.col("offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("bucket", "offset")
    )


def streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with words at their place ``start`` in the shuffled stream of their source."""
    label = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    own = sizes.where("size > 0").join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    shuffled = own.withColumn("label", label)
    bucket = F.conv(F.substring("label", 1, 3), 16, 10).cast("int")
    return _running(shuffled, "number", ["label", "id", "size"], bucket, F.col("size"), "start").drop("label")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """The mix in order: ``(slot, number, rank, first, last)``, and the words of a block.

    ``first`` and ``last`` bound the words of the source's stream, counted on over its repetitions, that a slot takes.
    There are as many slots as blocks of words in the mix, so the points are dealt out over tasks, and slots and schedule are
    written: Spark cannot tell the size of rows that come from a few ranges, and would send them all by way of the driver.
    """
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    bits = max(0, math.ceil(math.log2(max(budget / block_words, 1))))
    points, block = 1 << bits, max(1, math.ceil(budget / (1 << bits)))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.least(F.round(F.sum("target").over(before) / max(budget, 1.0) * points), F.lit(points)).cast("long")
    cut = (
        targets.withColumn("hi", ends)
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("number")), F.lit(0)))
        .withColumn("hi", F.greatest("hi", F.col("lo") + 1))  # a source that has a target has a slot
        .withColumn("goal", F.floor(F.col("target") + 1e-6))
        .where("goal > 0")
    )
    step = 1 << 16
    pieces = cut.select("number", "lo", "hi", "goal", F.explode(F.expr(f"sequence(lo div {step}, (hi - 1) div {step})")).alias("piece"))
    tasks = min(math.ceil(points / step), int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.repartition(tasks) if tasks > 1 else pieces
    grid = pieces.select(
        "number", F.col("hi") - F.col("lo"), "goal",
        F.explode(F.expr(f"sequence(greatest(lo, piece * {step}), least(hi, (piece + 1) * {step}) - 1)")).alias("point"),
    ).toDF("number", "slots", "goal", "point")
    reverse = F.conv(F.reverse(F.lpad(F.bin("point"), max(bits, 1), "0")), 2, 10).cast("long")
    slots = stage(grid.withColumn("slot", reverse).drop("point"), "slots")
    bucket = F.shiftright("slot", max(bits - 12, 0)).cast("int")
    ranked = _running(slots, "number", ["slot"], bucket, F.lit(1), "rank")
    first = F.col("rank") * block
    last = F.when(F.col("rank") == F.col("slots") - 1, F.col("goal")).otherwise(F.least(first + block, "goal"))
    rows = ranked.select("slot", "number", "rank", first.alias("first"), last.alias("last")).where("first < last")
    return stage(rows, "schedule"), block


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, size, source_size, target, taken)`` for every row: how many of its words the mix takes, repeats counted.

    Null and empty texts have size 0 and give nothing. Null is a source of its own. A mix of empty sources is empty.
    Rows that repeat a key keep their own places in the stream, next to each other. Other columns are not read. Runs agree,
    because the shuffled order is a function of the keys.
    """
    sizes = stage(sized(docs, key, text, source), "sizes")
    targets = stage(source_targets(sizes), "targets")
    slots, block = schedule(targets)
    stream = streams(sizes, targets)
    passes = stream.withColumn("turn", F.explode(F.expr(f"sequence(0, {REPEATS - 1})"))).withColumn(
        "from", F.col("start") + F.col("turn") * F.col("source_size")
    )
    # the slot of the highest rank may reach one block further
    parts = passes.withColumn(
        "rank", F.explode(F.expr(f"sequence(greatest(`from` div {block} - 1, 0), (`from` + size - 1) div {block})"))
    )
    overlap = F.least(F.col("from") + F.col("size"), "last") - F.greatest("from", "first")
    taken = F.when(F.col("first").isNotNull() & (overlap > 0), overlap).otherwise(0)
    found = (
        parts.join(slots, ["number", "rank"], "left")
        .groupBy("id", "number", "start", "size", "source_size", "target")
        .agg(F.sum(taken).alias("taken"))
        .select("id", "size", "source_size", "target", "taken")
    )
    empty = sizes.where("size = 0").join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
    rows = found.unionByName(empty.select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return rows.withColumnRenamed("id", key)
