"""Filter interaction audit: what every filter removes in every order of the filters, by a recursive query over orders.

Each document becomes a mask with one bit per failing filter. Documents are counted by part and mask, so all that follows
works on at most 2^filters cells a part. A recursive common table expression starts with the empty prefix and extends every
prefix by each letter it does not use yet: the step joins the cells of the part, carries the bits applied so far and emits the
metrics of the letter just added. Orders then take their steps from the prefixes they begin with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.session import stage

LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITAL_PERCENT = 5

_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: bytes) -> int:
    """Bits of A (few words), B (repetitive), C (capitals) and D (marks) for the whole text."""
    words = text.split()
    characters = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITAL_PERCENT * characters) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``(id, part, mask, digest)`` of every row; the text stays where it is read."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column("text"):
                own = value.as_buffer().to_pybytes() if value.is_valid else b""
                masks.append(text_mask(own))
                digests.append(hashlib.sha256(own).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "part", "mask", "digest"],
            )

    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("text")
    )
    return rows.mapInArrow(measure, f"id {docs.schema[key].dataType.simpleString()}, part string, mask int, digest binary")


def _marked(label: str) -> Column:
    return F.coalesce(F.max(F.col(label) == 1), F.lit(False)).alias(label)


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(part, cells)``: per part the counts ``(mask, docs, good, toxic)`` of each mask that occurs.

    The last bit, copies, compares digests: a text is a copy if a smaller key of the table has the same one. Rows are
    added up by digest before and after the labels are joined, so a large group of copies reaches no task as rows. Rows
    without a key have no label, are no copies and have none.
    """
    rows = _measured(docs, key, text, part).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("docs"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("its")).agg(_marked("quality"), _marked("toxic"))
    # rows without a key are dealt by their digest
    place = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("id"))
    labelled = (
        rows.withColumn("place", place)
        .join(known.withColumn("its_place", F.xxhash64("its")), (F.col("place") == F.col("its_place")) & (F.col("id") == F.col("its")), "left")
        .select("id", "digest", "part", "mask", "docs", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("bad"))
    )
    # every key is in a group once
    groups = stage(
        labelled.groupBy("digest", "part", "mask", "good", "bad").agg(
            F.sum("docs").alias("docs"),
            F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("docs"))), F.lit(0)).alias("unnamed"),
            F.min(F.when(F.col("id").isNotNull(), F.struct("id", "docs"))).alias("first"),
        ),
        "audit-groups",
    )
    several = groups.groupBy("digest").agg(F.min("first.id").alias("least"), F.sum("docs").alias("all")).where("all > 1")
    alone = F.when(F.col("least").isNull(), F.col("docs")).otherwise(
        F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.docs")).otherwise(0)
    )
    split = groups.join(several.select("digest", "least"), "digest", "left").withColumn("alone", F.coalesce(alone, F.lit(0)))
    first = F.struct("mask", F.col("alone").alias("docs"))
    copies = F.struct((F.col("mask") + 16).alias("mask"), (F.col("docs") - F.col("alone")).alias("docs"))
    either = split.select("part", "good", "bad", F.explode(F.array(first, copies)).alias("its"))
    cells = (
        either.where("its.docs > 0")
        .groupBy("part", F.col("its.mask").alias("mask"))
        .agg(
            F.sum("its.docs").alias("docs"),
            F.sum(F.when(F.col("good"), F.col("its.docs")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("bad"), F.col("its.docs")).otherwise(0)).alias("toxic"),
        )
    )
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "docs", "good", "toxic"))).alias("cells"))


def _summed(measure: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (a, x) -> a + if({condition}, x.{measure}, 0L))"


def prefix_steps(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """``(part, prefix, step, letter, metrics...)`` for every prefix of every order, by recursion over the prefixes."""
    filters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    passing, fails = "(x.mask & s.applied) = 0", "(x.mask & l.bit) <> 0"
    kept = _summed("docs", "(x.mask & (s.applied | l.bit)) = 0")
    removed, redundant = _summed("docs", f"{passing} AND {fails}"), _summed("docs", f"NOT {passing} AND {fails}")
    unique = _summed("docs", "x.mask = l.bit")
    good, toxic = _summed("good", f"{passing} AND {fails}"), _summed("toxic", f"{passing} AND {fails}")
    return cells.sparkSession.sql(
        f"""
        WITH RECURSIVE filters AS (SELECT * FROM VALUES {filters} AS f(letter, bit)),
        steps(part, prefix, step, letter, applied, {", ".join(METRICS)}) AS (
          SELECT part, '', 0, '', 0, {", ".join(["0L"] * len(METRICS))} FROM {{cells}}
          UNION ALL
          SELECT s.part, concat(s.prefix, l.letter), s.step + 1, l.letter, s.applied | l.bit, {kept}, {removed}, {redundant}, {unique}, {good}, {toxic}
          FROM steps s JOIN filters l ON (s.applied & l.bit) = 0 JOIN {{cells}} c ON c.part = s.part
        )
        SELECT part, prefix, step, letter, {", ".join(METRICS)} FROM steps WHERE step > 0 LIMIT ALL
        """,
        cells=cells,
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``.

    A null text is empty and fails A; a null part is the empty part. Rows that repeat count each; rows of one key
    with the same text are no copies of each other. Labels of a key count if any of its rows has them. An empty table gives no rows. Other columns are not read.
    The result has orders times filters rows a part, whatever the size of the table.
    """
    cells = stage(mask_cells(docs, labels, key, text, part), "audit-cells")
    steps = stage(prefix_steps(cells), "audit-steps")
    n = len(LETTERS)
    through = F.element_at(F.array(*[F.lit(math.factorial(n - i)) for i in range(1, n + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * through).alias("shapley"))
    orders = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    rows = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step"))).join(steps.drop("step"), ["part", "prefix"])
    return rows.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley")
