"""N-gram Jaccard join by vertical partitioning of the global shingle order.

The global order puts rare shingles first: by the logarithm of the number of documents that hold them, then by
hash. It is found by cutting the hash range into fragments and counting each on its own. A pair at or above the
threshold shares a shingle among the first ``n - ceil(t n) + 1`` of both texts, so only these prefixes are shuffled.
Most candidates share a common phrase and little else, and their number grows faster than the texts; the parities of their
shingles, about two bits for each, bound the overlap from above and decide them. What is left is counted exactly: every set
is cut into the fragments of the order, each fragment counts the overlap of a pair on its own, and the partial counts are
added up per pair.

Texts with the same set are one node. In a group of nodes that share a prefix shingle every node is compared with the
most ordinary one, which has the smallest share of rare shingles: of the versions of a text, that is the least edited.
Groups that are then still of several components compare the nodes outside that leader's component with all others,
except for pairs that bounds exclude: sizes, the shorter prefix that is enough for the smaller text of a pair, and the
distances of both to the leader (one minus Jaccard obeys the triangle inequality). Whatever else is left out lies inside
one component already, so components are exact and the counted pairs stay about linear in the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.llm.components import components
from mediacast.llm.word_hashes import mixed, shingle_sets
from mediacast.session import bounded_batches, stage, unstage

WORDS = 5
PERCENT = 80
LEAST_FREQUENT = 8
#: Bound of the table of frequent shingles that goes to every task: 12 bytes each.
MOST_FREQUENT_SHINGLES = 1 << 20
FLUSH = 2_000_000
SEGMENTS = 8
#: Shingles of at least 2^HOT_LEVEL documents find their leader by aggregation.
HOT_LEVEL = 12
#: The prefix shingles are shuffled in so many parts of the hash range, one after the other; a power of two.
ROUNDS = 4
BROADCAST_IDS = 500_000


# blobs of sorted 32-bit numbers ---------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


# the global order -----------------------------------------------------------------------------


def fragment_bits(docs: DataFrame) -> int:
    """Fragments follow the shuffle partitions of the session, which follow the input."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(math.ceil(math.log2(4 * partitions)), 6), 20)


def frequent_shingles(docs: DataFrame, text: str, words: int = WORDS, least: int = LEAST_FREQUENT) -> DataFrame:
    """``(key, level)``: shortened shingle hashes of at least ``least`` documents and the log2 of their number.

    Every task counts its own documents first and sends one packed row per fragment.
    """
    bits = fragment_bits(docs)

    def flushed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(held)
        held.clear()
        whole.sort()
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        keys, counts = whole[first], np.diff(first, append=len(whole))
        bounds = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        rows = [i for i in range(1 << bits) if bounds[i] < bounds[i + 1]]
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        parts = [slice(bounds[i], bounds[i + 1]) for i in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([_packed(np.diff(low[p], prepend=np.uint32(0))) for p in parts], pa.binary()),
                pa.array([_packed(counts[p]) for p in parts], pa.binary()),
            ],
            names=["fragment", "keys", "counts"],
        )

    def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), words):
                held.append(own >> np.uint64(32 - bits))
                size += len(own)
                if size > FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)

    def frequent(table: pa.Table) -> pa.Table:
        fragment = table.column("fragment")[0].as_py()
        keys = np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint32) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        totals = np.add.reduceat(counts, first)
        kept = totals >= least
        key = (np.int64(fragment) << 32) | keys[first][kept].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "level": pa.array(np.log2(totals[kept]).astype(np.int32), pa.int32())})

    blobs = docs.select(F.col(text).alias("text")).mapInArrow(local_counts, "fragment int, keys binary, counts binary")
    return blobs.groupBy("fragment").applyInArrow(frequent, "key long, level int")


def bounded_order(frequent: DataFrame, most: int = MOST_FREQUENT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles that matter most to the order, at most ``most``: whole levels from the top.

    Any order gives the same links; leaving out lower levels only makes prefixes meet more often.
    """
    levels = {row["level"]: row["count"] for row in frequent.groupBy("level").count().collect()}
    least, total = 1 + max(levels, default=0), 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    table = frequent.where(F.col("level") >= least).toArrow()
    keys, ranks = table.column("key").to_numpy().astype(np.uint64), table.column("level").to_numpy()
    order = np.argsort(keys)
    return keys[order], ranks[order]


# sets, prefixes, segments ---------------------------------------------------------------------


def _set_keys(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        total = mixed(own).sum(dtype=np.uint64)
        other = mixed(own ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(total.view(np.int64)), int(other.view(np.int64))


def _parities(own: np.ndarray) -> np.ndarray:
    """Bits, at least as many as shingles and a power of two, each the parity of the number of shingles that fall on it.

    What two sets share falls out of the difference of theirs. The first half XOR the second is the table of half the size.
    """
    size = max(64, 1 << (len(own) - 1).bit_length())
    counts = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").view(np.int64)


def text_sets(docs: DataFrame, key: str, text: str, order: tuple[np.ndarray, np.ndarray], words: int = WORDS) -> DataFrame:
    """``(id, n, rare, k1, k2, hot, prefix, parities)`` per row.

    Size of the shingle set, the share of it in per mille that is not frequent, two hashes of it, its prefix, whose
    shingles are hot from place ``hot`` on, and its parities.
    """
    bits = fragment_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def prefix(own: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int, int]:
        count = len(own) - (PERCENT * len(own) + 99) // 100 + 1
        if not len(keys):
            return own[:count], 1000, count
        short = own >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        level = np.where(keys[at] == short, ranks[at], 0)
        front = np.argsort(level, kind="stable")[:count]
        return own[front], int(1000 * np.count_nonzero(level == 0) // len(own)), int(np.searchsorted(level[front], HOT_LEVEL))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, rare, one, two, hot, prefixes, bits_of = [], [], [], [], [], [], []
            for _, own in shingle_sets(batch.column(1), words):
                a, b = _set_keys(own)
                sizes.append(len(own))
                one.append(a)
                two.append(b)
                front, share, cool = prefix(own, keys, ranks) if len(own) else (None, 1000, 0)
                rare.append(share)
                hot.append(cool)
                prefixes.append(none if front is None else front.view(np.int64))
                bits_of.append(_parities(own) if len(own) else none)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(rare, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                    pa.array(hot, pa.int32()), lists(prefixes), lists(bits_of),
                ],
                names=["id", "n", "rare", "k1", "k2", "hot", "prefix", "parities"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        sets, "id long, n long, rare int, k1 long, k2 long, hot int, prefix array<long>, parities array<long>"
    )


def text_segments(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``(node, segment, hashes)``: the shingle set of every row cut at fixed places of the hash range."""
    shift = np.uint64(64 - int(math.log2(SEGMENTS)))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, numbers, parts = [], [], []
            for _, own in shingle_sets(batch.column(0), words):
                bounds = np.searchsorted(own >> shift, np.arange(SEGMENTS + 1, dtype=np.uint64))
                node = _set_keys(own)[0]
                for i in range(SEGMENTS):
                    if bounds[i] < bounds[i + 1]:
                        nodes.append(node)
                        numbers.append(i)
                        parts.append(own[bounds[i] : bounds[i + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))],
                names=["node", "segment", "hashes"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(segments, "node long, segment int, hashes array<long>")


# candidates and links -------------------------------------------------------------------------


def _size_fits(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _meets(an: Column, a_place: Column, bn: Column, b_place: Column) -> Column:
    """Whether a shared shingle at these places of both prefixes can be the first one that a linked pair shares.

    The larger text needs its whole prefix. Of the smaller one, with at most as many shingles, the overlap has to be
    ``2 t / (1 + t)``, so a shorter prefix is enough.
    """

    def enough(n: Column, place: Column) -> Column:
        return place < n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT) - 1e-9) + 1

    return _size_fits(an, bn) & F.when(an <= bn, enough(an, a_place)).otherwise(enough(bn, b_place))


def shared_prefixes(nodes: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """``(shingle, leader, leader_n, leader_place, node, n, place)``: the nodes of every prefix shingle behind its leader.

    Of ``parts`` parts of all shingles, only one. Most prefix shingles stand in one node; while they are sought out, their
    shuffle is larger than the input.

    The leader is the node of the smallest ``rare``, then id. Groups below the hot level are windows, read in order. Of a hot
    shingle, which may stand in a third of all nodes, every task sends its own least node, and a join that may be split
    deals the leader out.
    """
    postings = nodes.select("node", "n", "rare", "hot", F.posexplode("prefix").alias("place", "shingle"))
    postings = postings.where(F.col("shingle").bitwiseAND(F.lit(parts - 1)) == part)
    running = Window.partitionBy("shingle").orderBy("rare", "node").rowsBetween(Window.unboundedPreceding, 0)
    member = ["shingle", "node", "n", "place"]
    led = postings.where("place < hot").select(*member, F.first(F.struct("node", "n", "place")).over(running).alias("first"))
    hot = postings.where("place >= hot")
    least = hot.groupBy("shingle").agg(F.min(F.struct("rare", "node", "n", "place")).alias("least"))
    led_hot = hot.join(least, "shingle").select(*member, F.struct("least.node", "least.n", "least.place").alias("first"))
    return led.unionByName(led_hot).select(
        "shingle", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), F.col("first.place").alias("leader_place"),
        "node", "n", "place",
    ).where("leader <> node")


def _similar(overlap: Column) -> Column:
    return overlap * 100 >= (F.col("an") + F.col("bn") - overlap) * PERCENT


def _distance(overlap: Column) -> Column:
    return 1 - overlap / (F.col("an") + F.col("bn") - overlap)


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b, an, bn)`` with ``most``, which their overlap does not exceed, from the parities of both.

    Every differing bit needs a shingle that only one of them has. The sizes of a pair fit, so one table is at most twice as long.
    """
    xor = lambda x, y: x.bitwiseXOR(y)
    left, right = nodes.select(F.col("node").alias("a"), F.col("parities").alias("left")), nodes.select(F.col("node").alias("b"), F.col("parities").alias("right"))

    def folded(x: Column, y: Column) -> Column:
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(x)

    x, y = F.col("left"), F.col("right")
    bits = F.transform(F.zip_with(folded(x, y), folded(y, x), xor), F.bit_count)
    differing = F.aggregate(bits, F.lit(0).cast("long"), lambda total, more: total + more)
    most = F.floor((F.col("an") + F.col("bn") - differing) / 2)
    return pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", most.alias("most"))


def overlaps(docs: DataFrame, key: str, text: str, pairs: DataFrame, owners: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs ``(a, b, an, bn)`` with a shared shingle and their ``overlap``, added up over the segments."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = stage(needed.join(owners, "node").select("id").distinct(), "texts-of-pairs")
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    parts = stage(text_segments(rows, "id", "text", words), "segments")
    cut = pairs.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    left = parts.select(F.col("node").alias("a"), "segment", F.col("hashes").alias("left"))
    right = parts.select(F.col("node").alias("b"), "segment", F.col("hashes").alias("right"))
    partial = (
        cut.join(left, ["a", "segment"])
        .join(right, ["b", "segment"])
        .select("a", "b", "an", "bn", "segment", F.size(F.array_intersect("left", "right")).alias("overlap"))
        .groupBy("a", "b", "an", "bn", "segment")
        .agg(F.max("overlap").alias("overlap"))  # repeated rows bring the same segment again
    )
    return partial.groupBy("a", "b", "an", "bn").agg(F.sum("overlap").alias("overlap"))


def links_of(counted: DataFrame) -> DataFrame:
    return counted.where(_similar(F.col("overlap"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _unsettled(apart: DataFrame, judged: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs of different components that share a prefix shingle, were not judged and no bound excludes.

    A node is at least ``near`` and at most ``far`` from its leader, both its distance if the pair was counted.
    """
    exact = judged.join(counted.select("a", "b", "overlap"), ["a", "b"], "left")
    distance = exact.select(
        F.col("a").alias("leader"), F.col("b").alias("node"), _distance(F.coalesce("overlap", "most")).alias("near"),
        F.coalesce(_distance(F.col("overlap")), F.lit(1.0)).alias("far"),
    )
    odd = stage(apart.where("c <> leader_c").join(distance, ["leader", "node"], "left"), "unsettled")
    within = apart.join(odd.select("shingle").distinct(), "shingle", "left_semi").join(distance, ["leader", "node"], "left")
    leaders = within.select(
        "shingle", F.col("leader").alias("node"), F.col("leader_n").alias("n"), F.col("leader_place").alias("place"), F.col("leader_c").alias("c")
    ).distinct()
    member = ["shingle", "node", "n", "place", "c", "near", "far"]
    others = within.select(member).unionByName(leaders.withColumns({"near": F.lit(0.0), "far": F.lit(0.0)}))
    x, y = odd.select(member).alias("x"), others.alias("y")
    gap = F.greatest(F.col("x.near") - F.col("y.far"), F.col("y.near") - F.col("x.far"))
    pairs = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.c") != F.col("y.c"))
        & _meets(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"))
        & F.coalesce(gap <= 1 - PERCENT / 100 + 1e-9, F.lit(True)),
    )
    swap = F.col("x.node") < F.col("y.node")
    both = pairs.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
        F.when(swap, F.col("x.n")).otherwise(F.col("y.n")).alias("an"), F.when(swap, F.col("y.n")).otherwise(F.col("x.n")).alias("bn"),
    ).distinct()
    return both.join(judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row: the size of its shingle set and the smallest key its links reach.

    Null and empty texts have no shingles and link with nothing. Rows with the same text link. Rows that repeat a key are
    one document: they share a component. A null key keeps its row and gets its component from its links, null without
    any. Other columns are not read. An empty table gives an empty table.
    """
    docs = bounded_batches(docs)
    frequent = stage(frequent_shingles(docs, text, words), "frequent")
    whole = stage(text_sets(docs, key, text, bounded_order(frequent), words), "sets")
    unstage(frequent)
    sets = stage(whole.select("id", "n", "k1", "k2"), "sizes")
    owners = sets.where("n > 0").groupBy(F.col("k1").alias("node"), "k2", "n").agg(F.min("id").alias("id"))
    same_set = whole.where("n > 0").groupBy("k1", "k2", "n").agg(*[F.first(c).alias(c) for c in ("rare", "hot", "prefix", "parities")])
    nodes = stage(same_set.drop("k2").withColumnRenamed("k1", "node"), "nodes")
    parities = stage(nodes.select("node", "parities"), "parities")
    unstage(whole)
    groups = reduce(DataFrame.unionByName, [stage(shared_prefixes(nodes, part, ROUNDS), "shared-prefixes") for part in range(ROUNDS)])
    unstage(nodes)
    first = (
        groups.where(_meets(F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place")))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_n").alias("an"), F.col("n").alias("bn"))
        .distinct()
    )
    judged = stage(bounded(first, parities), "pairs")
    counted = stage(overlaps(docs, key, text, judged.where(_similar(F.col("most"))), owners, words), "overlaps")
    same_key = Window.partitionBy("id")
    repeated = (
        sets.where("n > 0 and id is not null")
        .select("id", F.col("k1").alias("u"))
        .distinct()
        .withColumn("v", F.min("u").over(same_key))
        .select("u", "v")
        .where("u <> v")
    )
    links = stage(links_of(counted).unionByName(repeated), "links")
    joined = stage(components(links), "components")

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        label = joined.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(label, node, "left").withColumn(name, F.coalesce(name, node))

    apart = labelled(labelled(groups, "node", "c"), "leader", "leader_c")
    second = stage(bounded(_unsettled(apart, judged, counted), parities).where(_similar(F.col("most"))), "pairs")
    if second.limit(1).count():
        links = stage(links.unionByName(links_of(overlaps(docs, key, text, second, owners, words))), "links")
        joined = stage(components(links), "components")

    members = labelled(sets.where("n > 0").select("id", F.col("k1").alias("node")), "node", "c")
    least = members.groupBy("c").agg(F.min("id").alias("component"))
    by_node = labelled(owners.select("node").distinct(), "node", "c").join(least, "c").select("node", "component")
    rows = sets.select("id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("node")).join(by_node, "node", "left")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
