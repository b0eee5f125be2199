"""Near-duplicate vectors by a forest of random-projection trees with spill.

Every level of a tree splits by a random direction at the node's median; a vector close to the split goes down both sides, its
home is the side it lies on. In every leaf the vectors that are at home there are compared, in double precision, with all that
are in it. Links of all trees are united without listing pairs: a tree does not count a neighbour that an earlier tree has
shown to the same vector, so counts add up, and the links of a leaf leave it as one edge per vector.

Equal vectors are one row with a weight. Leaves above ``TILE`` rows are compared in tiles of that size, all against all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.llm.components import components
from mediacast.session import stage

COSINE = 0.98
TREES = 4
#: Spill on each side of a split, in standard deviations of the projected distance of a pair at the threshold.
SPILL = 1.0
LEAF = 512
TILE = 4096
ASKS, ASKED = 0, 1
#: Bounds of the sample that places the splits.
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # [tree, level, dimension], unit length
    splits: list[list[np.ndarray]]  # per tree and level the median of every node
    spill: float

    @property
    def levels(self) -> int:
        return self.directions.shape[1]


def fit_forest(sample: np.ndarray, levels: int, cosine: float = COSINE, trees: int = TREES, seed: int = 7) -> Forest:
    """Random directions, and medians of the sample's unit vectors at every node; nodes without sample take their parent's."""
    width = sample.shape[1]
    random = np.random.default_rng(seed)
    directions = random.normal(size=(trees, levels, width))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = []
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        medians = []
        for level in range(levels):
            projected = sample @ directions[tree, level]
            overall = float(np.median(projected)) if len(projected) else 0.0
            own = np.full(1 << level, overall)
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for i in np.flatnonzero(np.diff(bounds) >= 16):
                own[i] = np.median(projected[order[bounds[i] : bounds[i + 1]]])
            medians.append(own)
            node = 2 * node + (projected > own[node])
        splits.append(medians)
    return Forest(directions, splits, SPILL * math.sqrt(2 - 2 * cosine) / math.sqrt(width))


def leaves(forest: Forest, vectors: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, leaf, at home)`` of all places that the unit vectors take in a tree."""
    row = np.arange(len(vectors))
    leaf, home = np.zeros(len(vectors), np.int64), np.ones(len(vectors), bool)
    for level in range(forest.levels):
        gap = (vectors @ forest.directions[tree, level])[row] - forest.splits[tree][level][leaf]
        right = gap > 0
        near = np.abs(gap) <= forest.spill
        row, leaf, home = (
            np.concatenate([row, row[near]]),
            np.concatenate([2 * leaf + right, 2 * leaf[near] + ~right[near]]),
            np.concatenate([home, np.zeros(near.sum(), bool)]),
        )
    return row, leaf, home


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """``[row, dimension]`` unit vectors in double precision; all rows have the same width."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest  # squares stay in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column, label: Column) -> Column:
    """Vectors that can link: labelled, with finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _placed(vectors: DataFrame, forest: Forest) -> DataFrame:
    """One row per place of a vector: ``(label, tree, leaf, home, id, weight, vector, homes, places)``.

    ``homes`` are the vector's home leaves in all trees and ``places`` all its leaves, as ``tree * 2^40 + leaf``.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches):
        forest = shared.value
        trees = len(forest.splits)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("vector"))
            parts = [leaves(forest, unit, tree) for tree in range(trees)]
            row = np.concatenate([p[0] for p in parts])
            code = np.concatenate([p[1] + (t << 40) for t, p in enumerate(parts)])
            home = np.concatenate([p[2] for p in parts])
            order = np.lexsort((code, row))
            ends = np.searchsorted(row[order], np.arange(len(unit) + 1))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))
            by_row = np.lexsort((code[home], row[home]))
            homes = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * trees, pa.int32()), pa.array(code[home][by_row]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").take(take), pa.array(code), pa.array(home), batch.column("id").take(take),
                    batch.column("weight").take(take), batch.column("vector").take(take), homes.take(take), places.take(take),
                ],
                names=["label", "leaf", "home", "id", "weight", "vector", "homes", "places"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    item = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "label", "weight", "vector").mapInArrow(
        place, f"label {kind}, leaf long, home boolean, id long, weight long, vector {item}, homes array<long>, places array<long>"
    )


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    rows = lists.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=1)), -1, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _compared(table: pa.Table) -> pa.Table:
    """Links of one tile: ``(id, links, to)``, the weight of new neighbours of each vector and its smallest peer."""
    asking = table.filter(pc.equal(table.column("side"), ASKS))
    asked = table.filter(pc.equal(table.column("side"), ASKED))
    if not asking.num_rows or not asked.num_rows:
        return pa.table({name: pa.array([], pa.int64()) for name in ("id", "links", "to")})
    left, right = (unit_rows(t.column("vector").combine_chunks()) for t in (asking, asked))
    a_id, b_id = asking.column("id").to_numpy(), asked.column("id").to_numpy()
    weight, places = asked.column("weight").to_numpy(), _padded(asked.column("places"))
    homes = _padded(asking.column("homes"))
    tree = int(table.column("leaf")[0].as_py()) >> 40
    links = np.zeros(len(left), np.int64)
    names = np.unique(np.concatenate([a_id, b_id]))
    root = np.arange(len(names))
    a_at, b_at = np.searchsorted(names, a_id), np.searchsorted(names, b_id)
    for start in range(0, len(left), 512):
        i, j = np.nonzero(left[start : start + 512] @ right.T >= COSINE)
        i += start
        other = a_id[i] != b_id[j]
        i, j = i[other], j[other]
        new = np.ones(len(i), bool)
        for earlier in range(tree):
            for some in range(0, len(i), 1 << 20):
                part = slice(some, some + (1 << 20))
                new[part] &= ~(places[j[part]] == homes[i[part], earlier][:, None]).any(axis=1)
        np.add.at(links, i[new], weight[j[new]])
        while len(i):
            least = np.minimum(root[a_at[i]], root[b_at[j]])
            if (root[a_at[i]] == least).all() and (root[b_at[j]] == least).all():
                break
            np.minimum.at(root, a_at[i], least)
            np.minimum.at(root, b_at[j], least)
            root = root[root]
    while not (root[root] == root).all():
        root = root[root]
    linked = root != np.arange(len(names))
    return pa.table(
        {
            "id": pa.array(np.concatenate([a_id, names[linked]]), pa.int64()),
            "links": pa.array(np.concatenate([links, np.zeros(linked.sum(), np.int64)]), pa.int64()),
            "to": pa.array(np.concatenate([a_id, names[root][linked]]), pa.int64()),
        }
    )


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Vectors of one label and one width link at a cosine of ``COSINE`` or more. Null labels, null, empty and zero vectors and
    those with null or non-finite components link with nothing and are their own component. Every row counts as a vector;
    rows that repeat a key share its component. A null key is kept, links with nothing and has no component. Other columns are
    not read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good = rows.where(usable(F.col("vector"), F.col("label")) & F.col("id").isNotNull())
    marked = good.select("id", "label", "vector", F.size("vector").alias("width"), F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    same = ["label", "width", "h1", "h2"]
    classes = stage(
        marked.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "classes"
    ).withColumn("id", F.xxhash64("label", "width", "h1", "h2"))
    edges, counts = [], []
    sizes = classes.groupBy("width").agg(F.count("*").alias("n")).collect()  # one row per vector width
    for width in sorted(r["width"] for r in sizes):
        own = classes.where(F.col("width") == width)
        most = own.groupBy("label").count().agg(F.max("count")).first()[0]
        levels = max(0, math.ceil(math.log2(most / LEAF)))
        few = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
        sample = own.orderBy("id").limit(few).select("vector").toArrow().column("vector").combine_chunks()
        forest = fit_forest(unit_rows(sample), levels)
        placed = stage(_placed(own, forest), "places")
        tiles = placed.groupBy("label", "leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        split = placed.join(tiles, ["label", "leaf"]).withColumn("own", F.pmod(F.col("id"), F.col("tiles")).cast("int"))
        across = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        asks = split.where("home").withColumn("row", F.col("own")).withColumn("col", across).withColumn("side", F.lit(ASKS))
        asked = split.withColumn("col", F.col("own")).withColumn("row", across).withColumn("side", F.lit(ASKED))
        columns = ["label", "leaf", "row", "col", "side", "id", "weight", "vector", "homes", "places"]
        both = asks.select(columns).unionByName(asked.select(columns))
        found = stage(both.groupBy("label", "leaf", "row", "col").applyInArrow(_compared, "id long, links long, to long"), "neighbours")
        edges.append(found.where("id <> to").select(F.col("id").alias("u"), F.col("to").alias("v")))
        counts.append(found.groupBy("id").agg(F.sum("links").alias("links")))
    if not sizes:
        return table.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    all_edges, all_counts = edges[0], counts[0]
    for e, c in zip(edges[1:], counts[1:]):
        all_edges, all_counts = all_edges.unionByName(e), all_counts.unionByName(c)
    members = marked.join(classes.select(*same, F.col("id").alias("node"), "weight"), same).select("id", "node", "weight")
    of_key = members.select("id", F.col("node").alias("u")).distinct()
    repeated = of_key.withColumn("v", F.min("u").over(Window.partitionBy("id"))).where("u <> v").select("u", "v")
    joined = stage(components(all_edges.distinct().unionByName(repeated)), "components").withColumnRenamed("component", "c")
    labelled = classes.select(F.col("id").alias("node"), "first").join(joined, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = labelled.groupBy("c").agg(F.min("first").alias("component_id"))
    per_class = (
        labelled.join(least, "c")
        .join(all_counts.withColumnRenamed("id", "node"), "node", "left")
        .select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
    nodes = rows.withColumns(
        {
            "good": usable(F.col("vector"), F.col("label")) & F.col("id").isNotNull(),
            "width": F.size("vector"), "h1": F.xxhash64("vector"), "h2": F.hash("vector"),
        }
    ).withColumn("node", F.when(F.col("good"), F.xxhash64("label", "width", "h1", "h2")))
    weights = classes.select(F.col("id").alias("node"), "weight")
    out = nodes.select("id", "node").join(per_class.join(weights, "node"), "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
