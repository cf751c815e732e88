"""A random forest as a relation: trees grow from histograms, the model is a table of nodes, scoring is a descent by joins.

Everything random comes from MD5, so a fit is repeatable and any engine can work it out again. A row takes part in a tree as often
as a Poisson draw of mean 1 says (the limit of a bootstrap); each node looks at a few features; a feature is cut at thresholds
taken from a bounded sample of rows. A level of all trees is one aggregation: tasks walk their rows down to their nodes, many rows and
all trees at once, by the splits found so far, and count them by (tree, node, feature, bin, class); Spark adds the counts up. Splits
maximise the decrease of Gini impurity under class weights. The splits of a level are at most trees * 2**depth rows, a bound of the
parameters, so they are collected and travel with the tasks.

Null features count as 0. Rows must have a label of 0 or 1. Equal keys always fall into a tree together.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from procurisk.session import cut_lineage

# the functions below travel to the workers by value, so the workers do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, DEPTH, BINS = 200, 6, 32
#: Rows (those of the least MD5) that the thresholds are taken from.
SAMPLE_ROWS = 1000
#: Draws are hash values below 2**28; a row is in a tree once more for each of these bounds that its value reaches: the
#: distribution function of a Poisson variable of mean 1.
DRAW_BITS = 28
DRAW_BOUNDS = (98751971, 197503943, 246879928, 263338590, 267453256, 268276189, 268413344, 268432938)
#: A split must decrease the impurity by more than this share of the node's weight.
LEAST_GAIN = 1e-9
#: Pairs of a row and a tree that a task walks down at once.
PAIRS_AT_ONCE = 1 << 21
#: Counters that a task keeps in one array; with more, it only keeps those that occur.
COUNTERS = 1 << 22

NODES = "tree int, node int, depth int, feature string, threshold double, left_node int, right_node int, weight_0 double, weight_1 double"


@dataclass
class ForestModel:
    """``nodes``: a row per node; a leaf has no feature. Rows with feature <= threshold go left; null counts as 0."""

    nodes: DataFrame
    features: tuple[str, ...]

    def descend(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, tree, node) of the leaf of every row in every tree, level by level."""
        nodes = F.broadcast(self.nodes.withColumn("place", self._place()))  # trees * 2**(depth + 1) rows at most
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        trees = self.nodes.agg(F.sort_array(F.collect_set("tree"))).scalar()
        at = rows.select(key, values.alias("_values")).withColumn("tree", F.explode(trees)).withColumn("node", F.lit(1))
        depth = self.nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
        for _ in range(depth):
            step = nodes.select("tree", "node", "place", "threshold", "left_node", "right_node")
            below = F.when(F.get("_values", F.col("place")) <= F.col("threshold"), F.col("left_node")).otherwise(F.col("right_node"))
            at = at.join(step, ["tree", "node"]).select(
                key, "_values", "tree", F.when(F.col("place").isNull(), F.col("node")).otherwise(below).alias("node")
            )
        return at.select(key, "tree", "node")

    def probabilities(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, probability_1): the mean over the trees of the share of class 1 in the leaf; ``key`` must be unique."""
        share = F.col("weight_1") / (F.col("weight_0") + F.col("weight_1"))
        leaves = F.broadcast(self.nodes.select("tree", "node", share.alias("share")))
        return self.descend(rows, key).join(leaves, ["tree", "node"]).groupBy(key).agg(F.avg("share").alias("probability_1"))

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``probability_1`` and ``prediction``. Tasks walk batches of rows down all trees, so any rows will do, repeated ones too."""
        trees, count = self._walks(), len(self.features)
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])

        @F.arrow_udf("double")
        def shares(batch: pa.Array) -> pa.Array:
            return pa.array(_shares_of(batch.flatten().to_numpy().reshape(len(batch), count), trees))

        scored = rows.withColumn("probability_1", shares(values) / F.lit(len(trees)))
        return scored.withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))

    def _place(self) -> Column:
        """The place of the feature of a node, from 0; null for a leaf."""
        return F.when(F.col("feature").isNotNull(), F.array_position(F.array(*map(F.lit, self.features)), F.col("feature")).cast("int") - 1)

    def _walks(self) -> list[tuple[np.ndarray, ...]]:
        """The trees as arrays. They have trees * 2**(depth + 1) nodes at most, so they are collected and travel with the tasks."""
        share = F.col("weight_1") / (F.col("weight_0") + F.col("weight_1"))
        nodes = self.nodes.select("tree", "node", self._place().alias("place"), "threshold", "left_node", "right_node", share.alias("share"))
        trees: dict[int, list[Row]] = {}
        for node in sorted(nodes.collect(), key=lambda n: (n["tree"], n["node"])):
            trees.setdefault(node["tree"], []).append(node)
        return [_walk_of(tree) for tree in trees.values()]

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        features = self.nodes.sparkSession.range(1).select(F.array(*map(F.lit, self.features)).alias("features"))
        features.write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        features = spark.read.parquet(f"{path}/features").first()["features"]
        return ForestModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), tuple(features))


def _walk_of(tree: Sequence[Row]) -> tuple[np.ndarray, ...]:
    """The nodes of a tree, in the order of their numbers, as arrays: place of the feature, threshold, children, share of class 1. A leaf leads to itself."""
    at = {node["node"]: i for i, node in enumerate(tree)}
    place, left, right = np.zeros(len(tree), dtype=int), np.arange(len(tree)), np.arange(len(tree))
    threshold, share = np.zeros(len(tree)), np.array([node["share"] for node in tree], dtype=float)
    for i, node in enumerate(tree):
        if node["place"] is not None:
            place[i], threshold[i] = node["place"], node["threshold"]
            left[i], right[i] = at[node["left_node"]], at[node["right_node"]]
    # as Spark compares them: no value is above a threshold of NaN, and a value of NaN is above every number
    return place, threshold, left, np.where(np.isnan(threshold), left, right), share


def _shares_of(values: np.ndarray, trees: Sequence[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The sum of the shares of the leaves that rows of values fall into, added up tree by tree."""
    rows, total = np.arange(len(values)), np.zeros(len(values))
    for place, threshold, left, right, share in trees:
        at = np.zeros(len(values), dtype=int)  # the root has the least number
        for _ in place:
            below = np.where(values[rows, place[at]] <= threshold[at], left[at], right[at])
            if np.array_equal(below, at):
                break
            at = below
        total += share[at]
    return total


def hash_value(key: Column, tree: Column) -> Column:
    """A number below 2**28 for a row and a tree."""
    digits = F.substring(F.md5(F.concat(tree.cast("string"), F.lit("|"), key)), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def draws(value: Column) -> Column:
    """How often a row with this hash value is in the tree."""
    return sum((F.when(value >= bound, 1).otherwise(0) for bound in DRAW_BOUNDS), F.lit(0))


def node_features(tree: int, node: int, features: Sequence[str]) -> list[str]:
    """The features a node looks at: the square root of their number, those of the least digests."""
    count = max(1, int(len(features) ** 0.5))
    return sorted(features, key=lambda f: hashlib.md5(f"{tree}|{node}|{f}".encode()).hexdigest())[:count]


def thresholds(rows: DataFrame, key: str, features: Sequence[str], bins: int = BINS, sample_rows: int = SAMPLE_ROWS) -> dict[str, list[float]]:
    """Cuts of each feature: midpoints between neighbouring distinct values of a sample, at most bins - 1, evenly spread by rank."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    sample = rows.select(key, *values).orderBy(F.md5(F.col(key).cast("string")), *features).limit(sample_rows).collect()
    cuts = {}
    for feature in features:
        distinct = sorted({row[feature] for row in sample})
        places = sorted({j * len(distinct) // bins for j in range(1, bins)} - {0})
        cuts[feature] = [(distinct[i - 1] + distinct[i]) / 2 for i in places]
    return cuts


def _best_splits(counted: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """The best split of each node from counts by (tree, node, place, bin): place, bin, and the class weights of the node and of both sides."""
    inside = W.partitionBy("tree", "node", "place").orderBy("bin")
    whole = W.partitionBy("tree", "node", "place")
    sides = counted
    for c in (0, 1):
        sides = sides.withColumn(f"t{c}", F.sum(f"n{c}").over(whole) * F.lit(weights[c]))
        sides = sides.withColumn(f"l{c}", F.sum(f"n{c}").over(inside) * F.lit(weights[c]))
        sides = sides.withColumn(f"r{c}", F.col(f"t{c}") - F.col(f"l{c}"))

    def purity(side: str) -> Column:
        a, b = F.col(f"{side}0"), F.col(f"{side}1")
        return F.coalesce(F.try_divide(a * a + b * b, a + b), F.lit(0.0))

    gain = purity("l") + purity("r") - purity("t")
    real = (F.col("l0") + F.col("l1") > 0) & (F.col("rest") > 0) & (gain > LEAST_GAIN * (F.col("t0") + F.col("t1")))
    rest = F.sum(F.col("n0") + F.col("n1")).over(whole) - F.sum(F.col("n0") + F.col("n1")).over(inside)
    rated = sides.withColumn("rest", rest).withColumn("gain", F.when(real, gain))
    # largest gain, then the first feature, then the first bin
    best = F.max_by(
        F.struct("place", "bin", "l0", "l1", "r0", "r1", "gain"), F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("place"), -F.col("bin"))
    )
    return rated.groupBy("tree", "node").agg(best.alias("best"), F.max("t0").alias("t0"), F.max("t1").alias("t1"))


def _counts_of(
    label: np.ndarray, binned: np.ndarray, times: np.ndarray, walked: Sequence[tuple[np.ndarray, ...]], looked: np.ndarray, bins: int
) -> tuple[np.ndarray, ...]:
    """Counts of some rows at the open nodes: node (its number in the list of open nodes), place, bin, n0, n1.

    ``binned`` has a column for each feature, ``times`` one for each tree. ``walked`` has for each level above the place and the bin
    each of its nodes is cut at, and the number of its left child in the next list (-1: none). ``looked``: the places of each open node.
    """
    row, at = np.nonzero(times)  # the first open nodes are the roots, in the order of the trees
    weight = times[row, at].astype(float)
    for place, cut, child in walked:
        below = child[at]
        right = binned[row, place[at]] > cut[at]
        inside = below >= 0
        row, at, weight = row[inside], (below + right)[inside], weight[inside]
    each = looked.shape[1]
    counters = (at[:, None] * each + np.arange(each)) * bins + binned[row[:, None], looked[at]]
    counters, numbers = counters.ravel(), np.arange(looked.size * bins) if looked.size * bins <= COUNTERS else None
    if numbers is None:
        numbers, counters = np.unique(counters, return_inverse=True)
    of_class = [np.repeat(weight * (label[row] == c), each) for c in (0, 1)]
    n0, n1 = (np.bincount(counters, w, len(numbers)).astype(np.int64) for w in of_class)
    kept = np.flatnonzero(n0 + n1)
    number, bin_ = np.divmod(numbers[kept], bins)
    return number // each, looked.ravel()[number], bin_, n0[kept], n1[kept]


def _counted(stored: DataFrame, walked: list[tuple[np.ndarray, ...]], open_nodes: list[tuple[int, int]], looked: np.ndarray, bins: int) -> DataFrame:
    """(tree, node, place, bin, n0, n1) of the open nodes: how often rows of each class lie in a bin, from one reading of the rows."""
    names = ("tree", "node", "place", "bin", "n0", "n1")
    trees_of, nodes_of = np.array(open_nodes, dtype=np.int32).T

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            label = batch.column("label").to_numpy()
            binned, times = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("bins", "times"))
            rows = max(1, PAIRS_AT_ONCE // times.shape[1])
            for i in range(0, batch.num_rows, rows):
                part = slice(i, i + rows)
                at, place, bin_, n0, n1 = _counts_of(label[part], binned[part], times[part], walked, looked, bins)
                columns = (trees_of[at], nodes_of[at], place.astype(np.int32), bin_.astype(np.int32), n0, n1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    parts = stored.mapInArrow(counts, "tree int, node int, place int, bin int, n0 long, n1 long")
    return parts.groupBy(*names[:4]).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(
    rows: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    weights: tuple[float, float],
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    sample_rows: int = SAMPLE_ROWS,
) -> ForestModel:
    """Grow the trees on (key, label, features) with a weight for each class.

    The rows are stored once as bins, with their draws; a level reads them once. What is shuffled is one row a (tree, node, feature, bin)
    and batch of rows, whatever the number of rows in a node.
    """
    spark = rows.sparkSession
    cuts = thresholds(rows, key, features, bins, sample_rows)
    binned = [
        sum((F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > cut, 1).otherwise(0) for cut in cuts[c]), F.lit(0)).cast("smallint")
        for c in features
    ]
    # the hash values are an array of their own, so they are not worked out again for each bound
    values = F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: hash_value(F.col("key"), t))
    narrow = rows.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"), F.array(*binned).alias("bins"))
    dealt = narrow.where(F.col("label").isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    small = cut_lineage(dealt.select("label", "bins", F.transform(values, lambda v: draws(v).cast("tinyint")).alias("times")))
    open_nodes = [(tree, 1) for tree in range(1, trees + 1)]
    found: list[tuple] = []
    walked: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        if not open_nodes:
            break
        looked_at = [
            sorted(features.index(f) for f in node_features(tree, node, features)) if level < depth else [0] for tree, node in open_nodes
        ]
        counted = _counted(small, walked, open_nodes, np.array(looked_at), bins)
        number = {at: i for i, at in enumerate(open_nodes)}
        place, cut, child = (np.full(len(open_nodes), start) for start in (0, 0, -1))
        open_nodes = []
        for tree, node, best, t0, t1 in _best_splits(counted, weights).collect():
            if level == depth or best["gain"] is None:
                found.append((tree, node, level, None, None, None, None, t0, t1))
                continue
            feature = features[best["place"]]
            found.append((tree, node, level, feature, cuts[feature][best["bin"]], 2 * node, 2 * node + 1, t0, t1))
            i = number[tree, node]
            place[i], cut[i], child[i] = best["place"], best["bin"], len(open_nodes)
            open_nodes += [(tree, 2 * node), (tree, 2 * node + 1)]
        walked.append((place, cut, child))
    return ForestModel(cut_lineage(spark.createDataFrame(found, T._parse_datatype_string(NODES))), tuple(features))
