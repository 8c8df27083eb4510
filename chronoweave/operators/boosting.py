"""Gradient-boosted trees over histograms, grown leaf by leaf, several models at a time.

Features are cut into at most ``BINS`` bins once. A tree grows by its best leaf until it has ``LEAVES`` leaves or no split gains
anything. What a split gains follows from sums of gradients and hessians per bin, which one pass over the binned rows gives for all
open nodes of all models: a task adds up arrays for its rows, and the sums of tasks are added by node, so what is shuffled and
what reaches the driver has the size of histograms, not of the data. Nodes that may be split later are looked at together with the
one that is split now, so a tree takes about as many passes as it is deep. Folds are models of their own with their own rows: all
are trained by the same passes.

Rows carry the score of every model. Finished trees are applied in the next pass, and every ``KEEP`` rounds the rows are written
anew with their scores, so a pass applies few trees and a lost executor repeats few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.session import cut_lineage, workers_find_library

#: Bins of a feature; 0 is for missing values.
BINS = 256
LEAVES, LEAST_ROWS, LEAST_HESSIAN = 15, 20, 1e-3
#: Rounds after which scores are written.
KEEP = 10
#: Tasks that add up the sums of all others.
ADDERS = 16


@dataclass
class Tree:
    """Nodes in arrays: the feature and the last bin that goes left, the children, and the value of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        a = len(self.feature)
        for _ in range(2):
            for column, first in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(first)
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node], self.right[node] = feature, cut, missing_left, a, a + 1
        return a, a + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, missing, left, right = map(np.array, (self.feature, self.cut, self.missing_left, self.left, self.right))
        open_rows = np.flatnonzero(left[at] >= 0)
        while len(open_rows):
            node = at[open_rows]
            held = bins[open_rows, feature[node]]
            goes_left = np.where(held == 0, missing[node], held <= cut[node])
            at[open_rows] = np.where(goes_left, left[node], right[node])
            open_rows = open_rows[left[at[open_rows]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """A model: where features are cut, the score all rows begin with, and its trees."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """Rising cut points of each feature, from sketches of bounded size; missing values and infinities do not count."""
    steps = [i / (bins - 1) for i in range(1, bins - 1)]
    finite = lambda name: F.when(F.abs(F.col(name)) < float("inf"), F.col(name).cast("double"))
    found = rows.agg(*[F.percentile_approx(finite(name), steps, accuracy).alias(f"f{i}") for i, name in enumerate(features)]).first()
    return [np.unique(np.array(cuts or [], np.float64)) for cuts in found]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of features: 1 and up by value, 0 where there is none."""
    out = np.zeros(values.shape, np.uint8)
    for i, cuts in enumerate(edges):
        held = np.searchsorted(cuts, values[:, i], side="left") + 1
        out[:, i] = np.where(np.isnan(values[:, i]), 0, held)
    return out


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Binned rows from a column of bytes."""
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _binning(features: int, edges: list[np.ndarray], starts: list[float]):
    def run(batches):
        for batch in batches:
            values = np.column_stack([batch.column(f"f{i}").cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(features)])
            packed = binned(values, edges)
            scores = np.tile(np.array(starts), (len(packed), 1))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), batch.column("y"), batch.column("parts"), pa.array([s.tobytes() for s in scores], pa.binary())],
                                             ["bins", "y", "parts", "scores"])

    return run


def _scored(batch: pa.RecordBatch, width: int, pending: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """(bins, scores): each model's score of each row, with the trees that are not in the written scores yet."""
    bins = _matrix(batch, width)
    scores = np.frombuffer(b"".join(batch.column("scores").to_pylist()), np.float64).reshape(len(bins), -1).copy()
    for model, trees in enumerate(pending):
        for tree in trees:
            scores[:, model] += tree.scores(bins)
    return bins, scores


def _histograms(width: int, pending: list[list[Tree]], growing: list[Tree], wanted: list[list[int]]):
    """Per model and wanted node: sums of gradients, hessians and rows by feature and bin."""
    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, scores = _scored(batch, width, pending)
            y, parts = batch.column("y").to_numpy(), batch.column("parts").to_numpy()
            for model, (tree, nodes) in enumerate(zip(growing, wanted)):
                mine = np.flatnonzero((parts >> model) & 1)
                if not nodes or not len(mine):
                    continue
                p = 1 / (1 + np.exp(-scores[mine, model]))
                gradient, hessian, at = p - y[mine], p * (1 - p), tree.nodes(bins[mine])
                for node in nodes:
                    inside = np.flatnonzero(at == node)
                    cells = (bins[mine[inside]].astype(np.int64) + np.arange(width) * BINS).ravel()
                    made = np.stack([np.bincount(cells, np.repeat(w[inside], width) if w is not None else None, width * BINS) for w in (gradient, hessian, None)])
                    sums[model, node] = sums[model, node] + made if (model, node) in sums else made
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["model", "node", "sums"])

    return run


def _added(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, node, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held = np.frombuffer(sums, np.float64)
            total[model, node] = total[model, node] + held if (model, node) in total else held
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["model", "node", "sums"])


SUMS = "model int, node int, sums binary"


def best_split(sums: np.ndarray, least_rows: int = LEAST_ROWS) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last bin to the left, whether missing values go left) of the best split of a node; None if nothing gains."""
    g, h, n = sums
    best = None
    for missing_left in (True, False):
        sides = []
        for held in (g, h, n):
            left = np.cumsum(held[:, 1:], 1)[:, :-1] + (held[:, :1] if missing_left else 0)
            sides.append((left, held.sum(1, keepdims=True) - left))
        (gl, gr), (hl, hr), (nl, nr) = sides
        fits = (nl >= least_rows) & (nr >= least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
        whole = g.sum(1, keepdims=True) ** 2 / np.maximum(h.sum(1, keepdims=True), 1e-300)
        gain = np.where(fits, gl**2 / np.maximum(hl, 1e-300) + gr**2 / np.maximum(hr, 1e-300) - whole, -np.inf)
        at = int(np.argmax(gain))
        feature, cut = divmod(at, gain.shape[1])
        if gain.ravel()[at] > 1e-12 and (best is None or gain.ravel()[at] > best[0] + 1e-12):
            best = (float(gain.ravel()[at]), feature, cut + 1, missing_left)
    return best


class Growth:
    """A tree of one model while it grows. Open nodes are split beforehand in ``tree``; ``grown`` picks those that count."""

    def __init__(self, leaves: int, step: float, least_rows: int):
        self.tree, self.leaves, self.step, self.least_rows = Tree(), leaves, step, least_rows
        self.sums: dict[int, np.ndarray] = {}
        self.gains: dict[int, float] = {}
        self.closed: set[int] = set()
        self.wanted = [0]

    def learn(self, found: dict[int, np.ndarray]) -> None:
        """Takes in the histograms of the wanted nodes, splits each of them, and wants the children that may count."""
        for node in self.wanted:
            self.sums[node] = found.get(node, np.zeros((3, 1, 2)))
            chosen = best_split(self.sums[node], self.least_rows) if node in found else None
            if chosen:
                self.gains[node] = chosen[0]
                a, b = self.tree.split(node, *chosen[1:])
                for child, sums in zip((a, b), self._sides(node)):
                    if sums[2] < 2 * self.least_rows:  # too few rows for two leaves
                        self.closed.add(child)
        self.wanted = self._pick()[1]

    def _sides(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients, hessians and rows to the left and to the right of a node's split."""
        f, cut, whole = self.tree.feature[node], self.tree.cut[node], self.sums[node].sum(2)[:, self.tree.feature[node]]
        left = self.sums[node][:, f, 1:cut + 1].sum(1) + (self.sums[node][:, f, 0] if self.tree.missing_left[node] else 0)
        return left, whole - left

    def _pick(self) -> tuple[list[int], list[int]]:
        """Best nodes first, as far as histograms are known; and the nodes whose histograms are needed to be sure."""
        open_nodes, picked, unknown = ([0] if 0 in self.gains else []), [], []
        while open_nodes and len(picked) < self.leaves - 1:
            node = max(open_nodes, key=lambda i: (self.gains[i], -i))
            open_nodes.remove(node)
            picked.append(node)
            if len(picked) == self.leaves - 1:
                break  # no split comes after this one
            for child in (self.tree.left[node], self.tree.right[node]):
                if child in self.gains:
                    open_nodes.append(child)
                elif child not in self.sums and child not in self.closed:
                    unknown.append(child)
        return picked, unknown

    def finished(self) -> Tree:
        """The tree of the nodes that count, with shrunken leaf values."""
        picked, _ = self._pick()
        out, to = Tree(), {0: 0}
        leaf_sums = {0: self.sums[0].sum(2)[:, 0]} if 0 in self.sums else {}
        for node in picked:
            a, b = out.split(to[node], self.tree.feature[node], self.tree.cut[node], self.tree.missing_left[node])
            to[self.tree.left[node]], to[self.tree.right[node]] = a, b
            leaf_sums[a], leaf_sums[b] = self._sides(node)
        for node, sums in leaf_sums.items():
            out.value[node] = float(-self.step * sums[0] / max(sums[1], 1e-300))
        return out


def boosted(rows: DataFrame, features: list[str], label: Column, parts: list[Column], *, rounds: int = 200, step: float = 0.04, leaves: int = LEAVES,
            least_rows: int = LEAST_ROWS) -> list[Boosted]:
    """A model for each of ``parts``, conditions that say which rows it learns from; ``label`` is 0 or 1."""
    workers_find_library(rows.sparkSession)
    used = rows.filter(_any(parts))
    edges = bin_edges(used, features)
    mask = sum((F.when(F.coalesce(part, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, part in enumerate(parts)), F.lit(0)).cast("long")
    plain = used.select(*[F.col(name).cast("double").alias(f"f{i}") for i, name in enumerate(features)], label.cast("double").alias("y"), mask.alias("parts"))
    counts = plain.agg(*[F.count_if(F.col("parts").bitwiseAND(1 << i) != 0).alias(f"n{i}") for i in range(len(parts))],
                       *[F.count_if((F.col("parts").bitwiseAND(1 << i) != 0) & (F.col("y") == 1)).alias(f"up{i}") for i in range(len(parts))]).first()
    starts = []
    for i in range(len(parts)):
        share = min(max(counts[f"up{i}"] / max(counts[f"n{i}"], 1), 1e-9), 1 - 1e-9)
        starts.append(float(np.log(share / (1 - share))))
    kind = "bins binary, y double, parts bigint, scores binary"
    held = cut_lineage(plain.mapInArrow(_binning(len(features), edges, starts), kind))
    models = [Boosted(features, edges, start, []) for start in starts]
    width, pending, tasks = len(features), [[] for _ in parts], held.rdd.getNumPartitions()
    for _ in range(rounds):
        growing = [Growth(leaves, step, least_rows) for _ in parts]
        while any(growth.wanted for growth in growing):
            made = held.mapInArrow(_histograms(width, pending, [g.tree for g in growing], [g.wanted for g in growing]), SUMS)
            found: list[dict[int, np.ndarray]] = [{} for _ in parts]
            for row in _collected(made, tasks):
                found[row["model"]][row["node"]] = row["sums"].reshape(3, width, BINS)
            for growth, sums in zip(growing, found):
                growth.learn(sums)
        for model, growth, trees in zip(models, growing, pending):
            tree = growth.finished()
            model.trees.append(tree)
            trees.append(tree)
        if len(pending[0]) >= KEEP:
            held = cut_lineage(held.mapInArrow(_kept(width, pending), kind))
            pending, tasks = [[] for _ in parts], held.rdd.getNumPartitions()
    return models


def _collected(made: DataFrame, tasks: int) -> list[dict]:
    """Sums over all tasks. Tasks' sums are added in ``ADDERS`` tasks by node; up to as many tasks send theirs as they are."""
    if tasks > ADDERS:
        made = made.repartition(ADDERS, "model", "node").mapInArrow(_added, SUMS)
    total: dict[tuple[int, int], np.ndarray] = {}
    for row in made.toArrow().to_pylist():
        key, held = (row["model"], row["node"]), np.frombuffer(row["sums"], np.float64)
        total[key] = total[key] + held if key in total else held
    return [{"model": model, "node": node, "sums": sums} for (model, node), sums in total.items()]


def _any(parts: list[Column]) -> Column:
    held = F.lit(False)
    for part in parts:
        held = held | F.coalesce(part, F.lit(False))
    return held


def _kept(width: int, pending: list[list[Tree]]):
    def run(batches):
        for batch in batches:
            _, scores = _scored(batch, width, pending)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), batch.column("parts"), pa.array([s.tobytes() for s in scores], pa.binary())], ["bins", "y", "parts", "scores"])

    return run


def with_probability(rows: DataFrame, model: Boosted, name: str = "prob_up") -> DataFrame:
    """Adds the probability of label 1."""
    workers_find_library(rows.sparkSession)
    wide = rows.withColumn("_features", F.array(*[F.col(f).cast("double") for f in model.features]))
    fields = rows.columns

    def run(batches):
        for batch in batches:
            lists = batch.column("_features")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(model.features))
            bins, score = binned(values, model.edges), np.full(batch.num_rows, model.start)
            for tree in model.trees:
                score += tree.scores(bins)
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(1 / (1 + np.exp(-score)))], [*fields, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return wide.mapInArrow(run, f"{kinds}, `{name}` double")


NODES = "tree int, node int, feature int, cut int, missing_left boolean, `left` int, `right` int, value double"
EDGES = "place int, feature string, edges array<double>, start double"


def save_model(spark: SparkSession, model: Boosted, path: str) -> None:
    """The model as two small tables: nodes of all trees, and the features with their cut points."""
    nodes = [(t, i, tree.feature[i], int(tree.cut[i]), bool(tree.missing_left[i]), tree.left[i], tree.right[i], tree.value[i])
             for t, tree in enumerate(model.trees) for i in range(len(tree.feature))]
    edges = [(i, name, [float(x) for x in cuts], model.start) for i, (name, cuts) in enumerate(zip(model.features, model.edges))]
    for name, rows, ddl in (("nodes", nodes, NODES), ("features", edges, EDGES)):
        spark.createDataFrame(rows, T.StructType.fromDDL(ddl)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> Boosted:
    edges = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    trees: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        trees.setdefault(row["tree"], []).append(row)
    made = [Tree(*([row[name] for row in rows] for name in ("feature", "cut", "missing_left", "left", "right", "value"))) for _, rows in sorted(trees.items())]
    return Boosted([row["feature"] for row in edges], [np.array(row["edges"], np.float64) for row in edges], edges[0]["start"], made)
