"""A random forest for regression whose trees are finished where their rows fit one task.

Spark's own forest adds up full histograms of every node on every level, which for deep trees are far larger than the
rows behind them, and keeps all nodes on the driver. Here a node with more than ``SUBTREE_ROWS`` rows gets its
histograms from all tasks; the rows of a smaller one go to one task that grows everything below. Finished trees lie
in files, a few to a file, and are read one file at a time.

Parameters and rules are those of Spark's forest: Poisson draws per row and tree, at most ``maxBins`` bins per
feature, largest fall of the variance, drawn copies counted in ``minInstancesPerNode``. Cut points are quantiles of
all rows, or every gap between the values of a feature with few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml import regression as ml
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import fresh_path, stored

SUBTREE_ROWS = 100_000  # a task that grows a subtree of so many rows takes some 100 MB
TREES_A_FILE = 4
QUANTILE_ERROR = 0.001
BLOCK = 1 << 22  # numbers handled at once
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
BINNED = "id long, target double, bins binary"
DEALT = "tree int, node long, bins binary, target binary, weight binary"
HISTOGRAM = "tree int, node long, sums binary"
CHOSEN = "tree int, node long, rows double, value double, feature int, cut int, left_rows double, left_value double"
PIECE = "tree int, node binary, feature binary, cut binary, value binary"
TREE = "tree int, feature binary, cut binary, below binary, value binary"
SPLIT, LEAF, LARGE, SMALL = range(4)


class Layout:
    """Where the bins of every feature lie when all are put in one row, and between which of them one can cut."""

    def __init__(self, cuts: Sequence[np.ndarray]) -> None:
        widths = [len(c) + 1 for c in cuts]
        self.first = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int32)
        self.size = sum(widths)
        self.feature = np.repeat(np.arange(len(cuts)), [w - 1 for w in widths])
        self.cut = np.concatenate([np.arange(w - 1) for w in widths])
        self.place = self.first[self.feature] + self.cut

    def sums(self, bins: np.ndarray, group: np.ndarray, groups: int, weight: np.ndarray) -> np.ndarray:
        """Weights added up by group and bin: one row a group, the bins of all features side by side."""
        cells = (group[:, None] * self.size + (bins + self.first)).ravel()
        found = np.bincount(cells, np.repeat(weight, bins.shape[1]), minlength=groups * self.size)
        return found.reshape(groups, self.size)

    def best(
        self, rows: np.ndarray, gaps: np.ndarray, spread: np.ndarray, leaf: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per group the feature (-1: none) and bin to cut behind, and what lies left of it.

        ``rows`` and ``gaps`` are sums by bin of the weights and of weighted gaps to one value near the mean.
        """
        count, total = (s[:, : self.size if len(self.first) < 2 else self.first[1]].sum(axis=1) for s in (rows, gaps))
        none = np.full(len(rows), -1)
        if not len(self.place):
            return none, none, count, total
        left = np.cumsum(rows, axis=1)[:, self.place] - self.feature * count[:, None]
        fell = np.cumsum(gaps, axis=1)[:, self.place] - self.feature * total[:, None]
        right = count[:, None] - left
        fits = (left >= leaf) & (right >= leaf)
        gain = fell**2 / np.where(fits, left, 1) + (total[:, None] - fell) ** 2 / np.where(fits, right, 1)
        gain = np.where(fits, gain - (total**2 / count)[:, None], -1.0)
        at, line = gain.argmax(axis=1), np.arange(len(rows))
        good = gain[line, at] > 1e-9 * spread  # less is rounding
        return np.where(good, self.feature[at], -1), np.where(good, self.cut[at], -1), left[line, at], fell[line, at]


class Nodes(NamedTuple):
    """Nodes of one tree: number as in a heap with root 1, feature to cut (-1: none), bin to cut behind, mean."""

    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def joined(cls, parts: Sequence[Nodes]) -> Nodes:
        """All nodes in the order of their numbers, so that the two below a node are neighbours."""
        whole = [np.concatenate(column) for column in zip(*parts, strict=True)]
        order = whole[0].argsort(kind="stable")
        return cls(*(column[order] for column in whole))

    def below(self) -> np.ndarray:
        """The place of the left one of the two nodes below."""
        return np.searchsorted(self.node, 2 * self.node).astype(np.int32)


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The place of the node without a cut that each row reaches."""
    at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        moving = moving[feature[at[moving]] >= 0]
        if not len(moving):
            return at
        here = at[moving]
        at[moving] = below[here] + (bins[moving, feature[here]] > cut[here])


def grow(
    layout: Layout, bins: np.ndarray, target: np.ndarray, weight: np.ndarray, root: int, levels: int, leaf: int
) -> Nodes:
    """The subtree below node ``root`` of at most ``levels`` more levels, all nodes of a level at once."""
    made, heap, order = [], np.array([root], np.int64), np.arange(len(bins))
    start = np.array([0, len(bins)])
    noise = (1e-12 * np.abs(target).max()) ** 2
    for level in range(levels + 1):
        group = np.repeat(np.arange(len(heap)), np.diff(start))
        w = weight[order].astype(np.float64)
        y = target[order]
        rows = np.add.reduceat(w, start[:-1])
        value = np.add.reduceat(w * y, start[:-1]) / rows
        gap = y - value[group]
        spread = np.add.reduceat(w * gap * gap, start[:-1])
        feature, cut = np.full(len(heap), -1, np.int16), np.zeros(len(heap), np.uint8)
        if level < levels:
            wanted = np.flatnonzero((rows >= 2 * leaf) & (spread > noise * rows))
            for some in _portions(wanted, np.diff(start)[wanted] * bins.shape[1] + layout.size):
                here = _lines(start[some], start[some + 1])
                local = np.repeat(np.arange(len(some)), start[some + 1] - start[some])
                at = bins[order[here]]
                counts = layout.sums(at, local, len(some), w[here])
                gaps = layout.sums(at, local, len(some), w[here] * gap[here])
                found, behind, _, _ = layout.best(counts, gaps, spread[some], leaf)
                feature[some], cut[some] = found, np.maximum(behind, 0)
        made.append(Nodes(heap, feature, cut, value))
        split = feature >= 0
        if not split.any():
            break
        kept = split[group]
        order, group = order[kept], group[kept]
        right = bins[order, feature[group]] > cut[group]
        child = 2 * (np.cumsum(split) - 1)[group] + right
        order = order[child.argsort(kind="stable")]
        start = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=2 * split.sum()))])
        heap = (2 * heap[split][:, None] + np.arange(2)).ravel()
    return Nodes.joined(made)


def _portions(items: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """Neighbouring items of a bounded cost in all, or one alone."""
    if len(items):
        yield from np.split(items, np.flatnonzero(np.diff(np.cumsum(cost) // BLOCK)) + 1)


def _lines(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, from a hash (SplitMix64) of row, tree and seed."""
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed], np.int64).astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        hashed = _mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
    return np.searchsorted(POISSON, (hashed >> np.uint64(11)) * 2.0**-53, side="right")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _binned(vectors: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Per number how many cut points lie below it; bounds belong to the left."""
    found = [np.searchsorted(c, column, side="left") for c, column in zip(cuts, vectors.T, strict=True)]
    return np.column_stack(found).astype(np.uint8)


def _bins(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _batch(schema: str, *columns: Sequence) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [field.split() for field in schema.split(", ")]
    made = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[name for name, _ in names])


def cut_points(vectors: DataFrame, bins: int) -> list[np.ndarray]:
    """Ascending cut points of every number in the array column ``x``: middles between its values if those are few.

    Values of other numbers are cut at ``bins`` quantiles, exact to a thousandth of the rows.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        for batch in batches:
            columns = _vectors(batch.column(0)).T
            seen = seen or [np.empty(0)] * len(columns)
            for k, values in enumerate(columns):
                if seen[k] is not None:
                    both = np.unique(np.concatenate([seen[k], values]))
                    seen[k] = both if len(both) <= bins else None
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(seen)), pa.int32()), pa.array(seen, kind)], names=["number", "few"]
        )

    values = F.array_sort(F.array_distinct(F.flatten(F.collect_list("few"))))
    full = F.bool_or(F.col("few").isNull()) | (F.size(values) > bins)
    counted = vectors.mapInArrow(few, "number int, few array<double>").groupBy("number")
    known = {r["number"]: r["few"] for r in counted.agg(F.when(~full, values).alias("few")).collect()}
    many = [k for k, found in known.items() if found is None]
    shares = [k / bins for k in range(1, bins)]
    split = vectors.select(*[F.get("x", F.lit(k)).alias(str(k)) for k in many])
    quantiles = split.approxQuantile([str(k) for k in many], shares, QUANTILE_ERROR) if many else []
    cuts = {k: np.unique(q) for k, q in zip(many, quantiles, strict=True)}
    for k, found in known.items():
        if found is not None:
            both = np.array(found)
            cuts[k] = both[:-1] + (both[1:] - both[:-1]) / 2
    return [cuts[k] for k in sorted(cuts)]


class RandomForestRegressor(ml.RandomForestRegressor):
    """Spark's forest by its parameters, grown as the module says; no row weights, feature subsets or smaller samples."""

    def _fit(self, dataset: DataFrame) -> ForestModel:
        fixed = {"featureSubsetStrategy": "all", "subsamplingRate": 1.0, "bootstrap": True, "minInfoGain": 0.0,
                 "minWeightFractionPerNode": 0.0, "leafCol": ""}
        if other := [n for n, v in fixed.items() if self.getOrDefault(n) != v]:
            raise ValueError(f"not supported: other values of {', '.join(other)}")
        if self.isDefined("weightCol") or self.getMaxBins() > 256:
            raise ValueError("not supported: weights of rows, more than 256 bins")
        spark = dataset.sparkSession
        # Numbers of rows decide the draws, so they are fixed by writing them.
        rows = stored(
            dataset.select(
                F.monotonically_increasing_id().alias("id"),
                F.col(self.getLabelCol()).cast("double").alias("target"),
                vector_to_array(self.getFeaturesCol()).alias("x"),
            ),
            "forest-rows",
        )
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean")).first()
        if not facts["n"]:
            raise ValueError("no rows to learn from")
        cuts = cut_points(rows.select("x"), self.getMaxBins())
        grower = _Grower(cuts, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSeed())
        folder = fresh_path(spark, "forest")
        _write(grower.trees(rows, self.getNumTrees(), facts["n"], facts["mean"]), folder)
        model = ForestModel(folder, [c.tolist() for c in cuts])
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class _Grower:
    def __init__(self, cuts: list[np.ndarray], depth: int, leaf: int, seed: int) -> None:
        self.cuts, self.layout, self.depth, self.leaf, self.seed = cuts, Layout(cuts), depth, leaf, seed

    def trees(self, rows: DataFrame, count: int, size: int, mean: float) -> DataFrame:
        """One row a tree."""
        cuts = self.cuts

        def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if np.isnan(batch.column(1).to_numpy(zero_copy_only=False)).any():
                    raise ValueError("a label is missing")
                bins = _binned(_vectors(batch.column(2)), cuts)
                yield _batch(BINNED, batch.column(0), batch.column(1), [line.tobytes() for line in bins])

        binned = stored(rows.mapInArrow(bin_rows, BINNED), "forest-bins")
        tops = {t: {1: [LARGE if size > SUBTREE_ROWS else SMALL, -1, 0, mean]} for t in range(count)}
        while any(node[0] == LARGE for top in tops.values() for node in top.values()):
            self._split_large(binned, tops)
        dealt = binned.mapInArrow(self._dealing(tops), DEALT)
        pieces = dealt.groupBy("tree", "node").applyInArrow(self._finishing(), PIECE)
        above = [(t, *(c.tobytes() for c in _known(top, (SPLIT, LEAF)))) for t, top in tops.items() if top[1][0] != SMALL]
        if above:
            pieces = pieces.unionByName(rows.sparkSession.createDataFrame(above, PIECE))
        return pieces.groupBy("tree").applyInArrow(_assembled, TREE)

    def _placed(self, tops: dict) -> dict[int, tuple[Nodes, np.ndarray, np.ndarray]]:
        """Per tree with nodes to work on: the known nodes, the places below them, their states."""
        made = {}
        for tree, top in tops.items():
            nodes = _known(top, (SPLIT, LEAF, LARGE, SMALL))
            states = np.array([top[int(n)][0] for n in nodes.node])
            made[tree] = nodes, nodes.below(), states
        return made

    def _split_large(self, binned: DataFrame, tops: dict) -> None:
        """One level more below all large nodes: tasks count, Spark adds up, a row a node comes back."""
        layout, leaf, seed, width = self.layout, self.leaf, self.seed, len(self.cuts)
        placed = {t: p for t, p in self._placed(tops).items() if (p[2] == LARGE).any()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                ids, target = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                bins = _bins(batch.column(2), width)
                for tree, (nodes, below, states) in placed.items():
                    weight = draws(ids, tree, seed)
                    drawn = np.flatnonzero(weight)
                    at = walk(bins[drawn], nodes.feature, nodes.cut, below)
                    inside = states[at] == LARGE
                    drawn, at = drawn[inside], at[inside]
                    large, group = np.unique(at, return_inverse=True)
                    w = weight[drawn].astype(np.float64)
                    gap = target[drawn] - nodes.value[at]
                    for some in _portions(np.arange(len(large)), np.bincount(group, minlength=len(large)) * width + layout.size):
                        here = (group >= some[0]) & (group <= some[-1])
                        local = group[here] - some[0]
                        parts = [
                            layout.sums(bins[drawn[here]], local, len(some), w[here]),
                            layout.sums(bins[drawn[here]], local, len(some), (w * gap)[here]),
                            np.bincount(local, (w * gap * gap)[here], minlength=len(some))[:, None],
                        ]
                        for place, sums in zip(large[some], np.hstack(parts), strict=True):
                            key = (tree, int(nodes.node[place]))
                            found[key] = found[key] + sums if key in found else sums
                    if len(found) * (2 * layout.size + 1) > 2 * BLOCK:
                        yield _histograms(found)
                        found = {}
            if found:
                yield _histograms(found)

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
            rows, gaps, spread = sums[None, : layout.size], sums[None, layout.size : -1], sums[-1:]
            feature, cut, left, fell = layout.best(rows, gaps, spread, leaf)
            own = layout.first[1] if width > 1 else layout.size
            total, gap = rows[0, :own].sum(), gaps[0, :own].sum()
            # Means are gaps to the value that the node had so far.
            line = [key[0].as_py()], [key[1].as_py()], [total], [gap / total], feature, cut, left, fell / np.maximum(left, 1)
            return pa.Table.from_batches([_batch(CHOSEN, *line)])

        counted = binned.mapInArrow(count, HISTOGRAM).groupBy("tree", "node").applyInArrow(choose, CHOSEN)
        for row in counted.collect():  # one for each node of over SUBTREE_ROWS rows
            top, node = tops[row["tree"]], row["node"]
            base = top[node][3]
            if row["feature"] < 0:
                top[node] = [LEAF, -1, 0, base + row["value"]]
                continue
            top[node] = [SPLIT, row["feature"], row["cut"], base + row["value"]]
            right = row["rows"] - row["left_rows"]
            gap = (row["rows"] * row["value"] - row["left_rows"] * row["left_value"]) / right
            for child, size, value in ((2 * node, row["left_rows"], row["left_value"]), (2 * node + 1, right, gap)):
                deepest = child.bit_length() - 1 >= self.depth
                state = LEAF if deepest else LARGE if size > SUBTREE_ROWS else SMALL
                top[child] = [state, -1, 0, base + value]

    def _dealing(self, tops: dict):
        """Drawn rows of small nodes, those of a batch that go to one node in one row."""
        seed, width, placed = self.seed, len(self.cuts), self._placed(tops)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, target = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                bins = _bins(batch.column(2), width)
                for tree, (nodes, below, states) in placed.items():
                    weight = draws(ids, tree, seed)
                    drawn = np.flatnonzero(weight)
                    at = walk(bins[drawn], nodes.feature, nodes.cut, below)
                    inside = states[at] == SMALL
                    drawn, at = drawn[inside], at[inside]
                    if not len(drawn):
                        continue
                    order = at.argsort(kind="stable")
                    drawn, at = drawn[order], at[order]
                    lots = np.split(drawn, np.flatnonzero(np.diff(at)) + 1)
                    yield _batch(
                        DEALT, [tree] * len(lots), nodes.node[np.unique(at)], [bins[lot].tobytes() for lot in lots],
                        [target[lot].tobytes() for lot in lots], [weight[lot].astype(np.uint8).tobytes() for lot in lots],
                    )

        return deal

    def _finishing(self):
        layout, width, depth, leaf = self.layout, len(self.cuts), self.depth, self.leaf

        def finish(key: tuple, table: pa.Table) -> pa.Table:
            bins = _bins(table.column("bins"), width)
            target = np.frombuffer(b"".join(table.column("target").to_pylist()))
            weight = np.frombuffer(b"".join(table.column("weight").to_pylist()), np.uint8)
            root = key[1].as_py()
            grown = grow(layout, bins, target, weight, root, depth - root.bit_length() + 1, leaf)
            line = ([column.tobytes()] for column in grown)
            return pa.Table.from_batches([_batch(PIECE, [key[0].as_py()], *line)])

        return finish


def _known(top: dict, states: Sequence[int]) -> Nodes:
    kept = sorted(node for node, known in top.items() if known[0] in states)
    columns = ([top[node][k] for node in kept] for k in (1, 2, 3))
    kinds = (np.int16, np.uint8, np.float64)
    return Nodes(np.array(kept, np.int64), *(np.array(c, kind) for c, kind in zip(columns, kinds, strict=True)))


def _histograms(found: dict) -> pa.RecordBatch:
    trees, nodes = zip(*found, strict=True)
    return _batch(HISTOGRAM, trees, nodes, [sums.tobytes() for sums in found.values()])


def _assembled(key: tuple, table: pa.Table) -> pa.Table:
    kinds = {"node": np.int64, "feature": np.int16, "cut": np.uint8, "value": np.float64}
    read = ([np.frombuffer(x.as_py(), kind) for x in table.column(name)] for name, kind in kinds.items())
    nodes = Nodes.joined([Nodes(*part) for part in zip(*read, strict=True)])
    line = ([c.tobytes()] for c in (nodes.feature, nodes.cut, nodes.below(), nodes.value))
    return pa.Table.from_batches([_batch(TREE, [key[0].as_py()], *line)])


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """A grown forest: the folder of its trees and the cut points of its features. Predicts the mean of its trees."""

    def __init__(self, folder: str, cuts: list[list[float]]) -> None:
        super().__init__()
        self.folder, self.cuts = folder, cuts

    def trees(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(TREE).parquet(self.folder)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        place, cuts = _everywhere(dataset.sparkSession, self.folder), [np.array(c) for c in self.cuts]

        @F.arrow_udf("double")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held: list[np.ndarray] = []
            for batch in batches:
                held.append(_binned(_vectors(batch), cuts) if len(batch) else np.empty((0, len(cuts)), np.uint8))
                if sum(bins.size for bins in held) > 4 * BLOCK:
                    yield from _answers(held, place)
                    held = []
            yield from _answers(held, place)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _answers(held: list[np.ndarray], place: str) -> Iterator[pa.Array]:
    """Predictions for each of the arrays; files are read one after another, so few trees are in memory."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    if not held:
        return
    bins = np.concatenate(held)
    total, trees = np.zeros(len(bins)), 0
    store, root = fs.FileSystem.from_uri(place)
    for name in sorted(ds.dataset(root, filesystem=store, format="parquet").files) if len(bins) else ():
        for tree in ds.dataset(name, filesystem=store, format="parquet").to_table().to_pylist():
            feature, cut, below, value = (
                np.frombuffer(tree[c], kind) for c, kind in (("feature", np.int16), ("cut", np.uint8), ("below", np.int32), ("value", np.float64))
            )
            total += value[walk(bins, feature, cut, below)]
            trees += 1
    for part in np.split(total / max(trees, 1), np.cumsum([len(h) for h in held])[:-1]):
        yield pa.array(part)


def _everywhere(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that names its file system, as tasks know no default one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _write(trees: DataFrame, folder: str) -> None:
    """Files in the order of the trees: sums over them have the same last digits after every copy."""
    trees.orderBy("tree").write.option("maxRecordsPerFile", TREES_A_FILE).parquet(folder)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"cuts": self.model.cuts})
        _write(self.model.trees(), f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        model = ForestModel(f"{path}/trees", metadata["cuts"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
