"""Trees and forests of any depth, whose lower parts are grown in tasks and kept as a table.

Features are cut into at most 32 bins. While a node holds more than ``LIMIT`` rows, all tasks
add up its counts per feature, bin and class, and the driver learns the best split alone. The
rows of a smaller node go to one task, which grows everything below it. These subtrees are one
table in the shared folder; the driver keeps the few nodes above them.

Splits, bags, feature subsets and importances follow the usual forest: Gini impurity,
Poisson(1) bags, for forests sqrt(features) anew at every node, growth until a node is pure, no
split gains anything, or the depth is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.sizing import stored

MAX_BINS = 32
#: rows of a node that one task takes over
LIMIT = 32_768
#: rows in one packed block
BLOCK = 8_192
#: bytes of a model that every task may hold whole
SMALL_MODEL = 32 << 20
#: a vote is a whole number, so that sums do not depend on the order of trees
VOTE = 1 << 30
#: in place of a subtree's leaf: the nodes above the subtrees
TOP = -1


class Growth(NamedTuple):
    """What every task has to know."""

    trees: int
    classes: int
    features: int
    chosen: int  # features that a node may split by
    bagged: bool
    max_depth: int
    seed: int
    bins: int = MAX_BINS


class Nodes(NamedTuple):
    """A tree as arrays; ``feature`` is -1 in leaves, the right child stands behind the left one.

    ``value`` of a leaf is its class, or, in leaves of several, the number of classes plus a
    row of ``votes``. ``OPEN`` stands for a subtree.
    """

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    votes: np.ndarray


OPEN = -1
NODES = "tree int, leaf int, feature binary, bin binary, left binary, value binary, votes binary"
GROWN = f"{NODES}, importance array<double>"


def _bytes(nodes: Nodes) -> tuple[bytes, ...]:
    kinds = (np.int16, np.uint8, np.int32, np.int32, np.int64)
    return tuple(x.astype(kind).tobytes() for x, kind in zip(nodes, kinds))


def _nodes(row, classes: int) -> Nodes:
    return Nodes(
        np.frombuffer(row.feature, np.int16), np.frombuffer(row.bin, np.uint8),
        np.frombuffer(row.left, np.int32), np.frombuffer(row.value, np.int32),
        np.frombuffer(row.votes, np.int64).reshape(-1, classes))


def route(nodes: Nodes, bins: np.ndarray) -> np.ndarray:
    """The node without children that each row ends in."""
    at = np.zeros(len(bins), np.int64)
    moving = np.flatnonzero(nodes.feature[at] >= 0)
    while len(moving):
        here = at[moving]
        right = bins[moving, nodes.feature[here]] > nodes.bin[here]
        at[moving] = nodes.left[here] + right
        moving = moving[nodes.feature[at[moving]] >= 0]
    return at


def votes_of(nodes: Nodes, at: np.ndarray, classes: int) -> np.ndarray:
    """Votes for each class of rows that end in the leaves ``at``."""
    value = nodes.value[at]
    votes = np.zeros((len(at), classes), np.int64)
    pure = value < classes
    votes[pure, value[pure]] = VOTE
    votes[~pure] = nodes.votes[value[~pure] - classes]
    return votes


def _leaf(totals: np.ndarray, votes: list, classes: int) -> int:
    """The value of a leaf with these class weights; mixed ones add a row to ``votes``."""
    if (totals > 0).sum() == 1:
        return int(totals.argmax())
    votes.append(np.round(totals / totals.sum() * VOTE).astype(np.int64))
    return classes + len(votes) - 1


# --- rows ------------------------------------------------------------------------------

def thresholds(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Up to 31 borders per feature: between all values where these are few, else by quantiles."""
    entries = rows.select(F.posexplode("features").alias("feature", "value"))
    shares = [i / MAX_BINS for i in range(MAX_BINS + 1)]
    about = entries.groupBy("feature").agg(
        F.approx_count_distinct("value").alias("n"), F.percentile_approx("value", shares, 1_000).alias("cuts")).collect()
    values = {r["feature"]: sorted(set(r["cuts"])) for r in about}
    few = [r["feature"] for r in about if r["n"] <= 2 * MAX_BINS]
    if few:
        found = entries.filter(F.col("feature").isin(few)).groupBy("feature").agg(F.collect_set("value").alias("all"))
        values |= {r["feature"]: sorted(r["all"]) for r in found.collect() if len(r["all"]) <= MAX_BINS}
    borders = []
    for i in range(features):
        v = np.array(values[i], float)
        borders.append(np.unique(v[:-1] / 2 + v[1:] / 2)[:MAX_BINS - 1])
    return borders


def binned(values: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Number of borders below each value."""
    out = np.empty(values.shape, np.uint8)
    for i, border in enumerate(borders):
        out[:, i] = np.searchsorted(border, values[:, i], "left")
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _pack(borders: list[np.ndarray]):
    """Rows to blocks of bins, classes and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                bins = binned(_matrix(part.column("features"), len(borders)), borders)
                label = part.column("label").to_numpy().astype(np.int16)
                weight = part.column("weight").to_numpy().astype(float)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "bins": [bins.tobytes()],
                    "label": [label.tobytes()], "weight": [weight.tobytes()]})
                block += 1

    return run


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["block"], np.frombuffer(row["bins"], np.uint8).reshape(-1, features),
                   np.frombuffer(row["label"], np.int16), np.frombuffer(row["weight"]))


def _drawn(plan: Growth, tree: int, block: int, weight: np.ndarray) -> np.ndarray:
    """What each row weighs in a tree, 0 where it takes no part; the same whenever it is asked."""
    if plan.bagged:
        return weight * np.random.default_rng([plan.seed, tree, block]).poisson(1.0, len(weight))
    return weight


def _bag(plan: Growth, tree: int, block: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that a tree takes, and their weights."""
    weight = _drawn(plan, tree, block, weight)
    taken = np.flatnonzero(weight > 0)
    return taken, weight[taken]


# --- the nodes above -------------------------------------------------------------------

def _subset(plan: Growth, tree: int, node: int) -> np.ndarray:
    if plan.chosen >= plan.features:
        return np.arange(plan.features)
    return np.random.default_rng([plan.seed, tree, node, 0]).permutation(plan.features)[:plan.chosen]


COUNTS = "tree int, node int, counts binary"


def _towards(nodes: Nodes, wanted: list[int]) -> set[int]:
    """The ``wanted`` nodes and all above them."""
    above = {int(child): i for i in np.flatnonzero(nodes.feature >= 0) for child in (nodes.left[i], nodes.left[i] + 1)}
    found = set()
    for node in wanted:
        while node is not None and node not in found:
            found.add(node)
            node = above.get(node)
    return found


def _arriving(nodes: Nodes, wanted: list[int], way: set[int], columns: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    """The ``wanted`` nodes with their rows in order; other rows are left as soon as they turn off the ``way``."""
    ends, waiting = set(wanted), [(0, rows)]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        if node in ends:
            yield node, rows
            continue
        left = int(nodes.left[node])
        right = columns[nodes.feature[node]][rows] > nodes.bin[node]
        if left in way:
            waiting.append((left, rows[~right]))
        if left + 1 in way:
            waiting.append((left + 1, rows[right]))


def _count(plan: Growth, tops: list[Nodes], active: dict[int, list[int]]):
    """Weights per chosen feature, bin and class of every active node, and rows in the last place."""
    width = plan.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        ways = {tree: _towards(tops[tree], nodes) for tree, nodes in active.items()}
        subsets = {(tree, node): _subset(plan, tree, node) for tree, nodes in active.items() for node in nodes}

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "tree": pa.array([k[0] for k in found], pa.int32()),
                "node": pa.array([k[1] for k in found], pa.int32()),
                "counts": [x.tobytes() for x in found.values()]})
            found.clear()
            return out

        for block, bins, label, weight in _blocks(batches, plan.features):
            columns, y = np.ascontiguousarray(bins.T), label.astype(np.int64)
            for tree, nodes in active.items():
                w = _drawn(plan, tree, block, weight)
                for node, here in _arriving(tops[tree], nodes, ways[tree], columns, np.flatnonzero(w > 0)):
                    counts = found.setdefault((tree, node), np.zeros((plan.chosen, plan.bins, width)))
                    own_y, own_w = y[here], w[here]
                    for j, f in enumerate(subsets[tree, node]):
                        own = columns[f][here]
                        cell = own * np.int64(plan.classes) + own_y
                        size = plan.bins * plan.classes
                        counts[j, :, :-1] += np.bincount(cell, own_w, size).reshape(-1, plan.classes)
                        counts[j, :, -1] += np.bincount(own, minlength=plan.bins)
                if len(found) > 1_000:
                    yield full()
        if found:
            yield full()

    return run


SPLIT = "tree int, node int, feature int, bin int, gain double, left array<double>, right array<double>"


def _split(plan: Growth):
    """The best split of one node from the counts of all tasks; without gain, ``feature`` is -1."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, node = key
        counts = sum(np.frombuffer(x) for x in rows["counts"]).reshape(plan.chosen, plan.bins, -1)
        left = counts.cumsum(1)
        right = left[:, -1:] - left
        gain = _gain(left[..., :-1], right[..., :-1])
        # equal gains: the first feature and bin of the subset
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        total = left[j, -1]
        if gain[j, b] > _least(total[:-1].sum()):
            best = (int(_subset(plan, tree, node)[j]), int(b), float(gain[j, b]), left[j, b], right[j, b])
        else:
            best = (-1, 0, 0.0, total, total)
        return pd.DataFrame([(tree, node, *best)], columns=["tree", "node", "feature", "bin", "gain", "left", "right"])

    return run


def _least(weight: float) -> float:
    """A gain that is more than the rounding of sums up to ``weight``."""
    return 1e-12 * weight


def _gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weight times the fall of the Gini impurity; below 0 where a side is empty."""
    both = left + right
    wl, wr, w = left.sum(-1), right.sum(-1), both.sum(-1)
    empty = (wl <= _least(1.0) * w) | (wr <= _least(1.0) * w)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left ** 2).sum(-1) / wl + (right ** 2).sum(-1) / wr - (both ** 2).sum(-1) / w
    return np.where(empty, -1.0, gain)


class _Top:
    """The nodes of one tree above its subtrees, while they are grown."""

    def __init__(self, features: int):
        self.feature, self.bin, self.left, self.value, self.depth = [-1], [0], [0], [OPEN], [0]
        self.votes: list[np.ndarray] = []
        self.importance = np.zeros(features)

    def nodes(self, classes: int) -> Nodes:
        votes = np.array(self.votes, np.int64).reshape(-1, classes)
        return Nodes(*map(np.array, (self.feature, self.bin, self.left, self.value)), votes)

    def put(self, split, plan: Growth, limit: int) -> list[int]:
        """Takes a split of a node; the children that are still too large."""
        node = split["node"]
        if split["feature"] < 0:
            self.value[node] = _leaf(np.array(split["left"][:-1]), self.votes, plan.classes)
            return []
        self.feature[node], self.bin[node] = split["feature"], split["bin"]
        self.left[node] = len(self.feature)
        self.importance[split["feature"]] += split["gain"]
        large = []
        for side in (split["left"], split["right"]):
            totals, rows = np.array(side[:-1]), side[-1]
            child, depth = len(self.feature), self.depth[node] + 1
            # sums of weights by difference: what is left of nothing is rounding
            totals[totals <= _least(1.0) * totals.sum()] = 0
            done = depth >= plan.max_depth or (totals > 0).sum() <= 1
            value = _leaf(totals, self.votes, plan.classes) if done else OPEN
            for column, x in zip((self.feature, self.bin, self.left, self.value, self.depth), (-1, 0, 0, value, depth)):
                column.append(x)
            if not done and rows > limit:
                large.append(child)
        return large


def _grow_tops(blocks: DataFrame, plan: Growth, rows: int, limit: int) -> list[_Top]:
    tops = [_Top(plan.features) for _ in range(plan.trees)]
    active = {tree: [0] for tree in range(plan.trees)} if rows > limit and plan.max_depth else {}
    while active:
        counted = blocks.mapInArrow(_count(plan, [t.nodes(plan.classes) for t in tops], active), COUNTS)
        found = counted.groupBy("tree", "node").applyInPandas(_split(plan), SPLIT).collect()
        active = {}
        for split in sorted(found, key=lambda r: (r["tree"], r["node"])):
            large = tops[split["tree"]].put(split, plan, limit)
            if large:
                active.setdefault(split["tree"], []).extend(large)
    return tops


# --- the subtrees ----------------------------------------------------------------------

CHUNK = "tree int, leaf int, depth int, block long, bins binary, label binary, weight binary"


def _deal(plan: Growth, tops: list[Nodes], depths: list[list[int]]):
    """The rows of every open node of every tree, packed."""

    # a tree that ended above asks for no rows
    unfinished = [(tree, top) for tree, top in enumerate(tops) if ((top.value == OPEN) & (top.feature < 0)).any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bins, label, weight in _blocks(batches, plan.features):
            for tree, top in unfinished:
                taken, w = _bag(plan, tree, block, weight)
                own, y = bins[taken], label[taken]
                at = route(top, own)
                out = []
                for leaf in np.unique(at):
                    if top.value[leaf] == OPEN:
                        here = at == leaf
                        out.append((tree, int(leaf), depths[tree][leaf], block, own[here].tobytes(),
                                    y[here].tobytes(), w[here].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, kind) for x, kind in zip(zip(*out), _CHUNK_TYPES)], names=_CHUNK_NAMES)

    return run


_CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]
_CHUNK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def grow(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, plan: Growth, depth: int, seed: list[int]
) -> tuple[Nodes, np.ndarray]:
    """A whole tree over rows in memory, level by level, and the weighted gain per feature."""
    classes, rng = plan.classes, np.random.default_rng(seed)
    importance = np.zeros(plan.features)
    feature, split_bin, left, value, votes = [], [], [], [], []
    rows = np.arange(len(label))
    node = np.zeros(len(label), np.int64)  # of each row, among those of the level
    width, placed = 1, 0
    y, w = label.astype(np.int64), weight
    least = _least(weight.sum())
    while width:
        totals = np.bincount(node * classes + y[rows], w[rows], width * classes).reshape(width, classes)
        level_feature = np.full(width, -1, np.int64)
        level_bin = np.zeros(width, np.int64)
        level_left = np.zeros(width, np.int64)
        level_value = np.full(width, OPEN, np.int64)
        mixed = (totals > 0).sum(1) > 1
        if depth < plan.max_depth and mixed.any():
            # rows of pure nodes are done
            kept = mixed[node]
            rows, node = rows[kept], node[kept]
            gain, by, at = _best(bins, rows, node, y, w, totals, plan, rng)
            cut = mixed & (gain > least)
        else:
            cut = np.zeros(width, bool)
        ends = np.flatnonzero(~cut)
        level_value[ends] = totals[ends].argmax(1)
        for i in ends[mixed[ends]]:
            level_value[i] = _leaf(totals[i], votes, classes)
        inner = np.flatnonzero(cut)
        if len(inner):
            level_feature[inner], level_bin[inner] = by[inner], at[inner]
            level_left[inner] = placed + width + 2 * np.arange(len(inner))
            np.add.at(importance, by[inner], gain[inner])
            kept = cut[node]
            rows, node = rows[kept], node[kept]
            number = np.cumsum(cut) - 1
            node = 2 * number[node] + (bins[rows, by[node]] > at[node])
        for column, level in zip((feature, split_bin, left, value), (level_feature, level_bin, level_left, level_value)):
            column.append(level)
        placed += width
        width, depth = 2 * len(inner), depth + 1
    parts = [np.concatenate(x) for x in (feature, split_bin, left, value)]
    return Nodes(*parts, np.array(votes, np.int64).reshape(-1, classes)), importance


def _best(bins, rows, node, y, w, totals, plan: Growth, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain, feature and bin of each node of a level, over runs of rows of equal node and bin."""
    width, classes = totals.shape
    if plan.chosen < plan.features:
        drawn = rng.random((width, plan.features))
        subset = np.argpartition(drawn, plan.chosen - 1, axis=1)[:, :plan.chosen]
    else:
        subset = np.broadcast_to(np.arange(plan.features), (width, plan.features))
    best, by, at = np.full(width, -1.0), np.zeros(width, np.int64), np.zeros(width, np.int64)
    own_y, own_w = y[rows], w[rows]
    places, shift = np.arange(len(rows)), len(rows).bit_length()
    for j in range(plan.chosen):
        key = node * plan.bins + bins[rows, subset[node, j]]
        # rows of a key stay in order; sorting whole numbers is faster than sorting places
        placed = np.sort((key << shift) + places)
        ordered, order = placed >> shift, placed & ((1 << shift) - 1)
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        run_node = ordered[first] // plan.bins
        runs = np.bincount(run * classes + own_y[order], own_w[order], len(first) * classes).reshape(-1, classes)
        left = runs.cumsum(0)
        starts = np.flatnonzero(np.r_[True, run_node[1:] != run_node[:-1]])
        before = np.vstack([np.zeros(classes), left[starts[1:] - 1]])
        left -= np.repeat(before, np.diff(np.r_[starts, len(first)]), axis=0)
        gain = _gain(left, totals[run_node] - left)
        gain[np.r_[starts[1:] - 1, len(first) - 1]] = -1.0  # nothing stands to the right
        here = run_node[starts]
        top = np.maximum.reduceat(gain, starts)
        better = top > best[here]
        is_top = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[starts, len(first)])))
        where = np.empty(width, np.int64)
        where[run_node[is_top][::-1]] = is_top[::-1]  # the first of equals
        nodes = here[better]
        best[nodes] = top[better]
        by[nodes] = subset[nodes, j]
        at[nodes] = ordered[first[where[nodes]]] % plan.bins
    return best, by, at


def _grow_group(plan: Growth):
    def run(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        tree, leaf = key
        chunks = chunks.sort_values("block")
        bins = np.frombuffer(b"".join(chunks["bins"]), np.uint8).reshape(-1, plan.features)
        label = np.frombuffer(b"".join(chunks["label"]), np.int16)
        weight = np.frombuffer(b"".join(chunks["weight"]))
        nodes, importance = grow(
            bins, label, weight, plan, int(chunks["depth"].iloc[0]), [plan.seed, tree, leaf, 1])
        return pd.DataFrame([(tree, leaf, *_bytes(nodes), importance)], columns=_GROWN_NAMES)

    return run


_GROWN_NAMES = [c.split()[0] for c in GROWN.split(", ")]


def _checked(label: str) -> Column:
    """The class as a number; as in the usual classifiers, a row without a class is an error."""
    y = F.col(label).cast("double")
    wrong = y.isNull() | F.isnan(y) | (y < 0) | (y != F.floor(y))
    return F.when(wrong, F.raise_error(F.lit("labels must be whole numbers from 0, not null"))).otherwise(y)


class Forest:
    """A grown forest: the nodes above, the table of subtrees, and sums of gains."""

    def __init__(
        self, train: DataFrame, trees: int, seed: int, max_depth: int, label: str, features: str = "features",
        weight: str | None = None, single: bool = False, limit: int = LIMIT,
    ):
        """``single``: one tree, over all rows and all features."""
        weights = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = train.select(
            vector_to_array(features).alias("features"), _checked(label).alias("label"), weights.alias("weight")).persist()
        try:
            size = rows.agg(
                F.count("*").alias("n"), F.max("label").alias("top"), F.max(F.size("features")).alias("wide")).first()
            if not size["n"]:
                raise ValueError("there are no rows to learn from")
            n_features = size["wide"]
            chosen = n_features if single or trees == 1 else math.ceil(math.sqrt(n_features))
            self.plan = Growth(
                trees, int(size["top"]) + 1, n_features, chosen, not single, max_depth, seed & 0xFFFFFFFF)
            self.rows = size["n"]
            self.borders = thresholds(rows, n_features)
            self.blocks = stored(rows.mapInArrow(_pack(self.borders), "block long, bins binary, label binary, weight binary"))
        finally:
            rows.unpersist()
        self.tops = _grow_tops(self.blocks, self.plan, self.rows, limit)

    def grown(self) -> DataFrame:
        """One row per subtree, not yet computed."""
        plan = self.plan
        tops = [t.nodes(plan.classes) for t in self.tops]
        groups = sum(int((t.value == OPEN).sum()) - int((t.feature >= 0).sum()) for t in tops)
        chunks = self.blocks.mapInArrow(_deal(plan, tops, [t.depth for t in self.tops]), CHUNK)
        # the sizes say little about the work, so the number of tasks is given
        partitions = int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(groups, max(partitions, groups // 16)))
        return chunks.repartition(tasks, "tree", "leaf").groupBy("tree", "leaf").applyInPandas(_grow_group(plan), GROWN)

    def importances(self) -> np.ndarray:
        """Shares of the gain per feature, each tree counting the same."""
        d = self.plan.features
        gains = np.array([t.importance for t in self.tops])
        # packed arrays would be summed in any order; a column each keeps it plain
        sums = self.grown().groupBy("tree").agg(*[F.sum(F.get("importance", F.lit(i))).alias(f"g{i}") for i in range(d)])
        for row in sums.collect():
            gains[row["tree"]] += np.array(row[1:])
        totals = gains.sum(1, keepdims=True)
        shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).sum(0)
        return shares / shares.sum() if shares.sum() > 0 else shares

    def model(self, features: str = "features") -> ForestModel:
        plan, spark = self.plan, self.blocks.sparkSession
        tops = [(i, TOP, *_bytes(t.nodes(plan.classes))) for i, t in enumerate(self.tops)]
        below = stored(self.grown().drop("importance"))
        tables = below.unionByName(spark.createDataFrame(tops, NODES))
        about = {"trees": plan.trees, "classes": plan.classes, "rows": self.rows, "features": features,
                 "borders": [b.tolist() for b in self.borders]}
        return ForestModel(about, tables)


# --- the model -------------------------------------------------------------------------

class ForestModel(Model, MLWritable, MLReadable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``, the mean of the trees' leaves.

    A model of up to ``small`` bytes goes to all tasks, and so does every model on a stream.
    Otherwise rows go to the subtrees they end in: they are stored, and sent once per tree.
    """

    def __init__(self, about: dict | None = None, tables: DataFrame | None = None, small: int = SMALL_MODEL):
        super().__init__()
        self.about, self.tables, self.small = about, tables, small
        self._whole = None
        self._size = None

    def _bytes(self) -> int:
        if self._size is None:
            parts = [F.length(c) for c in ("feature", "bin", "left", "value", "votes")]
            self._size = self.tables.agg(F.sum(sum(parts[1:], parts[0]))).first()[0]
        return self._size

    def _broadcast(self):
        if self._whole is None:
            c = self.about["classes"]
            found = {(r.tree, r.leaf): _nodes(r, c) for r in self.tables.toArrow().to_pandas().itertuples()}
            self._whole = self.tables.sparkSession.sparkContext.broadcast(found)
        return self._whole

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if dataset.isStreaming or self._bytes() <= self.small:
            raw = _raw_of(self.about, self._broadcast())(vector_to_array(self.about["features"]))
            voted = dataset.withColumn("_raw", raw)
        else:
            voted = self._sent(dataset)
        total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
        shares = F.transform("_raw", lambda x: x / total)
        best = F.array_position("_raw", F.array_max("_raw")) - F.lit(1)
        return voted.withColumns({
            "rawPrediction": array_to_vector("_raw"), "probability": array_to_vector(shares),
            "prediction": best.cast("double")}).drop("_raw")

    def _sent(self, dataset: DataFrame) -> DataFrame:
        about = self.about
        rows = stored(dataset.withColumn("_row", F.monotonically_increasing_id()))
        tops = {r.tree: _nodes(r, about["classes"]) for r in self.tables.filter(F.col("leaf") == TOP).collect()}
        asked = rows.select("_row", vector_to_array(about["features"]).alias("features")).mapInArrow(_ask(about, tops), ASKED)
        # more rows than it was grown from go to copies of a subtree
        salts = max(1, math.ceil(rows.count() / about["rows"]))
        below = self.tables.filter(F.col("leaf") != TOP).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        sent = asked.filter(F.col("leaf") != TOP).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        keys = ["tree", "leaf", "salt"]
        answers = sent.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInPandas(_answer(about), ANSWER)
        above = asked.filter(F.col("leaf") == TOP).select("block", "rows", "votes")
        sums = above.unionByName(answers).groupBy("block").applyInPandas(_sums(about), "_row long, _raw array<double>")
        return rows.join(sums, "_row").drop("_row")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _raw_of(about: dict, whole):
    classes, borders = about["classes"], [np.array(b) for b in about["borders"]]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def raw(features: pa.Array) -> pa.Array:
        bins = binned(_matrix(features, len(borders)), borders)
        votes = np.zeros((len(bins), classes), np.int64)
        for tree in range(about["trees"]):
            top = whole.value[tree, TOP]
            at = route(top, bins)
            for leaf in np.unique(at):
                here = np.flatnonzero(at == leaf)
                if top.value[leaf] == OPEN:
                    below = whole.value[tree, int(leaf)]
                    votes[here] += votes_of(below, route(below, bins[here]), classes)
                else:
                    votes[here] += votes_of(top, at[here], classes)
        flat = pa.array((votes / VOTE).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * classes), flat)

    return raw


ASKED = "tree int, leaf int, block long, rows binary, bins binary, votes binary"
ANSWER = "block long, rows binary, votes binary"


def _ask(about: dict, tops: dict[int, Nodes]):
    """Rows to what each tree's subtree is asked; the leaves above answer here."""
    classes, borders = about["classes"], [np.array(b) for b in about["borders"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column("_row").to_numpy()
                bins = binned(_matrix(part.column("features"), len(borders)), borders)
                votes = np.zeros((len(ids), classes), np.int64)
                for tree, top in tops.items():
                    at, out = route(top, bins), []
                    for leaf in np.unique(at):
                        here = np.flatnonzero(at == leaf)
                        if top.value[leaf] == OPEN:
                            out.append((tree, int(leaf), block, ids[here].tobytes(), bins[here].tobytes(), None))
                        else:
                            votes[here] += votes_of(top, at[here], classes)
                    if out:
                        yield _asked(out)
                yield _asked([(TOP, TOP, block, ids.tobytes(), None, votes.tobytes())])
                block += 1

    return run


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ASKED.split(", ")])


def _answer(about: dict):
    classes, features = about["classes"], len(about["borders"])

    def run(key: tuple, chunks: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(chunks):
            below = _nodes(next(subtree.itertuples()), classes)
            for chunk in chunks.itertuples():
                bins = np.frombuffer(chunk.bins, np.uint8).reshape(-1, features)
                at = route(below, bins)
                out.append((chunk.block, chunk.rows, votes_of(below, at, classes).astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["block", "rows", "votes"])

    return run


def _sums(about: dict):
    classes = about["classes"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in rows["rows"]]
        ids = np.frombuffer(b"".join(rows["rows"]), np.int64)
        # sums of the leaves above take eight bytes, single votes four
        votes = [np.frombuffer(x, np.int64 if len(x) == n * classes * 8 else np.int32).reshape(n, classes)
                 for x, n in zip(rows["votes"], sizes)]
        different, place = np.unique(ids, return_inverse=True)
        total = np.zeros((len(different), classes), np.int64)
        np.add.at(total, place, np.concatenate(votes))
        return pd.DataFrame({"_row": different, "_raw": list(total / VOTE)})

    return run


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"forest": self.model.about})
        self.model.tables.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(found["forest"], self.sparkSession.read.schema(NODES).parquet(f"{path}/trees"))
        model._resetUid(found["uid"])
        return model
