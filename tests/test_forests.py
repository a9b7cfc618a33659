import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowscope import sources
from flowscope.operators import forests
from flowscope.operators.features import MAX_DEPTH, forest_importance
from flowscope.operators.forests import OPEN, Forest, Growth, Nodes, grow, route, votes_of
from flowscope.operators.models import train_forest, train_tree


@pytest.fixture(scope="module")
def noise(spark):
    """Rows whose three classes nothing tells, so that trees grow until each row stands alone."""
    rows = spark.range(600, numPartitions=3).select(
        "id", *[(F.abs(F.xxhash64("id", F.lit(i))) % 10_007 * 1.0).alias(f"x{i}") for i in range(5)],
        (F.abs(F.xxhash64("id", F.lit(9))) % 3 * 1.0).alias("label_index"))
    features = array_to_vector(F.array(*[f"x{i}" for i in range(5)]))
    return rows.withColumn("features", features).persist()


def _predicted(model, rows):
    return {r[0]: r[1:] for r in model.transform(rows).select("id", "prediction", "rawPrediction").collect()}


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    bins, label = rng.integers(0, 32, (300, 4), np.uint8), rng.integers(0, 3, 300).astype(np.int16)
    weight = rng.integers(1, 4, 300).astype(float)
    plan = Growth(1, 3, 4, 4, False, 1, 0)
    nodes, importance = grow(bins, label, weight, plan, 0, [0])

    def impurity(rows):
        totals = np.bincount(label[rows], weight[rows], 3)
        return totals.sum() - (totals ** 2).sum() / totals.sum()

    every = np.ones(300, bool)
    gains = {(f, b): impurity(every) - impurity(bins[:, f] <= b) - impurity(bins[:, f] > b)
             for f in range(4) for b in range(31)}
    assert (nodes.feature[0], nodes.bin[0]) == max(gains, key=gains.get)
    assert importance.sum() == pytest.approx(max(gains.values()))
    votes = votes_of(nodes, route(nodes, bins), 3)
    left = bins[:, nodes.feature[0]] <= nodes.bin[0]
    share = np.bincount(label[left], weight[left], 3) / weight[left].sum()
    assert votes[left][0] / 2 ** 30 == pytest.approx(share, abs=1e-8)


def test_the_driver_keeps_few_nodes_of_trees_that_cannot_learn(noise):
    forest = Forest(noise, 8, 1, MAX_DEPTH, "label_index", limit=100)
    above = sum(len(t.feature) for t in forest.tops)
    model = forest.model()
    nodes = sum(len(r.feature) // 2 for r in model.tables.collect())
    assert 8 < above < nodes / 10
    assert all(r[0] == r[1][0] for r in zip(
        [r[0] for r in noise.orderBy("id").select("label_index").collect()],
        [v for _, v in sorted(_predicted(Forest(noise, 1, 1, MAX_DEPTH, "label_index", single=True, limit=100).model(), noise).items())]))


def test_the_driver_keeps_few_nodes_of_a_tree_that_cannot_learn(noise, monkeypatch):
    kept = []

    def growing(*args):
        kept.extend(forests_grow_tops(*args[:3], 100))
        return kept

    forests_grow_tops = forests._grow_tops
    monkeypatch.setattr(forests, "_grow_tops", growing)
    model = train_tree(noise)
    nodes = sum(len(r.feature) // 2 for r in model.tables.collect())
    assert 1 < sum(len(t.feature) for t in kept) < nodes / 5
    said = _predicted(model, noise)
    assert all(r.label_index == said[r.id][0] for r in noise.select("id", "label_index").collect())


def test_rows_sent_to_subtrees_get_the_votes_of_the_whole_model(noise):
    model = Forest(noise, 8, 1, MAX_DEPTH, "label_index", limit=100).model()
    whole = _predicted(model, noise)
    more = noise.unionByName(noise.withColumn("id", F.col("id") + 600))
    model.small = 0
    sent = _predicted(model, more)
    assert len(sent) == 1200 and all(sent[i] == whole[i % 600] for i in sent)


def _packed(rows, classes, seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 32, (rows, 4), np.uint8)
    label, weight = rng.integers(0, classes, rows).astype(np.int16), rng.random(rows) + 0.5
    return bins, label, weight, pa.RecordBatch.from_pydict({
        "block": pa.array([7], pa.int64()), "bins": [bins.tobytes()], "label": [label.tobytes()],
        "weight": [weight.tobytes()]})


def test_counts_above_the_border_are_those_of_the_rows_that_arrive():
    plan = Growth(2, 3, 4, 2, True, 30, 1)
    top = Nodes(*map(np.array, ([2, 0, -1, -1, -1], [15, 9, 0, 0, 0], [1, 3, 0, 0, 0], [OPEN] * 5)), np.zeros((0, 3), np.int64))
    bins, label, weight, batch = _packed(500, 3, 4)
    counted = [r for b in forests._count(plan, [top, top], {0: [2, 3], 1: [4]})(iter([batch])) for r in b.to_pylist()]
    assert {(r["tree"], r["node"]) for r in counted} == {(0, 2), (0, 3), (1, 4)}
    for r in counted:
        counts = np.frombuffer(r["counts"]).reshape(2, 32, 4)
        taken, w = forests._bag(plan, r["tree"], 7, weight)
        here = route(top, bins[taken]) == r["node"]
        for j, f in enumerate(forests._subset(plan, r["tree"], r["node"])):
            for b in range(32):
                own = here & (bins[taken, f] == b)
                assert counts[j, b, :3] == pytest.approx(np.bincount(label[taken][own], w[own], 3))
                assert counts[j, b, 3] == own.sum()


def test_trees_that_ended_above_are_asked_for_no_rows(monkeypatch):
    plan = Growth(2, 3, 4, 2, True, 30, 1)
    leaves = Nodes(*map(np.array, ([0, -1, -1], [15, 0, 0], [1, 0, 0], [OPEN, 1, 2])), np.zeros((0, 3), np.int64))
    *_, batch = _packed(500, 3, 4)
    asked = []
    monkeypatch.setattr(forests, "_bag", lambda *a: asked.append(a[1]))
    assert list(forests._deal(plan, [leaves, leaves], [[0, 1, 1]] * 2)(iter([batch]))) == []
    assert not asked


def test_depth_is_kept_across_the_border(noise):
    for limit in (100, 10_000):
        forest = Forest(noise, 3, 1, 4, "label_index", limit=limit)
        tops = [t.nodes(3) for t in forest.tops]
        grown = forest.grown().collect()
        for tree, top in enumerate(tops):
            deepest = max(forest.tops[tree].depth)
            for r in grown:
                if r["tree"] == tree:
                    assert top.value[r["leaf"]] == OPEN
                    left, feature = np.frombuffer(r["left"], np.int32), np.frombuffer(r["feature"], np.int16)
                    depth = {0: forest.tops[tree].depth[r["leaf"]]}
                    for i in np.flatnonzero(feature >= 0):
                        depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
                    deepest = max(deepest, *depth.values())
            assert deepest == 4


def test_importance_is_the_same_kind_above_and_below(spark):
    rows = spark.range(2_000).select(
        (F.abs(F.xxhash64("id")) % 1000 * 1.0).alias("x"), (F.abs(F.xxhash64("id", F.lit(1))) % 1000 * 1.0).alias("noise"),
        (F.abs(F.xxhash64("id")) % 1000 >= 500).cast("double").alias("label_index"))
    for limit in (100, 10_000):
        data = rows.withColumn("features", array_to_vector(F.array("noise", "x")))
        shares = Forest(data, 5, 1, MAX_DEPTH, "label_index", limit=limit).importances()
        assert shares[1] > 0.9 and shares.sum() == pytest.approx(1.0)
    found = forest_importance(rows, ["noise", "x"], trees=5)
    assert found.orderBy(F.desc("importance")).first()["feature"] == "x"


def test_a_forest_is_saved_and_loaded(spark, noise, tmp_path):
    model = train_forest(noise, trees=4)
    sources.save_model(model, str(tmp_path / "model"))
    loaded = sources.load_model(str(tmp_path / "model"))
    assert _predicted(loaded, noise) == _predicted(model, noise)


def test_rows_without_a_class_are_an_error(noise):
    odd = noise.withColumn("label_index", F.when(F.col("id") != 5, F.col("label_index")))
    with pytest.raises(Exception, match="labels must be whole numbers"):
        Forest(odd, 2, 1, MAX_DEPTH, "label_index")
    with pytest.raises(ValueError):
        Forest(noise.filter("id < 0"), 2, 1, MAX_DEPTH, "label_index")
