import math

import pytest
from pyspark.sql import functions as F

from flowscope.functions import class_name
from flowscope.operators.features import (
    apply_scaler,
    assemble,
    balanced_weights,
    class_list,
    encode_label,
    fit_scaler,
    forest_importance,
    stratified_split,
    top_features,
)


def labelled(spark, n=900):
    """A third of the rows in class a; ``x`` tells the classes apart, ``noise`` does not."""
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 5 = 0 THEN 'b' ELSE 'c' END AS label",
        "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 5 = 0 THEN 10 ELSE 20 END + (id % 7) / 10 AS x",
        "cast(hash(id) % 100 AS double) AS noise")


def test_encode_label(spark):
    df = spark.createDataFrame([("spoofing",), ("ddos",), ("scanning",), ("normal",)], "label string")
    want = {"ddos": 0.0, "normal": 1.0, "scanning": 2.0, "spoofing": 3.0}
    for got in (encode_label(df), encode_label(df, list(want))):
        assert {r["label"]: r["label_index"] for r in got.collect()} == want
    names = class_list(df)
    back = encode_label(df).select("label", class_name("label_index", names).alias("back"))
    assert all(r["label"] == r["back"] for r in back.collect())
    assert encode_label(df, ["ddos"]).filter("label = 'normal'").first()["label_index"] is None


def test_split_of_the_fixture(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 10 + i) for i in range(5)],
                               "label string, id int")
    got = stratified_split(df, key="id")
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 2, ("a", "train"): 8, ("b", "test"): 1, ("b", "train"): 4}
    again = stratified_split(df.orderBy(F.desc("id")), key="id")
    assert set(map(tuple, got.collect())) == set(map(tuple, again.collect()))
    other = stratified_split(df, key="id", seed=1)
    assert set(map(tuple, got.collect())) != set(map(tuple, other.collect()))


@pytest.mark.parametrize("prefix", [0, 1, 2, 4])
@pytest.mark.parametrize("key", ["id", None])
def test_split_is_exact_for_any_prefix(spark, prefix, key):
    df = labelled(spark)
    got = stratified_split(df, key=key, prefix=prefix)
    assert got.count() == 900 and got.select("id").distinct().count() == 900
    for r in got.groupBy("label").agg(
            F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == math.floor(0.2 * r["n"] + 0.5)
    lowest = got.withColumn("h", F.md5(F.concat_ws("|", "id", F.lit("42"))))
    if key:
        edges = lowest.groupBy("label").agg(
            F.max(F.when(F.col("split") == "test", F.col("h"))).alias("a"),
            F.min(F.when(F.col("split") == "train", F.col("h"))).alias("b"))
        assert edges.filter("a >= b").count() == 0


def test_a_class_too_small_for_a_test_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "label string, id int")
    assert stratified_split(df, key="id").filter("split = 'test'").count() == 0


def test_copies_fall_on_one_side(spark):
    df = spark.createDataFrame([("a", 7)] * 50 + [("a", i) for i in range(100, 150)],
                               "label string, v int")
    sides = stratified_split(df).filter("v = 7").select("split").distinct()
    assert sides.count() == 1
    assert stratified_split(df).count() == 100


def test_importance_and_top_features(spark):
    imp = forest_importance(encode_label(labelled(spark)), ["noise", "x"], trees=10)
    assert sum(r["importance"] for r in imp.collect()) == pytest.approx(1.0)
    assert top_features(imp, 1).first()["feature"] == "x"
    ties = spark.createDataFrame([("p", 0.5, 0), ("q", 0.5, 1), ("r", 0.0, 2)],
                                 "feature string, importance double, pos int")
    assert [r["feature"] for r in top_features(ties, 2).collect()] == ["p", "q"]


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    stats = fit_scaler(train, ["x", "c"])
    assert {r["column"]: (r["mean"], r["std"]) for r in stats.collect()} == {
        "x": (2.0, 1.0), "c": (5.0, 1.0)}
    test = spark.createDataFrame([(4.0, 8.0)], "x double, c double")
    assert tuple(apply_scaler(test, stats).first()) == (2.0, 3.0)
    scaled = apply_scaler(labelled(spark), fit_scaler(labelled(spark), ["x", "noise"]))
    row = scaled.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)


def test_assemble(spark):
    df = spark.createDataFrame([(1.0, 2)], "a double, b long")
    assert list(assemble(df, ["b", "a"]).first()["features"]) == [2.0, 1.0]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "label_index double")
    got = {r["label_index"]: r["weight"] for r in balanced_weights(df).collect()}
    assert got == {0.0: 4 / (2 * 3), 1.0: 4 / 2}


def library_test_rows(sizes, test):
    """How the usual library shares out the rows: train by largest remainders, the rest is test."""
    total = sum(sizes.values())
    train = total - math.ceil(test * total)
    whole = {c: n * train // total for c, n in sizes.items()}
    rest = sorted(sizes, key=lambda c: (-(sizes[c] * train % total), c))
    more = set(rest[:train - sum(whole.values())])
    return {c: n - whole[c] - (c in more) for c, n in sizes.items()}


@pytest.mark.parametrize("test", [0.2, 0.33, 0.5, 0.07])
@pytest.mark.parametrize("sizes", [(7, 7, 7), (10, 5, 1), (1, 1, 1, 1, 1), (13, 29, 58, 3), (40,)])
def test_overall_totals(spark, sizes, test):
    """ceil(test * n) rows in all, also where rounding each class gives another number."""
    sizes = {f"c{i}": n for i, n in enumerate(sizes)}
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    split = stratified_split(df, test=test, key="id", totals="overall")
    got = {r["label"]: r["n"] for r in split.filter("split = 'test'").groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    want = library_test_rows(sizes, test)
    assert got == {c: n for c, n in want.items() if n}
    assert sum(want.values()) == math.ceil(test * sum(sizes.values()))
    assert split.count() == len(rows)


def test_overall_and_per_class_totals_differ(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}") for i in range(21)], "id long, label string")
    n = {t: stratified_split(df, key="id", totals=t).filter("split = 'test'").count() for t in ("overall", "per_class")}
    assert n == {"overall": 5, "per_class": 3}
    with pytest.raises(ValueError):
        stratified_split(df, key="id", totals="other")
