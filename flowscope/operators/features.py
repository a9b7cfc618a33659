"""Label encoding, split, feature selection and scaling."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowscope.operators.forests import Forest
from flowscope.schemas import N_FEATURES, SEED, SELECTOR_TREES, TEST_SIZE
from flowscope.sizing import small_or_same

MAX_DEPTH = 30  # of all trees


def class_index(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per class: name and its place among the sorted names."""
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct()
    place = F.row_number().over(W.orderBy(label)) - F.lit(1)
    return classes.select(label, place.cast("double").alias("label_index"))


def class_list(df: DataFrame, label: str = "label") -> list[str]:
    """Sorted class names; a classifier's classes are few."""
    return [r[0] for r in class_index(df, label).orderBy("label_index").collect()]


def encode_label(
    df: DataFrame, labels: list[str] | None = None, label: str = "label"
) -> DataFrame:
    """Add ``label_index``: the place of the class among the sorted class names.

    Give ``labels`` to reuse an earlier fit, and on streams.
    """
    if labels is None:
        return df.join(small_or_same(class_index(df, label)), label, "left")
    names = F.array(*[F.lit(x) for x in sorted(labels)])
    place = F.nullif(F.array_position(names, F.col(label)), F.lit(0)) - F.lit(1)
    return df.withColumn("label_index", place.cast("double"))


def _row_hash(df: DataFrame, key: str | None, seed: int) -> Column:
    text = F.col(key).cast("string") if key else F.to_json(F.struct(*df.columns))
    return F.md5(F.concat_ws("|", text, F.lit(str(seed))))


def class_shares(sizes: DataFrame, test: float = TEST_SIZE) -> DataFrame:
    """Add ``share``, the test rows of each class, to (_class, n): ceil(test * rows) in all.

    The train side is shared out first, as the usual library does: each class gets the whole
    part of its proportional share, and what is left goes to the largest remainders. Of equal
    ones the first class name gets it; the library draws. One row per class, so no group is large.
    """
    every = W.partitionBy()
    n = F.sum("n").over(every)
    train = n - F.ceil(n * F.lit(float(test)))
    largest = W.orderBy(F.desc("_rest"), "_class")
    return (
        sizes.withColumns({"_n": n, "_train": train})
        .withColumn("_whole", F.expr("CAST(n AS DECIMAL(19,0)) * CAST(_train AS DECIMAL(19,0)) div _n"))
        .withColumn("_rest", F.expr("CAST(n AS DECIMAL(19,0)) * CAST(_train AS DECIMAL(19,0)) % _n"))
        .withColumn("_left", (F.col("_train") - F.sum("_whole").over(every)).cast("long"))
        .withColumn("_more", (F.row_number().over(largest) <= F.col("_left")).cast("long"))
        .select("_class", "n", (F.col("n") - F.col("_whole") - F.col("_more")).alias("share"))
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    test: float = TEST_SIZE,
    seed: int = SEED,
    key: str | None = None,
    prefix: int = 4,
    totals: str = "per_class",
) -> DataFrame:
    """Add ``split``: the ``test`` share of each class with the lowest hashes is ``test``.

    With ``totals`` "per_class" each class's share is rounded by itself. With "overall" the
    test side has ceil(test * rows) rows in all, see ``class_shares``.

    Exact per class, without ranking a class in one task: counts per hash prefix find the
    prefix where the class reaches its share, and only the rows of that prefix are ranked,
    which gives one border hash per class. The table itself is then split by a projection.
    Rows need a unique ``key`` or must be distinct; equal rows fall on the same side.
    """
    hashed = df.select(F.col(label).alias("_class"), _row_hash(df, key, seed).alias("_hash"))
    hashed = hashed.filter(F.col("_class").isNotNull()).withColumn(
        "_prefix", F.substring("_hash", 1, prefix))

    running = W.partitionBy("_class").orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
    counts = hashed.groupBy("_class", "_prefix").agg(F.count("*").alias("n"))
    if totals == "per_class":
        share = F.floor(F.sum("n").over(W.partitionBy("_class")) * F.lit(float(test)) + F.lit(0.5))
        counts = counts.withColumn("share", share)
    elif totals == "overall":
        sizes = counts.groupBy("_class").agg(F.sum("n").alias("n"))
        counts = counts.join(small_or_same(class_shares(sizes, test)).drop("n"), "_class")
    else:
        raise ValueError('totals must be "per_class" or "overall"')
    border_prefix = (
        counts.withColumn("upto", F.sum("n").over(running))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter((F.col("before") < F.col("share")) & (F.col("share") <= F.col("upto")))
        .select("_class", "_prefix", (F.col("share") - F.col("before")).alias("need"))
    )
    border_prefix = small_or_same(border_prefix)

    # copies of a row share a hash and count together
    nearest = W.partitionBy("_class").orderBy("_hash").rowsBetween(W.unboundedPreceding, 0)
    border = (
        hashed.join(border_prefix, ["_class", "_prefix"])
        .groupBy("_class", "_hash", "need").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(nearest))
        .filter(F.col("upto") <= F.col("need"))
        .groupBy("_class").agg(F.max("_hash").alias("_border"))
    )
    # a border prefix whose first hash is already over the share still closes the prefixes before
    floor_hash = border_prefix.select("_class", F.col("_prefix").alias("_floor"))
    border = small_or_same(floor_hash.join(border, "_class", "left"))

    joined = df.withColumn("_hash", _row_hash(df, key, seed)).join(
        border, F.col(label) == F.col("_class"), "left")
    in_test = (F.col("_hash") <= F.col("_border")) | (
        F.substring("_hash", 1, prefix) < F.col("_floor"))
    side = F.when(in_test, F.lit("test")).otherwise(F.lit("train"))
    return joined.withColumn("split", side).select(*df.columns, "split")


def forest_importance(
    train: DataFrame,
    cols: list[str],
    trees: int = SELECTOR_TREES,
    seed: int = SEED,
    label: str = "label_index",
) -> DataFrame:
    """Importance of each column in a forest fitted on ``train``."""
    rows = assemble(train, cols, "_features").select("_features", label)
    weights = Forest(rows, trees, seed, MAX_DEPTH, label, features="_features").importances()
    rows = [(name, float(weights[i]), i) for i, name in enumerate(cols)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double, pos int")


def top_features(importances: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """The ``n`` most important features; of equals the earlier column."""
    return importances.orderBy(F.desc("importance"), F.asc("pos")).limit(n)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: mean and population deviation, 1 for a constant column."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(c).alias("mean"),
            F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias("std"),
        )
        for c in cols
    ]
    return train.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def scaled(stats: list, c: str) -> Column:
    row = next(s for s in stats if s["column"] == c)
    return (F.col(c) - F.lit(row["mean"])) / F.lit(row["std"])


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise the columns named in ``stats``, which has one row per column."""
    fitted = stats.collect()
    return df.withColumns({s["column"]: scaled(fitted, s["column"]) for s in fitted})


def balanced_weights(df: DataFrame, label: str = "label_index") -> DataFrame:
    """Add ``weight``: n / (classes * rows of the class)."""
    per_class = df.groupBy(label).agg(F.count("*").alias("_n"))
    every = W.partitionBy()
    weight = F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))
    weights = per_class.select(label, weight.alias("weight"))
    return df.join(small_or_same(weights), label)
