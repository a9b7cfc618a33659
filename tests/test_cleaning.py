from flowscope.operators.cleaning import (
    clean,
    complete_rows,
    dedupe_rows,
    drop_events,
    for_scenario,
    inf_to_null,
    traffic_columns,
)
from flowscope.schemas import METADATA, RAW_FLOWS, TRAFFIC_FEATURES

INF, NAN = float("inf"), float("nan")


def rows(spark):
    return spark.createDataFrame(
        [(INF, 1, "a"), (-INF, 1, "a"), (NAN, 1, "a"), (None, 1, "a"), (1.0, None, "a"),
         (1.0, 1, None), (0.0, 1, "a"), (-0.0, 1, "a"), (2.0, 1, "a"), (2.0, 1, "a")],
        "x double, n int, label string")


def test_clean_keeps_finite_complete_rows_once(spark):
    got = sorted(tuple(r) for r in clean(rows(spark)).collect())
    assert got == [(0.0, 1, "a"), (2.0, 1, "a")]
    by_steps = dedupe_rows(complete_rows(inf_to_null(rows(spark))))
    assert sorted(tuple(r) for r in by_steps.collect()) == got


def test_complete_rows_keep_infinity(spark):
    assert complete_rows(rows(spark)).count() == 6


def test_nan_rows_are_copies(spark):
    df = spark.createDataFrame([(NAN,), (NAN,), (1.0,)], "x double")
    assert dedupe_rows(df).count() == 2


def test_wide_tables_plan_quickly(spark):
    wide = spark.range(4).selectExpr(*[f"cast(id AS double) AS c{i}" for i in range(80)])
    assert complete_rows(inf_to_null(wide)).join(wide.select("c0"), "c0").count() == 4


def test_traffic_columns(spark):
    df = spark.createDataFrame([], RAW_FLOWS)
    assert traffic_columns(df).columns == [*TRAFFIC_FEATURES, "label"]
    assert set(df.columns) - set(traffic_columns(df).columns) == set(METADATA)


def test_filters(spark):
    df = spark.createDataFrame([("ddos", "DROP"), ("ddos", None), ("normal", "ALLOW")],
                               "scenario string, action_taken string")
    assert for_scenario(df, "ddos").count() == 2
    assert drop_events(df).count() == 1
