"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from operator import and_

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope import sources
from flowscope import testviews as tv
from flowscope.functions import class_name, flow_duration, relative_bin, round_np
from flowscope.operators import cleaning as cl
from flowscope.operators import counters as ct
from flowscope.operators import evaluation as ev
from flowscope.operators import features as ft
from flowscope.operators import intervals as iv
from flowscope.operators import models as md
from flowscope.operators import packets as pk
from flowscope.operators import sketches as sk
from flowscope.operators import telemetry as tm
from flowscope.plans import capture as cap
from flowscope.plans import learning as ln
from flowscope.plans import reports as rp
from flowscope.schemas import DEFAULT_SCENARIO, IDENTITY, MODEL_NAMES, PACKET_IN, SCENARIOS
from flowscope.sizing import scratch_dir, stored
from flowscope.streaming import counters as sc
from flowscope.streaming import packets as sp
from flowscope.streaming import port_rate as spr
from flowscope.streaming import recorded as srec
from flowscope.streaming import scoring as ss

Query = Callable[[SparkSession, str], DataFrame]

DAY = float(tv.DAY)
DELTAS = ["flow_key", "event_id", "dt", "prev_packet_count", "prev_byte_count",
          "delta_packet_count", "delta_byte_count"]
RATES = ["flow_key", "event_id", "pkts_per_s", "byts_per_s", "pkt_len_mean"]
# few rows per chunk, so that small tables cross chunk borders too
SMALL_CHUNK = 1_000
# fewer rows than many keys have, so that these are cut
TINY_CHUNK = 25


# --- shared inputs ---------------------------------------------------------------------

def _stats(s: SparkSession, d: str, resets: bool = True) -> DataFrame:
    return cap.with_flow_key(tv.flow_stats(s, d, resets, ("event_id",)))


def _deltas(s: SparkSession, d: str, resets: bool = True, **options) -> DataFrame:
    return ct.counter_deltas(_stats(s, d, resets), "flow_key", tiebreak="event_id", **options)


def _recorded(s: SparkSession, d: str) -> DataFrame:
    return iv.within_recording(_stats(s, d), tv.recording_windows(s, d))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return iv.label_by_scenario(cap.rated(_deltas(s, d)), tv.scenario_log(s, d))


def _capture(s: SparkSession, d: str) -> DataFrame:
    return cap.capture(
        tv.flow_stats(s, d, keep=("event_id",)), tv.scenario_log(s, d),
        tv.recording_windows(s, d), tiebreak="event_id")


def _ts_us(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros("event_ts")).drop("event_ts")


def _reported(report: Callable, *args) -> Query:
    return lambda s, d: report(tv.metrics(s, d), tv.timing(s, d), *args)


def _measured(operator: Callable, *args) -> Query:
    return lambda s, d: operator(tv.metrics(s, d), *args)


def _keyed_metrics(s: SparkSession, d: str) -> DataFrame:
    return tv.metrics(s, d, "event_id")


def _split(s: SparkSession, d: str) -> DataFrame:
    return ft.stratified_split(_keyed_metrics(s, d), "scenario", key="event_id")


def _scores(operator: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        scores = operator(tv.predictions(s, d))
        return scores.withColumns({
            f.name: round_np(f"`{f.name}`", 6) for f in scores.schema
            if f.dataType.typeName() == "double"})
    return run


# --- sources and sinks -----------------------------------------------------------------

def _write_steps(s: SparkSession, d: str, path: str, slices: int) -> Iterator[int]:
    """Write flow polls as parquet files, one step of time before each number that is yielded."""
    stats = tv.flow_stats(s, d)
    ends = stats.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first()
    step = (ends[1] - ends[0]) // slices + 1
    part = F.floor((F.unix_micros("event_ts") - F.lit(ends[0])) / F.lit(step))
    for i in range(slices):
        stats.filter(part == i).write.mode("append").parquet(path)
        yield i


def _write_stats(s: SparkSession, d: str, slices: int = 1) -> str:
    """Flow polls as parquet files, in ``slices`` steps of time."""
    path = scratch_dir(s, "flow-stats")
    for _ in _write_steps(s, d, path, slices):
        pass
    return path


def read_flow_stats(s: SparkSession, d: str) -> DataFrame:
    return _ts_us(cap.with_flow_key(sources.read_flow_stats(s, _write_stats(s, d))))


def append_raw_flows(s: SparkSession, d: str, fmt: str = "csv") -> DataFrame:
    path = scratch_dir(s, "raw-flows")
    rows = _capture(s, d)
    attack = F.col("label") != DEFAULT_SCENARIO
    sources.append_raw_flows(rows.filter(~attack), path, fmt)
    sources.append_raw_flows(rows.filter(attack), path, fmt)
    return sources.read_raw_flows(s, path, fmt)


def append_metrics(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "metrics")
    sources.append_metrics(tv.metrics(s, d), f"{path}/metrics")
    return sources.read_metrics_timing(s, path)[0]


def read_metrics_timing(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "telemetry")
    sources.append_metrics(tv.metrics(s, d), f"{path}/metrics")
    tv.timing(s, d).write.parquet(f"{path}/timing")
    metrics, timing = sources.read_metrics_timing(s, path)
    first = metrics.groupBy("scenario").agg(
        F.count("*").alias("samples"), F.min("timestamp").alias("first_event"))
    start = timing.groupBy("scenario").agg(F.min("scenario_start_time").alias("start"))
    return first.join(start, "scenario", "left")


def append_timing(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "timing")
    # at most one row per scenario
    for row in tm.min_event_time(tv.metrics(s, d), "scenario").collect():
        start = row["min_timestamp"]
        run = None if row["scenario"] == "normal" else start
        sources.append_timing(s, path, row["scenario"], start, run)
    return s.read.parquet(path)


def save_split(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "split")
    sources.save_split(_split(s, d).select("event_id", "scenario", "split"), path)
    train, test = sources.load_split(s, path)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")))


def write_result(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "result")
    result = tm.inference_stats(tv.metrics(s, d))
    sources.write_result(result, path)
    return s.read.schema(result.schema).option("header", True).csv(path)


# --- learning --------------------------------------------------------------------------

def _vector_rows(s: SparkSession, d: str) -> DataFrame:
    """Train and test rows of the labelled vectors, scaled and assembled."""
    rows, names = tv.vectors(s, d)
    rows = ft.stratified_split(ft.encode_label(rows), key="vec_id")
    stats = ft.fit_scaler(rows.filter("split = 'train'"), names)
    return ft.assemble(ft.apply_scaler(rows, stats), names).select(
        "vec_id", "label", "label_index", "features", "split")


def _train(s: SparkSession, d: str) -> DataFrame:
    return _vector_rows(s, d).filter("split = 'train'")


def _test(s: SparkSession, d: str) -> DataFrame:
    return _vector_rows(s, d).filter("split = 'test'")


def _known(s: SparkSession, d: str) -> Column:
    """Whether a prediction is the index of a class."""
    n = len(ft.class_list(tv.vectors(s, d)[0]))
    return F.col("prediction").isin([float(i) for i in range(n)])


def _trained(trainer: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        train = _train(s, d).persist()
        model = trainer(train)
        train.unpersist()
        return md.predict(model, _test(s, d)).select(
            "vec_id", "label_index", _known(s, d).alias("known"))
    return run


def forest_importance(s: SparkSession, d: str) -> DataFrame:
    rows, names = tv.vectors(s, d)
    train = ft.stratified_split(ft.encode_label(rows), key="vec_id").filter("split = 'train'")
    importances = ft.forest_importance(train, names)
    total = importances.agg(round_np(F.sum("importance"), 6)).scalar()
    return importances.select(
        "feature", "pos", (F.col("importance") >= 0).alias("usable"), total.alias("total"))


def _same_predictions(s: SparkSession, d: str, before: Model, after: Model) -> DataFrame:
    """The test rows, with whether two models predict the same for each."""
    first = md.predict(before, _test(s, d)).select(
        "vec_id", "label_index", "features", F.col("prediction").alias("_before"))
    return md.predict(after, first).select(
        "vec_id", "label_index", (F.col("_before") == F.col("prediction")).alias("same"))


def save_model(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "model")
    model = md.train_tree(_train(s, d))
    sources.save_model(model, path)
    return _same_predictions(s, d, model, sources.load_model(path))


def training_cost(s: SparkSession, d: str) -> DataFrame:
    cost = md.training_cost(_train(s, d))[0]
    return cost.select("Model", (F.col("Train_Time_Sec") > 0).alias("measured"))


def inference_cost(s: SparkSession, d: str) -> DataFrame:
    _, models = md.training_cost(_train(s, d))
    cost = md.inference_cost(models, _test(s, d))
    return cost.select("Model", (F.col("Inference_Time_Sec") > 0).alias("measured"))


def export_winner(s: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(s, "winner")
    _, models = md.training_cost(_train(s, d))
    metrics = ev.model_metrics(md.predict_all(models, _test(s, d)))
    name = md.export_winner(models, metrics, path)
    return _same_predictions(s, d, models[name], sources.load_model(path))


def train_and_evaluate(s: SparkSession, d: str) -> DataFrame:
    """Test rows of each model, and whether its scores are shares and its recall its accuracy."""
    metrics, _, fitted = ln.train_and_evaluate(tv.vectors(s, d)[0], key="vec_id")
    rows = fitted["predictions"].groupBy(F.col("model").alias("Model")).agg(
        F.count("*").alias("test_rows"))
    shares = [F.col(c).between(0, 1) for c in ("Accuracy", "Precision", "F1-Score")]
    agree = F.abs(F.col("Accuracy") - F.col("Recall")) < 1e-9
    return metrics.join(rows, "Model").select("Model", "test_rows", reduce(and_, shares, agree).alias("consistent"))


# --- streaming -------------------------------------------------------------------------

def _in_steps(s: SparkSession, d: str, name: str, start: Callable, slices: int = 3) -> str:
    """Flow polls written in steps of time, each drained as one micro-batch; the stream goes on where it stopped.

    The files of a step are in no order of time, so they are taken together: a sample older
    than the newest one of its flow is ignored. ``start(stream, path)`` begins the query with
    its checkpoint under ``path``.
    """
    s.conf.set("spark.sql.streaming.stateStore.providerClass", sc.ROCKSDB)
    path = scratch_dir(s, name)
    for _ in _write_steps(s, d, f"{path}/in", slices):
        stream = sources.read_flow_stats(s, f"{path}/in", streaming=True, files_per_trigger=None)
        start(stream, path).awaitTermination()
    return path


def _captured(s: SparkSession, d: str, name: str, sink: Callable) -> DataFrame:
    """What ``sink(path)`` writes of the captured micro-batches."""
    # they are read for every micro-batch
    log, windows = stored(tv.scenario_log(s, d)), stored(tv.recording_windows(s, d))
    path = _in_steps(s, d, name, lambda stream, path: sc.stream_capture(
        stream, lambda: log, lambda: windows, sink(f"{path}/rows"), f"{path}/checkpoint", ttl_seconds=None))
    return s.read.parquet(f"{path}/rows").drop("batch_id")


def stream_capture(s: SparkSession, d: str) -> DataFrame:
    return _ts_us(_captured(s, d, "stream-capture", sc.batch_folder))


def stream_counter_deltas(s: SparkSession, d: str) -> DataFrame:
    schemas = []

    def start(stream: DataFrame, path: str):
        rows = sc.stream_counter_deltas(cap.with_flow_key(stream), "flow_key", ttl_seconds=None)
        schemas.append(rows.schema)
        return (
            rows.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start(f"{path}/rows"))

    path = _in_steps(s, d, "stream-deltas", start)
    rows = s.read.schema(schemas[0]).parquet(f"{path}/rows")
    return _ts_us(rows).select("ts_us", *[c for c in DELTAS if c != "event_id"])


def _scorer(s: SparkSession, d: str):
    """A model fitted on the labelled rows of the recorded flows."""
    rows, fitted = ln.prepare(_capture(s, d))
    model = md.train_tree(rows.filter("split = 'train'"))
    return ln.scoring_pipeline(model, fitted)


def _saved_scorer(s: SparkSession, d: str):
    path = scratch_dir(s, "scorer")
    sources.save_model(_scorer(s, d), path)
    return sources.load_model(path)


def score_flows(s: SparkSession, d: str) -> DataFrame:
    model = _saved_scorer(s, d)

    def sink(path: str) -> Callable:
        write = sc.batch_folder(path)
        return lambda rows, i: write(ss.score_flows(rows, model), i)

    known = F.col("predicted_label").isin(SCENARIOS).alias("known")
    return _ts_us(_captured(s, d, "scored", sink)).select(
        "ts_us", "dpid", "flow_key", "label", known)


def emit_metrics(s: SparkSession, d: str) -> DataFrame:
    model = _saved_scorer(s, d)
    flow = {
        "in_port": F.lit(None).cast("int"), "eth_src": F.lit(None).cast("string"),
        "dst_port": F.lit(None).cast("int"), "cpu_percent": F.lit(None).cast("double"),
        "pkt_rate": F.col("pkts_per_s"), "byte_rate": F.col("byts_per_s"),
        "scenario": F.col("label"),
    }
    rows = _captured(s, d, "emitted", lambda path: (
        lambda batch, i: ss.emit_batch(batch.withColumns(flow), model, path, i)))
    attack = F.col("predicted_label") != DEFAULT_SCENARIO
    late = F.col("mitigation_latency_ms") > 0
    return rows.select(
        "dpid", "pkt_rate", "byte_rate", "scenario",
        ((F.col("action_taken") == "DROP") == attack).alias("decided"),
        ((late == attack) & (F.col("inference_time_ms") >= 0)).alias("timed"))


def _in_slices(s: SparkSession, rows: DataFrame, time: str, name: str, start: Callable, slices: int = 3) -> str:
    """Write ``rows`` step by step, and drain them by a stream that is started anew each time.

    ``time`` is an expression for whole numbers. ``start(stream, path)`` begins the query with
    its checkpoint under ``path``.
    """
    us = F.expr(time)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", sc.ROCKSDB)
    path = scratch_dir(s, name)
    first, last = rows.agg(F.min(us), F.max(us)).first()
    step = ((last or 0) - (first or 0)) // slices + 1
    part = F.floor((us - F.lit(first or 0)) / F.lit(step))
    for i in range(slices):
        rows.filter(part == i).write.mode("append").parquet(f"{path}/in")
        start(s.readStream.schema(rows.schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


def _packet_rows(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([], PACKET_IN).unionByName(tv.packet_in(s, d))


EVENT_US = "unix_micros(event_ts)"


def stream_forwarding_decisions(s: SparkSession, d: str, salts: int = 1) -> DataFrame:
    """Packets in slices, and a discovery frame an hour later that lets the last ones be decided."""
    rows = _packet_rows(s, d)
    end = rows.agg(F.max("event_ts").alias("event_ts")).filter("event_ts IS NOT NULL").select(
        (F.col("event_ts") + F.expr("INTERVAL 1 HOUR")).alias("event_ts"), F.lit(-1).cast("long").alias("seq"),
        F.lit(0x88CC).cast("int").alias("ethertype"))

    def start(stream: DataFrame, path: str):
        return (
            sp.stream_forwarding_decisions(stream, salts=salts).writeStream.format("parquet")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows"))

    path = _in_slices(s, rows.unionByName(end, allowMissingColumns=True), EVENT_US, "stream-decisions", start)
    return s.read.parquet(f"{path}/rows").select("seq", "dpid", "in_port", "eth_src", "eth_dst", "out_port")


def stream_recorded_deltas(s: SparkSession, d: str) -> DataFrame:
    """Polls and the turns of recording in slices, and a turn an hour later that lets the last polls out."""
    polls = _stats(s, d).select("flow_key", "event_ts", "event_id", "packet_count", "byte_count")
    turns = srec.switch_events(tv.recording_windows(s, d))
    end = polls.agg((F.max("event_ts") + F.expr("INTERVAL 1 HOUR")).alias("event_ts")).select(
        "event_ts", F.lit(False).alias("on"))
    rows = polls.unionByName(turns.unionByName(end), allowMissingColumns=True)

    def start(stream: DataFrame, path: str):
        deltas = srec.stream_recorded_deltas(
            stream.filter(F.col("on").isNull()), stream.filter(F.col("on").isNotNull()).select("event_ts", "on"),
            tiebreak="event_id", buckets=8)
        return (
            deltas.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start(f"{path}/rows"))

    path = _in_slices(s, rows.filter(F.col("event_ts").isNotNull()), EVENT_US, "recorded-deltas", start)
    return s.read.parquet(f"{path}/rows").select(*DELTAS)


def keep_last_known_port(s: SparkSession, d: str) -> DataFrame:
    path = _in_slices(
        s, _packet_rows(s, d), EVENT_US, "port-table",
        lambda stream, path: sp.keep_last_known_port(stream, f"{path}/table", f"{path}/checkpoint"))
    return sp.port_table(s, f"{path}/table").read()


def keep_live_devices(s: SparkSession, d: str) -> DataFrame:
    path = _in_slices(
        s, tv.device_state(s, d), EVENT_US, "device-table",
        lambda stream, path: sp.keep_live_devices(stream, f"{path}/table", f"{path}/checkpoint", "seq"))
    return sp.device_table(s, f"{path}/table").read().filter("live").select("dpid")


def stream_unique_port_rate(s: SparkSession, d: str) -> DataFrame:
    """All scenarios: three start where the timing table says, one at its first event."""
    def rates(path: str) -> spr.PortRates:
        return spr.PortRates(s, f"{path}/rates", DAY, late_seconds=60)

    path = _in_slices(
        s, tv.metrics(s, d), "floor(timestamp * 1e6)", "port-rates",
        lambda stream, path: spr.stream_unique_port_rate(
            stream, lambda: tv.timing(s, d), rates(path), f"{path}/checkpoint"))
    return rates(path).rates()


def telemetry_log(s: SparkSession, d: str) -> DataFrame:
    """The ddos timeline from a log of micro-batches, one of them run twice, compacted on the way."""
    log = ss.telemetry_log(s, scratch_dir(s, "telemetry-log"))
    rows = tv.metrics(s, d)
    for i in range(4):
        batch = rows.filter(F.pmod(F.xxhash64("timestamp", "eth_src"), F.lit(4)) == i)
        log.append(batch, i)
        log.append(batch, i)
        if i == 2:
            log.compact()
            log.ledger.vacuum()
    return rp.attack_timeline(log.read(), tv.timing(s, d), "ddos")


# --- models on flows whose class shows -------------------------------------------------

def _told_run(s: SparkSession, d: str) -> tuple[str, str]:
    """A whole learning run over flows with telling rates: its folder and the winner's name."""
    path = scratch_dir(s, "learning-run")
    return path, ln.learning_run(tv.telling_flows(s, d).drop("event_ts", "dpid", "flow_key"), path)


def learning_run(s: SparkSession, d: str) -> DataFrame:
    """The table of metrics that a whole run leaves, with the test rows each model was judged on."""
    path, name = _told_run(s, d)
    schema = "Model string, Accuracy double, Precision double, Recall double, `F1-Score` double"
    metrics = s.read.schema(schema).option("header", True).csv(f"{path}/model_performance_metrics")
    matrix = s.read.option("header", True).csv(f"{path}/confusion_matrix")
    rows = matrix.groupBy(F.col("model").alias("Model")).agg(F.sum(F.col("n").cast("long")).alias("test_rows"))
    return metrics.join(rows, "Model").withColumn("winner", F.col("Model") == name)


def predict_reloaded(s: SparkSession, d: str) -> DataFrame:
    """What each of the three models, saved and loaded again, predicts for the test rows."""
    path, _ = _told_run(s, d)
    _, test = sources.load_split(s, f"{path}/split")
    every = None
    for name in MODEL_NAMES:
        model = sources.load_model(f"{path}/models/{name}")
        rows = md.predict(model, test).groupBy("label", F.col("prediction").alias("predicted")).agg(
            F.count("*").alias("n")).withColumn("Model", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    return every


def informative_features(s: SparkSession, d: str) -> DataFrame:
    """Whether the forest finds a column worth a tenth or more, on flows whose class shows in two of them."""
    rows = tv.telling_flows(s, d, "event_id").drop("event_ts", "dpid", "flow_key")
    rows = cl.traffic_columns(ft.stratified_split(ft.encode_label(rows), key="event_id"))
    columns = [c for c in rows.columns if c not in ("label", "label_index", "split", "event_id")]
    found = ft.forest_importance(rows.filter("split = 'train'"), columns)
    return found.select("feature", "pos", (F.col("importance") >= 0.1).alias("informative"))


def _told_batches(s: SparkSession, d: str, name: str, write: Callable) -> str:
    """Flows with telling rates as a stream that the winner of a run over them scores."""
    folder, _ = _told_run(s, d)
    model = sources.load_model(f"{folder}/final")
    rows = tv.telling_flows(s, d, "event_id")
    return _in_slices(s, rows, EVENT_US, name, lambda stream, path: (
        stream.writeStream.foreachBatch(write(model, path))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()))


def score_flows_winner(s: SparkSession, d: str) -> DataFrame:
    def write(model, path: str) -> Callable:
        sink = sc.batch_folder(f"{path}/rows")
        return lambda batch, i: sink(ss.score_flows(batch, model), i)

    path = _told_batches(s, d, "winner-scored", write)
    return s.read.parquet(f"{path}/rows").select("event_id", "predicted_label")


def emit_metrics_winner(s: SparkSession, d: str) -> DataFrame:
    """Telemetry of the winner's decisions, from a log that was compacted meanwhile."""
    flow = {
        "in_port": F.lit(None).cast("int"), "eth_src": F.col("flow_key"),
        "dst_port": F.lit(None).cast("int"), "cpu_percent": F.lit(None).cast("double"),
        "pkt_rate": F.col("pkts_per_s"), "byte_rate": F.col("byts_per_s"), "scenario": F.col("label"),
    }

    def write(model, path: str) -> Callable:
        log = ss.telemetry_log(s, f"{path}/log")
        return lambda batch, i: ss.log_batch(batch.withColumns(flow), model, log, i, compact_every=2)

    path = _told_batches(s, d, "winner-emitted", write)
    return ss.telemetry_log(s, f"{path}/log").read().select(
        "dpid", "eth_src", "pkt_rate", "byte_rate", "predicted_label", "action_taken", "scenario",
        (F.col("mitigation_latency_ms") > 0).alias("late"))


# --- the rest --------------------------------------------------------------------------

def _no_latency(s: SparkSession, d: str) -> DataFrame:
    return _keyed_metrics(s, d).withColumn("mitigation_latency_ms", F.lit(0.0))


def _reading_text() -> Column:
    """The reading as text, as NaN and infinities do not compare alike everywhere."""
    v = F.col("reading")
    return (
        F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
        .otherwise(v.cast("long").cast("string"))
    )


def _shown_dirty(s: SparkSession, d: str) -> DataFrame:
    return cl.dedupe_rows(tv.dirty_rows(s, d)).withColumn("reading", _reading_text())


def _complete(s: SparkSession, d: str) -> DataFrame:
    rows = cl.complete_rows(tv.dirty_rows(s, d))
    return rows.select((F.abs("reading") == float("inf")).alias("infinite"), "level", "label")


def _inf_to_null(s: SparkSession, d: str) -> DataFrame:
    return cl.inf_to_null(tv.dirty_rows(s, d)).select(_reading_text().alias("reading"), "level")


def _costs(s: SparkSession, d: str) -> DataFrame:
    rows = tv.events(s, d).withColumn("Model", F.col("event_type"))
    training = rows.filter("Model <> 'error'").groupBy("Model").agg(
        F.count("*").cast("double").alias("Train_Time_Sec"))
    inference = rows.filter("Model <> 'view'").groupBy("Model").agg(
        F.max("k").cast("double").alias("Inference_Time_Sec"))
    return ev.cost_table(training, inference)


def _top_features(s: SparkSession, d: str) -> DataFrame:
    counts = tv.events(s, d).groupBy(F.col("k").alias("pos")).agg(
        F.count("*").cast("double").alias("importance"))
    return ft.top_features(counts.select(
        F.concat(F.lit("k"), F.col("pos")).alias("feature"), "importance", "pos"))


def _assembled(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = ft.assemble(tv.events(s, d), ["value", "k"])
    parts = vector_to_array("features")
    return rows.select(
        "event_id", parts[0].alias("first"), parts[1].alias("second"))


def _fitted_scaler(s: SparkSession, d: str) -> DataFrame:
    train = _split(s, d).filter("split = 'train'")
    return ft.fit_scaler(train, ["pkt_rate", "cpu_percent"])


def _fit_scaler(s: SparkSession, d: str) -> DataFrame:
    return _fitted_scaler(s, d).select(
        "column", round_np("mean", 6).alias("mean"), round_np("std", 6).alias("std"))


def _apply_scaler(s: SparkSession, d: str) -> DataFrame:
    rows = ft.apply_scaler(_keyed_metrics(s, d), _fitted_scaler(s, d))
    return rows.select("event_id", *[round_np(c, 6).alias(c) for c in ("pkt_rate", "cpu_percent")])


def _balanced(s: SparkSession, d: str) -> DataFrame:
    rows = ft.balanced_weights(_keyed_metrics(s, d), "scenario")
    return rows.select("event_id", round_np("weight", 9).alias("weight"))


def _binary(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/labels.parquet").select(
        F.lit("toxic").alias("model"), F.col("quality").alias("label"),
        F.col("toxic").alias("prediction"))


def _prf_binary(s: SparkSession, d: str) -> DataFrame:
    scores = ev.weighted_prf(_binary(s, d))
    return scores.select("model", *[round_np(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _report_values(s: SparkSession, d: str, scenario: str | None = None) -> DataFrame:
    """Every value of the reports: three numbers of each row, and a name where it has one."""
    bundle = rp.report(tv.metrics(s, d), tv.timing(s, d), scenario, width=DAY)
    columns = {
        "ddos": ["scenario_time_sec", "pkt_rate", "is_drop"], "spoofing": ["scenario_time_sec", "pkt_rate", "is_drop"],
        "scanning": ["time_bin", "ports_per_sec", "drops"],
        "infrastructure": ["global_time_sec", "cpu_percent", "mitigation_latency_ms"],
        "inference": ["mean", "median", "p95"],
    }
    every = None
    for report, df in bundle.items():
        name = F.col("scenario") if report == "inference" else F.lit(None).cast("string")
        values = [F.col(c).cast("double").alias(x) for c, x in zip(columns[report], ("first", "second", "third"))]
        rows = df.select(F.lit(report).alias("report"), name.alias("name"), *values)
        every = rows if every is None else every.unionByName(rows)
    return every


def _port_sketches(s: SparkSession, d: str) -> DataFrame:
    """Sketches of quarter days since the start of each scenario, merged to those of days."""
    rows = tv.metrics(s, d).join(tm.scenario_t0(tv.metrics(s, d), tv.timing(s, d)), "scenario")
    binned = rows.withColumn("time_bin", relative_bin(F.col("timestamp") - F.col("t0"), DAY / 4))
    return sk.sketched_port_rate(sk.merge_port_sketches(sk.port_sketches(binned), DAY), DAY)


def _sketched_inference(s: SparkSession, d: str) -> DataFrame:
    """From sketches of four parts of the table; quantiles as whether their rank is within the error."""
    metrics = tv.metrics(s, d)
    parts = sk.time_sketches(metrics.withColumn("run", F.col("dst_port") % 4), ["scenario", "run"])
    stats = sk.sketched_inference_stats(sk.merge_time_sketches(parts))
    near = []
    for name, p in (("median", 0.5), ("p95", 0.95)):
        below, upto = F.col("inference_time_ms") < F.col(name), F.col("inference_time_ms") <= F.col(name)
        near.append((
            (F.avg(below.cast("double")) <= p + sk.RANK_ERROR) & (F.avg(upto.cast("double")) >= p - sk.RANK_ERROR)
        ).alias(f"{name}_near"))
    ranks = metrics.join(stats.select("scenario", "median", "p95"), "scenario").groupBy("scenario").agg(*near)
    return stats.join(ranks, "scenario").select(
        "scenario", "n", round_np("mean", 3).alias("mean"), "max", "median_near", "p95_near")


def _split_overall(s: SparkSession, d: str) -> DataFrame:
    rows = ft.stratified_split(
        _keyed_metrics(s, d), "scenario", test=0.33, key="event_id", totals="overall")
    return rows.select("event_id", "scenario", "split")


def _with_malformed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The captured rows as CSV, where every tenth or so has a letter in a number; read and split."""
    path = scratch_dir(s, "malformed")
    rows = _capture(s, d).drop(*IDENTITY)
    broken = F.col("packet_count") % 10 == 3
    text = rows.withColumns({c: F.col(c).cast("string") for c in rows.columns}).withColumn(
        "pkts_per_s", F.when(broken, F.concat("pkts_per_s", F.lit("x"))).otherwise(F.col("pkts_per_s")))
    sources.append_raw_flows(text, path)
    return sources.split_raw_flows(s, path, most=10**9)


def _malformed(s: SparkSession, d: str) -> DataFrame:
    lines = _with_malformed(s, d)[1]
    return lines.groupBy(F.substring_index("line", ",", -1).alias("label")).agg(F.count("*").alias("n"))


def _report_sizes(s: SparkSession, d: str) -> DataFrame:
    bundle = rp.report(tv.metrics(s, d), tv.timing(s, d), width=DAY)
    sizes = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n")
        for name, df in bundle.items()
    ]
    every = sizes[0]
    for size in sizes[1:]:
        every = every.unionByName(size)
    return every


def _scan_bins(s: SparkSession, d: str) -> DataFrame:
    return rp.scan_bins(tv.metrics(s, d), tv.timing(s, d), DAY)


def _relative_bin(s: SparkSession, d: str) -> DataFrame:
    """Every scenario's rows in two-second bins from that scenario's start."""
    rows, timing = _keyed_metrics(s, d), tv.timing(s, d)
    parts = []
    for name in ("normal", "ddos", "scanning", "spoofing"):
        one = cl.for_scenario(rows, name)
        t0 = tm.scenario_t0(one, cl.for_scenario(timing, name)).select("t0")
        parts.append(tm.relative_time(one, t0))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select("event_id", relative_bin("scenario_time_sec").alias("time_bin"))


def _relative_time(s: SparkSession, d: str) -> DataFrame:
    rows = cl.for_scenario(_keyed_metrics(s, d), "ddos")
    t0 = tm.scenario_t0(rows, cl.for_scenario(tv.timing(s, d), "ddos")).select("t0")
    return tm.relative_time(rows, t0).select("event_id", "scenario_time_sec")


def _label(s: SparkSession, d: str, log: Callable = tv.scenario_log, **options) -> DataFrame:
    return iv.label_by_scenario(_stats(s, d), log(s, d), **options).select("event_id", "label")


def _decisions(s: SparkSession, d: str, **options) -> DataFrame:
    return pk.forwarding_decisions(tv.packet_in(s, d), **options).select(
        "seq", "dpid", "in_port", "eth_src", "eth_dst", "out_port")


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "read_flow_stats": read_flow_stats,
        "read_raw_flows": partial(append_raw_flows, fmt="parquet"),
        "append_raw_flows": append_raw_flows,
        "split_raw_flows": lambda s, d: _with_malformed(s, d)[0],
        "malformed_raw_flows": _malformed,
        "append_metrics": append_metrics,
        "metric_rows": _measured(sources.metric_rows),
        "read_metrics_timing": read_metrics_timing,
        "append_timing": append_timing,
        "save_split": save_split,
        "save_model": save_model,
        "write_result": write_result,
        # counters, labels, sessions
        "flow_key": lambda s, d: _stats(s, d).groupBy("flow_key").agg(
            F.count("*").alias("samples")),
        "counter_deltas": lambda s, d: _deltas(s, d).select(*DELTAS),
        "counter_deltas_chunked": lambda s, d: _deltas(
            s, d, rows_per_chunk=SMALL_CHUNK).select(*DELTAS),
        "counter_deltas_hot_keys": lambda s, d: _deltas(
            s, d, rows_per_chunk=TINY_CHUNK).select(*DELTAS),
        "counter_deltas_sessions": lambda s, d: ct.counter_deltas(
            _recorded(s, d), "flow_key", tiebreak="event_id", session="session_id",
        ).select(*DELTAS),
        "min_gap": lambda s, d: ct.min_gap(_deltas(s, d), 600).select(*DELTAS),
        "active_only": lambda s, d: ct.active_only(_deltas(s, d)).select(*DELTAS),
        "flow_rates": lambda s, d: cap.rated(_deltas(s, d)).select(*RATES),
        "flow_rates_rising": lambda s, d: cap.rated(_deltas(s, d, resets=False)).select(*RATES),
        "flow_duration": lambda s, d: _stats(s, d).select(
            "event_id", flow_duration("duration_sec", "duration_nsec").alias("flow_duration")),
        "flow_features": lambda s, d: ct.flow_features(_labelled(s, d)),
        "label_by_scenario": _label,
        "label_by_scenario_sorted": partial(_label, small_log=0, rows_per_chunk=SMALL_CHUNK),
        "label_by_scenario_long_log": partial(_label, log=tv.long_scenario_log),
        "within_recording": lambda s, d: _recorded(s, d).select("event_id", "session_id"),
        "capture": lambda s, d: _ts_us(_capture(s, d)),
        # packets and devices
        "drop_lldp": lambda s, d: pk.drop_lldp(tv.packet_in(s, d)).select(
            "seq", "dpid", "eth_src"),
        "last_known_port": lambda s, d: pk.last_known_port(tv.packet_in(s, d)),
        "forwarding_decisions": _decisions,
        "forwarding_decisions_chunked": partial(_decisions, rows_per_chunk=SMALL_CHUNK),
        "forwarding_decisions_hot_keys": partial(_decisions, rows_per_chunk=TINY_CHUNK),
        "rule_worthy": lambda s, d: pk.rule_worthy(_decisions(s, d)),
        "live_devices": lambda s, d: pk.live_devices(tv.device_state(s, d), "seq"),
        # selection, cleaning, scalar expressions
        "traffic_columns": lambda s, d: cl.traffic_columns(
            ct.flow_features(_labelled(s, d))),
        "for_scenario": lambda s, d: cl.for_scenario(_keyed_metrics(s, d), "ddos").select(
            "event_id", "pkt_rate"),
        "drop_events": lambda s, d: cl.drop_events(_keyed_metrics(s, d)).select(
            "event_id", "scenario"),
        "positive_or_all": lambda s, d: tm.positive_or_all(
            _keyed_metrics(s, d), "mitigation_latency_ms",
        ).select("event_id", "mitigation_latency_ms"),
        "positive_or_all_fallback": lambda s, d: tm.positive_or_all(
            _no_latency(s, d), "mitigation_latency_ms",
        ).select("event_id", "mitigation_latency_ms"),
        "relative_time": _relative_time,
        "relative_bin": _relative_bin,
        "inf_to_null": _inf_to_null,
        "complete_rows": _complete,
        "dedupe_rows": _shown_dirty,
        "clean": lambda s, d: cl.clean(tv.dirty_rows(s, d)),
        "round_np": lambda s, d: _keyed_metrics(s, d).select(
            "event_id", round_np(F.col("pkt_rate") / 8, 2).alias("rounded")),
        "class_name": lambda s, d: _keyed_metrics(s, d).select(
            "event_id", class_name(
                F.col("dst_port") % 5, ["ddos", "normal", "scanning", "spoofing"]).alias("name")),
        # lookups and aggregates
        "cost_table": _costs,
        "drop_markers": _reported(rp.scan_drop_markers, DAY),
        "scenario_t0": _reported(tm.scenario_t0),
        "global_t0": _reported(tm.global_t0),
        "action_counts": _measured(tm.action_counts),
        "unique_port_rate": lambda s, d: tm.unique_port_rate(_scan_bins(s, d), DAY),
        "inference_stats": _measured(tm.inference_stats),
        "sketched_port_rate": _port_sketches,
        "sketched_inference_stats": _sketched_inference,
        "min_event_time": _measured(tm.min_event_time, "scenario"),
        "class_summary": _measured(tm.class_summary, "scenario"),
        # features
        "top_features": _top_features,
        "encode_label": lambda s, d: ft.encode_label(
            _keyed_metrics(s, d), label="scenario").select("event_id", "label_index"),
        "stratified_split": lambda s, d: _split(s, d).select("event_id", "scenario", "split"),
        "stratified_split_overall": _split_overall,
        "forest_importance": forest_importance,
        "informative_features": informative_features,
        "assemble": _assembled,
        "fit_scaler": _fit_scaler,
        "apply_scaler": _apply_scaler,
        "balanced_weights": _balanced,
        # models
        "train_logistic": _trained(md.train_logistic),
        "train_tree": _trained(md.train_tree),
        "train_forest": _trained(md.train_forest),
        "predict": _trained(md.train_tree),
        "predict_reloaded": predict_reloaded,
        "learning_run": learning_run,
        "training_cost": training_cost,
        "inference_cost": inference_cost,
        "export_winner": export_winner,
        "train_and_evaluate": train_and_evaluate,
        # evaluation
        "accuracy": _scores(ev.accuracy),
        "weighted_prf": _scores(ev.weighted_prf),
        "weighted_prf_binary": _prf_binary,
        "confusion_matrix": lambda s, d: ev.confusion_matrix(tv.predictions(s, d)),
        "model_metrics": _scores(ev.model_metrics),
        "best_model": _scores(lambda p: ev.best_model(ev.model_metrics(p))),
        "melt_metrics": _scores(lambda p: ev.melt_metrics(ev.model_metrics(p))),
        "model_comparison": _scores(rp.model_comparison),
        # reports
        "attack_timeline_ddos": _reported(rp.attack_timeline, "ddos"),
        "attack_timeline_spoofing": _reported(rp.attack_timeline, "spoofing"),
        "scan_activity": _reported(rp.scan_activity, DAY),
        "infrastructure_impact": _reported(rp.infrastructure_impact),
        "inference_summary": _measured(rp.inference_summary),
        "run_summary": _measured(rp.run_summary),
        "report": _report_sizes,
        "report_values": _report_values,
        "report_scenario": partial(_report_values, scenario="scanning"),
        # streaming
        "stream_counter_deltas": stream_counter_deltas,
        "stream_capture": stream_capture,
        "score_flows": score_flows,
        "decide_action": lambda s, d: ss.decide_action(_keyed_metrics(s, d)).select(
            "event_id", "action_taken"),
        "emit_metrics": emit_metrics,
        "score_flows_winner": score_flows_winner,
        "emit_metrics_winner": emit_metrics_winner,
        "stream_forwarding_decisions": stream_forwarding_decisions,
        "stream_forwarding_decisions_salted": partial(stream_forwarding_decisions, salts=3),
        "stream_recorded_deltas": stream_recorded_deltas,
        "stream_unique_port_rate": stream_unique_port_rate,
        "keep_last_known_port": keep_last_known_port,
        "keep_live_devices": keep_live_devices,
        "telemetry_log": telemetry_log,
    }
