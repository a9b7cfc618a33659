"""SQL forms of the registered queries, over the same tables."""

from __future__ import annotations


def rint(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


EV = r"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
         epoch_us(ts) AS us
  FROM events)"""

METRICS = EV + """,
m0 AS (
  SELECT event_id, us / 1e6 AS "timestamp", user_id % 3 + 1 AS dpid,
         CAST(user_id % 5 + 1 AS INTEGER) AS in_port, 'u' || user_id AS eth_src,
         k AS dst_port, value AS pkt_rate, value * 64 AS byte_rate,
         value AS inference_time_ms,
         CASE WHEN event_type = 'error' THEN value ELSE CAST(0 AS DOUBLE) END
           AS mitigation_latency_ms,
         CAST(k AS DOUBLE) AS cpu_percent,
         CASE event_type WHEN 'click' THEN 'ddos' WHEN 'purchase' THEN 'scanning'
              WHEN 'signup' THEN 'spoofing' ELSE 'normal' END AS predicted_label,
         ['normal', 'ddos', 'scanning', 'spoofing'][user_id % 4 + 1] AS scenario
  FROM ev),
metrics AS (
  SELECT *, CASE WHEN predicted_label <> 'normal' AND dst_port >= 50
            THEN 'DROP' ELSE 'ALLOW' END AS action_taken
  FROM m0),
timing AS (
  SELECT scenario, min("timestamp") - 60e0 AS scenario_start_time,
         CASE WHEN scenario <> 'normal' THEN min("timestamp") - 60e0 - 5e0 END
           AS battery_start_time
  FROM metrics WHERE scenario <> 'spoofing' GROUP BY scenario),
t0 AS (
  SELECT m.scenario, coalesce(min(t.scenario_start_time), min(m."timestamp")) AS t0
  FROM metrics m LEFT JOIN timing t USING (scenario) GROUP BY m.scenario),
rel AS (
  SELECT m.*, m."timestamp" - t0.t0 AS scenario_time_sec
  FROM metrics m JOIN t0 USING (scenario)),
bins AS (
  SELECT *, floor(scenario_time_sec / 86400e0) * 86400e0 AS time_bin
  FROM rel WHERE scenario = 'scanning'),
rates AS (
  SELECT time_bin, count(DISTINCT dst_port) / 86400e0 AS ports_per_sec,
         count(*) FILTER (action_taken = 'DROP') AS drops
  FROM bins GROUP BY time_bin)"""


def _flow_stats(resets: bool) -> str:
    if resets:
        packets, octets = "CAST(k AS BIGINT)", "CAST(floor(value * 100e0) AS BIGINT)"
    else:
        packets, octets = "event_id", "event_id * 100 + k"
    return EV + f""",
fs AS (
  SELECT event_id, us, ts, user_id % 3 + 1 AS dpid, CAST(user_id % 2 AS INTEGER) AS table_id,
         sha256('{{"dpid":' || (user_id % 3 + 1) || ',"table_id":' || (user_id % 2)
           || ',"match":[{{"key":"in_port","value":"' || (user_id % 5)
           || '"}},{{"key":"u","value":"' || user_id || '"}}]}}') AS flow_key,
         {packets} AS packet_count, {octets} AS byte_count,
         user_id * 10 + k AS duration_sec, (event_id * 7919) % 1000000000 AS duration_nsec,
         CAST(user_id % 2 AS INTEGER) AS priority, k % 3 AS hard_timeout,
         k % 5 AS idle_timeout, CAST(event_id % 2 AS INTEGER) AS flags,
         us // 86400000000 AS session_id
  FROM ev),
windows AS (
  SELECT us // 86400000000 AS session_id, min(us) FILTER (event_type = 'signup') AS start_us,
         max(us) FILTER (event_type = 'error') AS end_us
  FROM ev GROUP BY ALL),
recorded AS (
  SELECT fs.* FROM fs JOIN windows USING (session_id) WHERE us >= start_us AND us < end_us)"""


def _deltas(resets: bool, sessions: bool = False) -> str:
    keys = "flow_key, session_id" if sessions else "flow_key"
    rows = "recorded" if sessions else "fs"
    return _flow_stats(resets) + f""",
lagged AS (
  SELECT *, lag(us) OVER w AS prev_us, lag(packet_count) OVER w AS prev_packet_count,
         lag(byte_count) OVER w AS prev_byte_count
  FROM {rows}
  WINDOW w AS (PARTITION BY {keys} ORDER BY us, event_id)),
deltas AS (
  SELECT *, (us - prev_us) / 1e6 AS dt, packet_count - prev_packet_count AS dp,
         byte_count - prev_byte_count AS db
  FROM lagged WHERE prev_us IS NOT NULL),
gated AS (
  SELECT *, {rint("CASE WHEN dp >= 0 THEN dp / dt ELSE 0e0 END", 4)} AS pkts_per_s,
         {rint("CASE WHEN db >= 0 THEN db / dt ELSE 0e0 END", 4)} AS byts_per_s,
         {rint("CASE WHEN db >= 0 THEN db / greatest(dp, 1) ELSE 0e0 END", 4)} AS pkt_len_mean,
         {rint("duration_sec + duration_nsec * 1e-9", 4)} AS flow_duration
  FROM deltas WHERE dt > 0.1 AND (dp > 0 OR packet_count > 0))"""


NAMES = "['normal', 'ddos', 'scanning', 'spoofing']"

LOG = f""",
log AS (
  SELECT {NAMES}[arg_min(k, event_id) % 4 + 1] AS scenario, min(us) AS start_us
  FROM ev GROUP BY us // 3600000000)"""

LONG_LOG = f""",
log AS (
  SELECT {NAMES}[k % 4 + 1] AS scenario, us AS start_us FROM ev WHERE event_type = 'signup')"""

PACKETS = EV + """,
packets AS (
  SELECT us, event_id AS seq, event_id % 3 AS dpid, CAST(user_id % 5 AS INTEGER) AS in_port,
         CAST(user_id AS VARCHAR) AS eth_src, CAST(k AS VARCHAR) AS eth_dst
  FROM ev WHERE event_type <> 'error'),
decided AS (
  SELECT p.*, coalesce(CAST(l.in_port AS VARCHAR), 'FLOOD') AS out_port
  FROM packets p ASOF LEFT JOIN packets l
    ON p.dpid = l.dpid AND p.eth_dst = l.eth_src AND p.seq >= l.seq)"""

DIRTY = EV + """,
dirty AS (
  SELECT CASE k WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE
              WHEN 3 THEN NULL ELSE floor(value / 1e1) END AS reading,
         k % 10 AS level, CASE WHEN k <> 4 THEN event_type END AS label
  FROM ev)"""

CLEAN = DIRTY + """,
clean AS (
  SELECT DISTINCT * FROM dirty
  WHERE reading IS NOT NULL AND isfinite(reading) AND label IS NOT NULL)"""

SPLIT = METRICS + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5(event_id || '|42')) AS rn,
         count(*) OVER (PARTITION BY scenario) AS n
  FROM metrics),
split AS (
  SELECT *, CASE WHEN rn <= floor(n * 2e-1 + 5e-1) THEN 'test' ELSE 'train' END AS split
  FROM ranked)"""

# ceil(0.33 n) test rows in all, the train side shared out by largest remainders
SPLIT_OVERALL = METRICS + """,
sizes AS (
  SELECT scenario, count(*) AS n, sum(count(*)) OVER () AS total FROM metrics GROUP BY scenario),
train AS (
  SELECT *, total - CAST(ceil(total * 33e-2) AS BIGINT) AS draws FROM sizes),
parts AS (
  SELECT *, n * draws // total AS whole, n * draws % total AS rest FROM train),
shares AS (
  SELECT scenario, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, scenario)
      <= draws - sum(whole) OVER () THEN 1 ELSE 0 END AS share
  FROM parts),
split AS (
  SELECT event_id, m.scenario, CASE WHEN row_number() OVER (
      PARTITION BY m.scenario ORDER BY md5(event_id || '|42')) <= share THEN 'test' ELSE 'train' END AS split
  FROM metrics m JOIN shares USING (scenario))"""

SCALED = SPLIT + """,
stats AS (
  SELECT avg(pkt_rate) AS pm, stddev_pop(pkt_rate) AS ps,
         avg(cpu_percent) AS cm, stddev_pop(cpu_percent) AS cs
  FROM split WHERE split = 'train')"""


def _scores(pairs: str) -> str:
    return f""",
pairs AS ({pairs}),
classes AS (
  SELECT model, cls, sum(actual) AS actual, sum(said) AS said, sum(tp) AS tp FROM (
    SELECT model, label AS cls, n AS actual, 0 AS said,
           CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM pairs
    UNION ALL SELECT model, prediction, 0, n, 0 FROM pairs)
  GROUP BY model, cls),
scores AS (
  SELECT model, sum(tp) / sum(actual) AS accuracy,
         sum(actual * CASE WHEN said = 0 THEN 0e0 ELSE tp / said END) / sum(actual) AS prec,
         sum(actual * CASE WHEN actual = 0 THEN 0e0 ELSE tp / actual END) / sum(actual) AS rec,
         sum(actual * 2e0 * tp / (said + actual)) / sum(actual) AS f1
  FROM classes GROUP BY model),
mm AS (
  SELECT model AS "Model", {rint("accuracy", 6)} AS "Accuracy", {rint("prec", 6)} AS "Precision",
         {rint("rec", 6)} AS "Recall", {rint("f1", 6)} AS "F1-Score"
  FROM scores)"""


SCENARIO_PAIRS = METRICS + _scores("""
  SELECT 'm' || dpid AS model, scenario AS label, predicted_label AS prediction, count(*) AS n
  FROM metrics GROUP BY ALL""")

LABEL_PAIRS = "x AS (SELECT 1)" + _scores("""
  SELECT 'toxic' AS model, quality AS label, toxic AS prediction, count(*) AS n
  FROM labels GROUP BY ALL""")

INFERENCE = f"""
SELECT scenario, {rint("avg(inference_time_ms)", 3)} AS mean,
       {rint("quantile_cont(inference_time_ms, 0.5)", 3)} AS median,
       {rint("max(inference_time_ms)", 3)} AS max,
       {rint("quantile_cont(inference_time_ms, 0.95)", 3)} AS p95
FROM metrics GROUP BY scenario"""

FEATURES = ("flow_duration, pkts_per_s, byts_per_s, pkt_len_mean, byte_count, packet_count, "
            "priority, table_id, hard_timeout, idle_timeout, flags")

ASOF_LABEL = """
SELECT {cols}, coalesce(l.scenario, 'normal') AS label
FROM {table} f ASOF LEFT JOIN log l ON f.us >= l.start_us"""

TIMELINE = """
SELECT scenario_time_sec, pkt_rate, action_taken = 'DROP' AS is_drop
FROM rel WHERE scenario = '{}'"""

METRIC_ROWS = f"""
SELECT "timestamp", dpid, in_port, eth_src, dst_port, {rint("pkt_rate", 2)} AS pkt_rate,
       {rint("byte_rate", 2)} AS byte_rate, {rint("inference_time_ms", 3)} AS inference_time_ms,
       {rint("mitigation_latency_ms", 3)} AS mitigation_latency_ms,
       {rint("cpu_percent", 2)} AS cpu_percent, predicted_label, action_taken, scenario
FROM metrics"""

DELTA_COLS = """
SELECT flow_key, event_id, dt, prev_packet_count, prev_byte_count,
       dp AS delta_packet_count, db AS delta_byte_count FROM deltas"""

RATE_COLS = "SELECT flow_key, event_id, pkts_per_s, byts_per_s, pkt_len_mean FROM gated"

RECORDED_FEATURES = _deltas(True, sessions=True) + LOG

COSTS = EV + """,
training AS (
  SELECT event_type AS "Model", CAST(count(*) AS DOUBLE) AS "Train_Time_Sec"
  FROM ev WHERE event_type <> 'error' GROUP BY event_type),
inference AS (
  SELECT event_type AS "Model", CAST(max(k) AS DOUBLE) AS "Inference_Time_Sec"
  FROM ev WHERE event_type <> 'view' GROUP BY event_type)"""


# labelled vectors; an equal vector with an equal label counts once in a learning run
VECTORS = """
ranked AS (
  SELECT vec_id, 'c' || label AS label,
         CAST(dense_rank() OVER (ORDER BY 'c' || label) - 1 AS DOUBLE) AS label_index,
         row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42')) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings WHERE label IS NOT NULL),
held_out AS (SELECT * FROM ranked WHERE rn <= floor(n * 2e-1 + 5e-1)),
models AS (SELECT unnest(['Logistic_Regression', 'Decision_Tree', 'Random_Forest']) AS "Model")"""

# flows whose class shows in their rates, so that every model has to find it
TOLD = EV + f""",
told AS (
  SELECT event_id, user_id, {NAMES}[user_id % 4 + 1] AS label,
         CASE WHEN user_id % 4 IN (1, 2) THEN 1e3 ELSE 1e1 END + k / 1e1 AS pkts_per_s,
         CASE WHEN user_id % 4 IN (1, 3) THEN 5e3 ELSE 5e1 END + k / 1e1 AS byts_per_s
  FROM ev),
told_sizes AS (
  SELECT label, floor(count(*) * 2e-1 + 5e-1) AS n FROM told GROUP BY label),
models AS (SELECT unnest(['Logistic_Regression', 'Decision_Tree', 'Random_Forest']) AS "Model")"""

KNOWN = "SELECT vec_id, label_index, TRUE AS known FROM held_out"
SAME = "SELECT vec_id, label_index, TRUE AS same FROM held_out"
MEASURED = 'SELECT "Model", TRUE AS measured FROM models'


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def oracle_sql() -> dict[str, str]:
    capture = ASOF_LABEL.format(
        cols=f"f.us AS ts_us, dpid, flow_key, {FEATURES}", table="gated")
    labelled_rows = ASOF_LABEL.format(cols="event_id", table="fs")
    return {
        # sources and sinks
        "read_flow_stats": _q(_flow_stats(True), f"""
            SELECT us AS ts_us, flow_key, dpid, table_id, duration_sec, duration_nsec, packet_count,
                   byte_count, priority, hard_timeout, idle_timeout, flags FROM fs"""),
        "append_raw_flows": _q(RECORDED_FEATURES, ASOF_LABEL.format(cols=FEATURES, table="gated")),
        "read_raw_flows": _q(RECORDED_FEATURES, ASOF_LABEL.format(cols=FEATURES, table="gated")),
        "split_raw_flows": _q(RECORDED_FEATURES, ASOF_LABEL.format(
            cols=FEATURES, table="(SELECT * FROM gated WHERE packet_count % 10 <> 3)")),
        "malformed_raw_flows": _q(RECORDED_FEATURES, "SELECT label, count(*) AS n FROM (" + ASOF_LABEL.format(
            cols="packet_count", table="(SELECT * FROM gated WHERE packet_count % 10 = 3)") + ") GROUP BY label"),
        "append_metrics": _q(METRICS, METRIC_ROWS),
        "read_metrics_timing": _q(METRICS, """
            SELECT scenario, count(*) AS samples, min("timestamp") AS first_event,
                   min(t.scenario_start_time) AS start
            FROM metrics LEFT JOIN timing t USING (scenario) GROUP BY scenario"""),
        "append_timing": _q(METRICS, """
            SELECT scenario, min("timestamp") AS scenario_start_time,
                   CASE WHEN scenario <> 'normal' THEN min("timestamp") END AS battery_start_time
            FROM metrics GROUP BY scenario"""),
        "save_split": _q(SPLIT, "SELECT event_id, scenario, split FROM split"),
        "write_result": _q(METRICS, INFERENCE),
        # counters
        "flow_key": _q(_flow_stats(True), """
            SELECT flow_key, count(*) AS samples FROM fs GROUP BY flow_key"""),
        "counter_deltas": _q(_deltas(True), DELTA_COLS),
        "counter_deltas_chunked": _q(_deltas(True), DELTA_COLS),
        "counter_deltas_hot_keys": _q(_deltas(True), DELTA_COLS),
        "counter_deltas_sessions": _q(
            _deltas(True, sessions=True), DELTA_COLS),
        "stream_recorded_deltas": _q(_deltas(True, sessions=True), DELTA_COLS),
        "min_gap": _q(_deltas(True), DELTA_COLS + " WHERE dt > 600"),
        "active_only": _q(_deltas(True), DELTA_COLS + " WHERE dp > 0 OR packet_count > 0"),
        "flow_rates": _q(_deltas(True), RATE_COLS),
        "flow_rates_rising": _q(_deltas(False), RATE_COLS),
        "flow_duration": _q(_flow_stats(True), f"""
            SELECT event_id, {rint("duration_sec + duration_nsec * 1e-9", 4)} AS flow_duration
            FROM fs"""),
        "flow_features": _q(_deltas(True) + LOG, ASOF_LABEL.format(
            cols=FEATURES, table="gated")),
        "label_by_scenario": _q(_flow_stats(True) + LOG, labelled_rows),
        "label_by_scenario_sorted": _q(_flow_stats(True) + LOG, labelled_rows),
        "label_by_scenario_long_log": _q(_flow_stats(True) + LONG_LOG, labelled_rows),
        "within_recording": _q(_flow_stats(True), """
            SELECT event_id, session_id FROM recorded"""),
        "capture": _q(RECORDED_FEATURES, capture),
        "stream_capture": _q(RECORDED_FEATURES, capture),
        "stream_counter_deltas": _q(
            _deltas(True), DELTA_COLS.replace("event_id", "us AS ts_us")),
        # packets
        "drop_lldp": _q(PACKETS, "SELECT seq, dpid, eth_src FROM packets"),
        "last_known_port": _q(PACKETS, """
            SELECT dpid, eth_src, arg_max(in_port, seq) AS port FROM packets GROUP BY ALL"""),
        "forwarding_decisions": _q(PACKETS, """
            SELECT seq, dpid, in_port, eth_src, eth_dst, out_port FROM decided"""),
        "forwarding_decisions_chunked": _q(PACKETS, """
            SELECT seq, dpid, in_port, eth_src, eth_dst, out_port FROM decided"""),
        **{name: _q(PACKETS, """
            SELECT seq, dpid, in_port, eth_src, eth_dst, out_port FROM decided""")
           for name in ("forwarding_decisions_hot_keys", "stream_forwarding_decisions",
                        "stream_forwarding_decisions_salted")},
        "keep_last_known_port": _q(PACKETS, """
            SELECT dpid, eth_src, arg_max(in_port, seq) AS port FROM packets GROUP BY ALL"""),
        "keep_live_devices": _q(EV, """
            SELECT user_id AS dpid FROM ev GROUP BY user_id
            HAVING arg_max(event_type, event_id) <> 'error'"""),
        "rule_worthy": _q(PACKETS, """
            SELECT DISTINCT dpid, in_port, eth_dst, out_port, 1 AS priority
            FROM decided WHERE out_port <> 'FLOOD'"""),
        "live_devices": _q(EV, """
            SELECT user_id AS dpid FROM ev GROUP BY user_id
            HAVING arg_max(event_type, event_id) <> 'error'"""),
        "relative_bin": _q(METRICS, """
            SELECT event_id, floor(scenario_time_sec / 2e0) * 2e0 AS time_bin FROM rel"""),
        # selection and cleaning
        "traffic_columns": _q(_deltas(True) + LOG, ASOF_LABEL.format(
            cols="flow_duration, pkts_per_s, byts_per_s, pkt_len_mean, byte_count, packet_count",
            table="gated")),
        "for_scenario": _q(METRICS, """
            SELECT event_id, pkt_rate FROM metrics WHERE scenario = 'ddos'"""),
        "drop_events": _q(METRICS, """
            SELECT event_id, scenario FROM metrics WHERE action_taken = 'DROP'"""),
        "positive_or_all": _q(METRICS, """
            SELECT event_id, mitigation_latency_ms FROM metrics WHERE mitigation_latency_ms > 0"""),
        "positive_or_all_fallback": _q(METRICS, """
            SELECT event_id, CAST(0 AS DOUBLE) AS mitigation_latency_ms FROM metrics"""),
        "relative_time": _q(METRICS, "SELECT event_id, scenario_time_sec FROM rel WHERE scenario = 'ddos'"),
        "inf_to_null": _q(DIRTY, """
            SELECT CASE WHEN isnan(reading) THEN 'NaN' WHEN isinf(reading) THEN NULL
                        ELSE CAST(CAST(reading AS BIGINT) AS VARCHAR) END AS reading, level
            FROM dirty"""),
        "complete_rows": _q(DIRTY, """
            SELECT CAST(reading AS VARCHAR) IN ('inf', '-inf') AS infinite, level, label FROM dirty
            WHERE reading IS NOT NULL AND NOT isnan(reading) AND label IS NOT NULL"""),
        "dedupe_rows": _q(DIRTY, """
            SELECT CASE WHEN isnan(reading) THEN 'NaN' WHEN isinf(reading) AND reading > 0 THEN 'inf'
                        WHEN isinf(reading) THEN '-inf'
                        ELSE CAST(CAST(reading AS BIGINT) AS VARCHAR) END AS reading, level, label
            FROM (SELECT DISTINCT * FROM dirty)"""),
        "clean": _q(CLEAN, "SELECT * FROM clean"),
        "metric_rows": _q(METRICS, METRIC_ROWS),
        "round_np": _q(METRICS, f"""
            SELECT event_id, {rint("pkt_rate / 8", 2)} AS rounded FROM metrics"""),
        "class_name": _q(METRICS, """
            SELECT event_id, ['ddos', 'normal', 'scanning', 'spoofing'][dst_port % 5 + 1] AS name
            FROM metrics"""),
        # lookups and aggregates
        "cost_table": _q(COSTS, """
            SELECT * FROM training JOIN inference USING ("Model")"""),
        "drop_markers": _q(METRICS, """
            SELECT scenario_time_sec, ports_per_sec
            FROM bins JOIN rates USING (time_bin) WHERE action_taken = 'DROP'"""),
        "scenario_t0": _q(METRICS, "SELECT scenario, t0 FROM t0"),
        "global_t0": _q(METRICS, "SELECT min(battery_start_time) AS t0 FROM timing"),
        "action_counts": _q(METRICS, """
            SELECT scenario, predicted_label, action_taken, count(*) AS samples
            FROM metrics GROUP BY ALL"""),
        "unique_port_rate": _q(METRICS, "SELECT time_bin, ports_per_sec FROM rates"),
        "inference_stats": _q(METRICS, INFERENCE),
        **{name: _q(METRICS, """
            SELECT scenario, floor(scenario_time_sec / 86400e0) * 86400e0 AS time_bin,
                   count(DISTINCT dst_port) / 86400e0 AS ports_per_sec
            FROM rel GROUP BY ALL""") for name in ("stream_unique_port_rate", "sketched_port_rate")},
        "sketched_inference_stats": _q(METRICS, f"""
            SELECT scenario, count(*) AS n, {rint("avg(inference_time_ms)", 3)} AS mean,
                   max(inference_time_ms) AS max, TRUE AS median_near, TRUE AS p95_near
            FROM metrics GROUP BY scenario"""),
        "min_event_time": _q(METRICS, """
            SELECT scenario, min("timestamp") AS min_timestamp FROM metrics GROUP BY scenario"""),
        "class_summary": _q(METRICS, """
            SELECT scenario, count(*) AS samples FROM metrics GROUP BY scenario"""),
        # features
        "top_features": _q(EV, """
            SELECT 'k' || k AS feature, CAST(count(*) AS DOUBLE) AS importance, k AS pos
            FROM ev GROUP BY k ORDER BY importance DESC, pos LIMIT 10"""),
        "encode_label": _q(METRICS, """
            SELECT event_id, CAST(dense_rank() OVER (ORDER BY scenario) - 1 AS DOUBLE)
                   AS label_index FROM metrics"""),
        "stratified_split_overall": _q(SPLIT_OVERALL, "SELECT event_id, scenario, split FROM split"),
        "stratified_split": _q(SPLIT, "SELECT event_id, scenario, split FROM split"),
        "assemble": _q(EV, """
            SELECT event_id, value AS first, CAST(k AS DOUBLE) AS second FROM ev"""),
        "fit_scaler": _q(SCALED, f"""
            SELECT 'pkt_rate' AS "column", {rint("pm", 6)} AS mean, {rint("ps", 6)} AS std FROM stats
            UNION ALL SELECT 'cpu_percent', {rint("cm", 6)}, {rint("cs", 6)} FROM stats"""),
        "apply_scaler": _q(SCALED, f"""
            SELECT event_id, {rint("(pkt_rate - pm) / ps", 6)} AS pkt_rate,
                   {rint("(cpu_percent - cm) / cs", 6)} AS cpu_percent
            FROM split, stats"""),
        "balanced_weights": _q(METRICS, f"""
            SELECT event_id, {rint('''(SELECT count(*) FROM metrics)
                   / ((SELECT count(DISTINCT scenario) FROM metrics)
                      * count(*) OVER (PARTITION BY scenario))''', 9)} AS weight
            FROM metrics"""),
        # models; what they predict is no SQL, so these rows state what holds for any fit
        "forest_importance": """
            SELECT 'e' || i AS feature, CAST(i AS INTEGER) AS pos, TRUE AS usable, 1e0 AS total
            FROM range((SELECT max(len(embedding)) FROM embeddings)) r(i)""",
        "informative_features": """
            SELECT feature, CAST(pos AS INTEGER) AS pos, feature IN ('pkts_per_s', 'byts_per_s') AS informative
            FROM (VALUES ('flow_duration', 0), ('pkts_per_s', 1), ('byts_per_s', 2), ('pkt_len_mean', 3),
                         ('byte_count', 4), ('packet_count', 5)) v(feature, pos)""",
        "train_logistic": _q(VECTORS, KNOWN),
        "train_tree": _q(VECTORS, KNOWN),
        "train_forest": _q(VECTORS, KNOWN),
        "predict": _q(VECTORS, KNOWN),
        "predict_reloaded": _q(TOLD, """
            SELECT "Model", label, CAST(dense_rank() OVER (PARTITION BY "Model" ORDER BY label) - 1 AS DOUBLE)
                     AS predicted, CAST(n AS BIGINT) AS n
            FROM models, told_sizes"""),
        "learning_run": _q(TOLD, """
            SELECT "Model", 1e0 AS "Accuracy", 1e0 AS "Precision", 1e0 AS "Recall", 1e0 AS "F1-Score",
                   (SELECT CAST(sum(n) AS BIGINT) FROM told_sizes) AS test_rows,
                   "Model" = 'Logistic_Regression' AS winner
            FROM models"""),
        "score_flows_winner": _q(TOLD, "SELECT event_id, label AS predicted_label FROM told"),
        "emit_metrics_winner": _q(TOLD, f"""
            SELECT CAST(user_id % 3 + 1 AS BIGINT) AS dpid, CAST(user_id AS VARCHAR) AS eth_src,
                   {rint("pkts_per_s", 2)} AS pkt_rate, {rint("byts_per_s", 2)} AS byte_rate,
                   label AS predicted_label, CASE WHEN label <> 'normal' THEN 'DROP' ELSE 'ALLOW' END AS action_taken,
                   label AS scenario, label <> 'normal' AS late
            FROM told"""),
        "save_model": _q(VECTORS, SAME),
        "export_winner": _q(VECTORS, SAME),
        "training_cost": _q(VECTORS, MEASURED),
        "inference_cost": _q(VECTORS, MEASURED),
        "train_and_evaluate": _q(VECTORS, """
            , sizes AS (
              SELECT label, count(*) AS n FROM (SELECT DISTINCT embedding, label FROM embeddings
              WHERE label IS NOT NULL) GROUP BY label)
            SELECT "Model", (SELECT CAST(sum(floor(n * 2e-1 + 5e-1)) AS BIGINT) FROM sizes) AS test_rows,
                   TRUE AS consistent
            FROM models"""),
        "score_flows": _q(RECORDED_FEATURES, ASOF_LABEL.format(
            cols="f.us AS ts_us, dpid, flow_key, TRUE AS known", table="gated")),
        "emit_metrics": _q(RECORDED_FEATURES, f"""
            SELECT dpid, {rint("pkts_per_s", 2)} AS pkt_rate, {rint("byts_per_s", 2)} AS byte_rate,
                   label AS scenario, TRUE AS decided, TRUE AS timed
            FROM ({ASOF_LABEL.format(cols="dpid, pkts_per_s, byts_per_s", table="gated")})"""),
        # evaluation
        "accuracy": _q(SCENARIO_PAIRS, 'SELECT "Model" AS model, "Accuracy" AS accuracy FROM mm'),
        "weighted_prf": _q(SCENARIO_PAIRS, """
            SELECT "Model" AS model, "Precision" AS precision, "Recall" AS recall,
                   "F1-Score" AS f1 FROM mm"""),
        "weighted_prf_binary": _q(LABEL_PAIRS, """
            SELECT "Model" AS model, "Precision" AS precision, "Recall" AS recall,
                   "F1-Score" AS f1 FROM mm"""),
        "confusion_matrix": _q(SCENARIO_PAIRS, """
            SELECT c.model, c.cls AS label, d.cls AS prediction, coalesce(p.n, 0) AS n
            FROM classes c JOIN classes d ON c.model = d.model
            LEFT JOIN pairs p ON p.model = c.model AND p.label = c.cls AND p.prediction = d.cls"""),
        "model_metrics": _q(SCENARIO_PAIRS, "SELECT * FROM mm"),
        "best_model": _q(SCENARIO_PAIRS, """
            SELECT * FROM mm WHERE "F1-Score" > 0
            ORDER BY "F1-Score" DESC, "Model" LIMIT 1"""),
        "model_comparison": _q(SCENARIO_PAIRS, """
            SELECT "Model", "Metric", "Score" FROM
            (UNPIVOT mm ON "Accuracy", "Precision", "Recall", "F1-Score"
             INTO NAME "Metric" VALUE "Score")"""),
        "melt_metrics": _q(SCENARIO_PAIRS, """
            SELECT "Model", "Metric", "Score" FROM
            (UNPIVOT mm ON "Accuracy", "Precision", "Recall", "F1-Score"
             INTO NAME "Metric" VALUE "Score")"""),
        # reports
        "attack_timeline_ddos": _q(METRICS, TIMELINE.format("ddos")),
        "attack_timeline_spoofing": _q(METRICS, TIMELINE.format("spoofing")),
        "scan_activity": _q(METRICS, "SELECT time_bin, ports_per_sec, drops FROM rates"),
        "infrastructure_impact": _q(METRICS, """
            SELECT "timestamp" - (SELECT min(battery_start_time) FROM timing) AS global_time_sec,
                   cpu_percent,
                   CASE WHEN mitigation_latency_ms > 0 THEN mitigation_latency_ms END
                     AS mitigation_latency_ms
            FROM metrics"""),
        "inference_summary": _q(METRICS, INFERENCE),
        "run_summary": _q(METRICS, """
            SELECT scenario, predicted_label, action_taken, count(*) AS samples
            FROM metrics GROUP BY ALL"""),
        "report_scenario": _q(METRICS, """
            SELECT 'scanning' AS report, CAST(NULL AS VARCHAR) AS name, time_bin AS first,
                   ports_per_sec AS second, CAST(drops AS DOUBLE) AS third FROM rates"""),
        "report_values": _q(METRICS, f"""
            SELECT scenario AS report, CAST(NULL AS VARCHAR) AS name, scenario_time_sec AS first,
                   pkt_rate AS second, CASE WHEN action_taken = 'DROP' THEN 1e0 ELSE 0e0 END AS third
            FROM rel WHERE scenario IN ('ddos', 'spoofing')
            UNION ALL SELECT 'scanning', NULL, time_bin, ports_per_sec, CAST(drops AS DOUBLE) FROM rates
            UNION ALL SELECT 'infrastructure', NULL,
                   "timestamp" - (SELECT min(battery_start_time) FROM timing), cpu_percent,
                   CASE WHEN mitigation_latency_ms > 0 THEN mitigation_latency_ms END FROM metrics
            UNION ALL SELECT 'inference', scenario, mean, median, p95 FROM ({INFERENCE})"""),
        "telemetry_log": _q(METRICS, TIMELINE.format("ddos")),
        "report": _q(METRICS, """
            SELECT 'ddos' AS report, count(*) AS n FROM rel WHERE scenario = 'ddos'
            UNION ALL SELECT 'spoofing', count(*) FROM rel WHERE scenario = 'spoofing'
            UNION ALL SELECT 'scanning', count(*) FROM rates
            UNION ALL SELECT 'infrastructure', count(*) FROM metrics
            UNION ALL SELECT 'inference', count(DISTINCT scenario) FROM metrics"""),
        "decide_action": _q(METRICS, """
            SELECT event_id, CASE WHEN predicted_label <> 'normal' THEN 'DROP' ELSE 'ALLOW' END
                   AS action_taken FROM metrics"""),
    }
