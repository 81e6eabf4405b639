"""Queries on packets, flows, cleaning, encoding and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens import constants as K
from wirelens.operators import cleaning, derive, flows, schema, splitting
from wirelens.operators.ranking import row_hash
from wirelens.plans import sql as Q
from wirelens.plans.registry import query
from wirelens.sources import replay, tables
from wirelens.sources import views as V
from wirelens.workspace import scratch_path

SEED = 42


def _flow_table(spark, d):
    return flows.flow_table(V.packets(spark, d), V.SESSION_GAP_US, V.SESSION_SLICE_US)


# --- packets to flows --------------------------------------------------------------------------

# values near 1e10 carry an absolute error near 1e-5, so those columns are compared as whole numbers
_WHOLE = {"flow_iat_mean", "flow_iat_std"}


def _places(name: str) -> int:
    return 0 if name in _WHOLE else 4


def _flow_feature_sql() -> list[str]:
    seconds = "(duration / 1e6::DOUBLE)"
    mean = {t: f"coalesce(l_{t}::DOUBLE / nullif(n_{t}, 0), 0.0::DOUBLE)" for t in ("f", "b")}
    both = "((l_f + l_b)::DOUBLE / (n_f + n_b))"
    flag = {n: f"n_{n.lower()}" for n in K.FLAG_NAMES}
    values = [
        "duration", "n_f", "n_b", "l_f::DOUBLE", "l_b::DOUBLE",
        "max_f", "min_f", mean["f"], "max_b", "min_b", mean["b"],
        f"(l_f + l_b) / {seconds}", f"(n_f + n_b) / {seconds}",
        "iat_mean", "iat_std", "iat_max", "iat_min",
        "duration * 0.9::DOUBLE", "duration * 0.8::DOUBLE",
        "CAST(n_psh > 0 AS INTEGER)", "0", "0", "0",
        "n_f * 20", "n_b * 20", f"n_f / {seconds}", f"n_b / {seconds}",
        "least_length", "most_length", both, "length_std",
        flag["FIN"], flag["SYN"], flag["RST"], flag["PSH"], flag["ACK"], flag["URG"],
        "n_b / greatest(n_f, 1)::DOUBLE", both, mean["f"], mean["b"],
        "n_f", "l_f::DOUBLE", "n_b", "l_b::DOUBLE", "29200", "0",
        "greatest(n_f - 2, 0)", "20", "duration * 0.1::DOUBLE", "duration * 0.2::DOUBLE",
    ]
    return [
        f"{Q.rd(expr, _places(name))} AS {name}"
        for name, expr in zip(K.FEATURE_COLUMNS, values, strict=True)
    ]


_FLOW_SQL = f"""{Q.ALL_SESSIONS},
grouped AS (
  SELECT flow_id, session_us AS start_us, src_ip, dst_ip, src_port, dst_port, protocol,
    greatest(max(at_us) - min(at_us), 100)::DOUBLE AS duration,
    count(*) FILTER (WHERE is_forward) AS n_f, count(*) FILTER (WHERE NOT is_forward) AS n_b,
    coalesce(sum(length) FILTER (WHERE is_forward), 0)::BIGINT AS l_f,
    coalesce(sum(length) FILTER (WHERE NOT is_forward), 0)::BIGINT AS l_b,
    coalesce(max(length) FILTER (WHERE is_forward), 0)::DOUBLE AS max_f,
    coalesce(min(length) FILTER (WHERE is_forward), 0)::DOUBLE AS min_f,
    coalesce(max(length) FILTER (WHERE NOT is_forward), 0)::DOUBLE AS max_b,
    coalesce(min(length) FILTER (WHERE NOT is_forward), 0)::DOUBLE AS min_b,
    max(length)::DOUBLE AS most_length, min(length)::DOUBLE AS least_length,
    stddev_pop(length) AS length_std,
    coalesce(avg(iat_us), 0)::DOUBLE AS iat_mean,
    coalesce(stddev_pop(iat_us), 0)::DOUBLE AS iat_std,
    coalesce(max(iat_us), 0)::DOUBLE AS iat_max, coalesce(min(iat_us), 0)::DOUBLE AS iat_min,
    count(*) FILTER (WHERE event_type = 'purchase') AS n_fin,
    count(*) FILTER (WHERE event_type = 'signup') AS n_syn,
    count(*) FILTER (WHERE event_type = 'error') AS n_rst,
    count(*) FILTER (WHERE event_type = 'click') AS n_psh,
    count(*) FILTER (WHERE event_type = 'view') AS n_ack, 0 AS n_urg
  FROM sessions GROUP BY ALL)
"""
FLOW_SESSIONS_SQL = f"""{_FLOW_SQL}
SELECT flow_id, start_us, n_f AS total_fwd_packets, n_b AS total_backward_packets FROM grouped"""
FLOW_FEATURES_SQL = f"""{_FLOW_SQL}
SELECT start_us, flow_id, src_ip AS source_ip, src_port AS source_port,
  dst_ip AS destination_ip, dst_port AS destination_port, protocol,
  strftime(make_timestamp(start_us), '%d/%m/%Y %H:%M:%S') AS "timestamp",
  {', '.join(_flow_feature_sql())}
FROM grouped"""


def rounded_flows(df):
    features = set(K.FEATURE_COLUMNS)
    return df.select(*[
        F.round(F.col(c).cast("double"), _places(c)).alias(c) if c in features else F.col(c)
        for c in df.columns
    ])


@query(FLOW_SESSIONS_SQL)
def flow_sessions(spark, d):
    return _flow_table(spark, d).select(
        "flow_id", "start_us", "total_fwd_packets", "total_backward_packets"
    )


@query(FLOW_FEATURES_SQL)
def flow_features(spark, d):
    return rounded_flows(_flow_table(spark, d))


@query(f"{Q.ALL_SESSIONS} SELECT flow_id, at_us, session_us, iat_us FROM sessions")
def flow_iat(spark, d):
    marked = flows.sessionize(V.packets(spark, d), V.SESSION_GAP_US, V.SESSION_SLICE_US)
    return marked.select(flows.flow_id().alias("flow_id"), "at_us", "session_us", "iat_us")


# --- cleaning ----------------------------------------------------------------------------------

_CELLS = "flow_key, flow_duration, flow_bytes_s"


@query(f"""{Q.ALL_FLOWS} SELECT flow_key AS "flow_key", label AS "label" FROM flows""")
def header_trim(spark, d):
    rows = V.flows(spark, d).select("flow_key", "label")
    padded = rows.toDF(*[f" {c} " for c in rows.columns])
    return cleaning.trim_headers(padded)


@query(f"{Q.ALL_DIRTY} SELECT {_CELLS} FROM finite")
def clean_infinite(spark, d):
    return cleaning.nullify_non_finite(V.dirty_flows(spark, d)).select(*_CELLS.split(", "))


@query(f"""{Q.ALL_DIRTY}
SELECT CAST(count(*) FILTER (WHERE isinf(flow_duration)) AS BIGINT)
  + count(*) FILTER (WHERE isinf(flow_bytes_s)) AS infinities FROM dirty""")
def count_infinities(spark, d):
    return cleaning.count_infinite(V.dirty_flows(spark, d))


@query(f"{Q.ALL_DIRTY} SELECT {_CELLS} FROM positive")
def clean_negative_duration(spark, d):
    finite = cleaning.nullify_non_finite(V.dirty_flows(spark, d))
    return cleaning.drop_negative_durations(finite).select(*_CELLS.split(", "))


@query(f"{Q.ALL_DIRTY} SELECT {_CELLS} FROM screened")
def clean_dedupe(spark, d):
    finite = cleaning.nullify_non_finite(V.dirty_flows(spark, d))
    return cleaning.drop_copies(cleaning.drop_negative_durations(finite)).select(
        *_CELLS.split(", ")
    )


_NUMERIC = ["source_port", "destination_port", "protocol", *V.FEATURES]
_MEDIANS = "medians AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(quantile_cont({c}::DOUBLE, 0.5), 0) AS median "
    "FROM screened" for c in _NUMERIC
) + ")"


@query(f"""{Q.ALL_DIRTY}, {_MEDIANS} SELECT feature, {Q.rd('median', 6)} AS median FROM medians""")
def clean_medians(spark, d):
    medians = cleaning.clean(V.dirty_flows(spark, d))[1]
    return medians.select("feature", F.round("median", 6).alias("median"))


def _imputed(fill) -> str:
    return ", ".join(
        f"coalesce({c}, {fill(c)}) AS {c}" if c in ("flow_duration", "flow_bytes_s") else c
        for c in Q.FLOW_COLUMNS
    )


@query(f"""{Q.ALL_DIRTY}, {_MEDIANS}
SELECT {_imputed(lambda c: f"(SELECT median FROM medians WHERE feature = '{c}')")}
FROM screened""")
def clean_impute(spark, d):
    return cleaning.clean(V.dirty_flows(spark, d))[0]


@query(f"{Q.ALL_DIRTY} SELECT {_imputed(lambda c: '0.0::DOUBLE')} FROM positive")
def clean_for_scoring(spark, d):
    return cleaning.clean(V.dirty_flows(spark, d), training=False)[0]


@query(f"""{Q.ALL_DIRTY}
SELECT (SELECT count(*) FROM dirty) AS initial_rows, count(*) AS final_rows,
  (SELECT count(*) FROM dirty) - count(*) AS rows_removed,
  (SELECT count(*) FILTER (WHERE isinf(flow_duration)) FROM dirty) AS infinities_handled,
  (SELECT count(*) FROM positive) - count(*) AS duplicates_removed,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM positive) AS invalid_durations_dropped,
  CAST(count(*) FILTER (WHERE flow_duration IS NULL)
    + count(*) FILTER (WHERE flow_bytes_s IS NULL) AS BIGINT) AS nulls_imputed
FROM screened""")
def clean_stats(spark, d):
    return cleaning.cleaning_statistics(V.dirty_flows(spark, d))


# --- column roles and projections --------------------------------------------------------------

_ROLE_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", "
    f"'{'metadata' if c in ('flow_id', 'protocol') else 'label' if c == 'label' else role}' "
    f"AS role, count({c}) AS filled FROM flows"
    for i, (c, role) in enumerate(
        [("flow_key", "ignored"), ("flow_id", ""), ("source_ip", "ignored"),
         ("source_port", "feature"), ("destination_ip", "ignored"),
         ("destination_port", "feature"), ("protocol", "")]
        + [(c, "feature") for c in V.FEATURES] + [("label", "")]
    )
)


@query(f"{Q.ALL_FLOWS} {_ROLE_SQL}")
def schema_detect(spark, d):
    rows = V.flows(spark, d)
    filled = rows.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("filled")) for c in rows.columns
    ]).alias("cells")).select(F.inline("cells"))
    return schema.roles_table(rows).join(filled, "column").select(
        "position", "column", "role", "filled"
    )


@query(f"{Q.ALL_FLOWS} SELECT {', '.join(_NUMERIC)} FROM flows")
def numeric_projection(spark, d):
    rows = V.flows(spark, d)
    return rows.select(*cleaning.numeric_columns(rows))


@query(f"{Q.ALL_FLOWS} SELECT flow_id, source_ip, destination_ip, protocol FROM flows")
def metadata_projection(spark, d):
    return schema.metadata_projection(
        V.flows(spark, d), ["flow_id", "source_ip", "destination_ip", "protocol", "sport"]
    )


_PROJECTED = ["flow_duration", "flow_iat_mean", "flow_bytes_s", "down_up_ratio"]


@query(f"""{Q.ALL_FLOWS}
SELECT flow_key, {Q.rd('flow_duration::FLOAT::DOUBLE', 2)} AS flow_duration,
  0.0::DOUBLE AS flow_iat_mean, {Q.rd('flow_bytes_s::FLOAT::DOUBLE', 2)} AS flow_bytes_s,
  {Q.rd('down_up_ratio::FLOAT::DOUBLE', 2)} AS down_up_ratio FROM flows""")
def feature_projection(spark, d):
    projected = schema.feature_projection(V.flows(spark, d), _PROJECTED, ["flow_key"])
    return projected.select(
        "flow_key", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in _PROJECTED]
    )


@query(f"""{Q.ALL_FLOWS} SELECT flow_id AS "Flow ID", source_ip AS "Source IP",
  destination_ip AS "Destination IP", destination_port AS "Destination Port",
  protocol AS "Protocol", flow_duration AS "Flow Duration",
  total_fwd_packets AS "Total Fwd Packets", label AS "Label" FROM flows""")
def telemetry_subset(spark, d):
    return schema.telemetry_subset(schema.to_display(V.flows(spark, d)))


@query(f"""{Q.ALL_FLOWS}
SELECT flow_key, source_ip, destination_port, flow_duration, CAST(NULL AS DOUBLE) AS flow_bytes_s
FROM flows
UNION ALL SELECT flow_key, destination_ip, source_port, CAST(NULL AS DOUBLE), flow_bytes_s
FROM flows WHERE total_backward_packets > 4""")
def json_records(spark, d):
    """One object per row, or an array of two partial objects, parsed back."""
    first = F.struct("source_ip", "destination_port", "flow_duration")
    second = F.struct(
        F.col("destination_ip").alias("source_ip"), F.col("source_port").alias("destination_port"),
        "flow_bytes_s",
    )
    body = F.when(
        F.col("total_backward_packets") > 4,
        F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]")),
    ).otherwise(F.to_json(first))
    documents = V.flows(spark, d).select("flow_key", body.alias("body"))
    return schema.parse_records(
        documents, "body",
        "source_ip string, destination_port int, flow_duration double, flow_bytes_s double",
    )


# --- labels ------------------------------------------------------------------------------------

_DICTIONARY = """dictionary AS (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx, name,
    name = 'BENIGN' AS is_benign
  FROM (SELECT DISTINCT trim(label) AS name FROM flows))"""
_KNOWN_DICTIONARY = _DICTIONARY.replace("FROM flows)", "FROM flows WHERE label <> 'Botnet')")


@query(f"{Q.ALL_FLOWS}, {_DICTIONARY} SELECT * FROM dictionary")
def class_dictionary(spark, d):
    return schema.class_dictionary(V.flows(spark, d), "label")


@query(f"""{Q.ALL_FLOWS}, {_DICTIONARY}
SELECT flow_key, label, idx AS y_multi, CAST(NOT is_benign AS INTEGER) AS y_binary
FROM flows JOIN dictionary ON trim(label) = name""")
def label_encode(spark, d):
    rows = V.flows(spark, d).withColumn("label", F.concat(F.lit(" "), "label", F.lit(" ")))
    encoded = schema.encode_labels(rows, "label", schema.class_dictionary(rows, "label"))
    return encoded.select("flow_key", F.trim("label").alias("label"), "y_multi", "y_binary")


@query(f"""{Q.ALL_FLOWS}, {_KNOWN_DICTIONARY}
SELECT flow_key, coalesce(idx, (SELECT idx FROM dictionary WHERE is_benign)) AS y_multi,
  idx IS NULL AS is_unseen FROM flows LEFT JOIN dictionary ON label = name""")
def label_unseen_to_benign(spark, d):
    rows = V.flows(spark, d)
    known = schema.class_dictionary(schema.without_class(rows, "label", "Botnet"), "label")
    return schema.encode_labels(rows, "label", known).select("flow_key", "y_multi", "is_unseen")


@query(f"""{Q.ALL_FLOWS}, {_KNOWN_DICTIONARY}
SELECT y_binary, count(*) AS n FROM (
  SELECT CAST(idx IS NOT NULL AND NOT is_benign AS INTEGER) AS y_binary
  FROM flows LEFT JOIN dictionary ON label = name) GROUP BY y_binary""")
def label_binary(spark, d):
    rows = V.flows(spark, d)
    known = schema.class_dictionary(schema.without_class(rows, "label", "Botnet"), "label")
    return schema.encode_labels(rows, "label", known).groupBy("y_binary").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"""{Q.ALL_FLOWS} SELECT label AS "class", count(*) AS n FROM flows GROUP BY label""")
def class_counts(spark, d):
    return schema.class_counts(V.flows(spark, d), "label")


@query(f"""{Q.ALL_FLOWS}
SELECT "class", n, {Q.rd('sum(n) OVER () / (count(*) OVER () * n::DOUBLE)', 6)} AS weight
FROM (SELECT label AS "class", count(*) AS n FROM flows GROUP BY label)""")
def class_weights(spark, d):
    return schema.class_weights(V.flows(spark, d), "label").select(
        "class", "n", F.round("weight", 6).alias("weight")
    )


@query(f"""{Q.ALL_FLOWS}, {_KNOWN_DICTIONARY}
SELECT DISTINCT label AS name FROM flows EXCEPT SELECT name FROM dictionary""")
def class_difference(spark, d):
    rows = V.flows(spark, d)
    known = schema.class_dictionary(schema.without_class(rows, "label", "Botnet"), "label")
    return schema.unseen_classes(rows, "label", known)


@query(f"""{Q.ALL_FLOWS}
SELECT flow_key, label, CASE WHEN label = 'DDoS' THEN 'unseen' WHEN label = 'BENIGN'
  THEN 'benign' ELSE 'train' END AS part FROM flows
UNION ALL SELECT flow_key, label, 'train' FROM flows WHERE label = 'BENIGN'""")
def held_out_split(spark, d):
    """Training rows without one class, its rows as the unseen part, and the benign rows."""
    rows = V.flows(spark, d).select("flow_key", "label").withColumn(
        "y_binary", (F.col("label") != "BENIGN").cast("int")
    )
    train = schema.without_class(rows, "label", "DDoS").withColumn("part", F.lit("train"))
    unseen = schema.only_class(rows, "label", "DDoS").withColumn("part", F.lit("unseen"))
    benign = schema.benign_or_all(rows).withColumn("part", F.lit("benign"))
    return train.unionByName(unseen).unionByName(benign).drop("y_binary")


# --- derived columns ---------------------------------------------------------------------------

_DRAWN = {
    "flow_duration": "flow_duration", "n_fwd": "total_fwd_packets::INTEGER",
    "n_bwd": "total_backward_packets::INTEGER", "mean_fwd": "flow_bytes_s / 70.1234::DOUBLE",
    "mean_bwd": "fwd_packet_length_mean / 3.12345::DOUBLE", "syn": "1", "ack": "protocol", "rst": "rst_flag_count",
    "psh": "psh_flag_count", "win_fwd": "8192", "win_bwd": "0", "fin": "fin_flag_count",
}


def _derived_sql() -> list[str]:
    n, total = "(n_fwd + n_bwd)", "(n_fwd * mean_fwd + n_bwd * mean_bwd)"
    s = "greatest(flow_duration / 1e6::DOUBLE, 0.0001::DOUBLE)"
    iat = f"(flow_duration / greatest({n} - 1, 1))"
    mean = f"({total} / greatest({n}, 1))"
    low = "0.4::DOUBLE", "0.3::DOUBLE"
    values = [
        "flow_duration", "n_fwd", "n_bwd", "n_fwd * mean_fwd", "n_bwd * mean_bwd",
        "mean_fwd * 1.5::DOUBLE", f"greatest(0, mean_fwd * {low[0]})", "mean_fwd",
        "mean_bwd * 1.5::DOUBLE", f"greatest(0, mean_bwd * {low[1]})", "mean_bwd",
        f"{total} / {s}", f"{n} / {s}", iat, f"{iat} * 0.4::DOUBLE",
        "flow_duration * 0.6::DOUBLE", "greatest(1.0::DOUBLE, flow_duration * 0.02::DOUBLE)",
        "flow_duration * 0.9::DOUBLE", "flow_duration * 0.8::DOUBLE",
        "CAST(psh > 0 AS INTEGER)", "0", "0", "0", "n_fwd * 20", "n_bwd * 20",
        f"n_fwd / {s}", f"n_bwd / {s}",
        f"least(mean_fwd * {low[0]}, mean_bwd * {low[1]})",
        "greatest(mean_fwd * 1.5::DOUBLE, mean_bwd * 1.5::DOUBLE)", mean,
        "abs(mean_fwd - mean_bwd) * 0.5::DOUBLE",
        "fin", "syn", "rst", "psh", "ack", "0", "n_bwd / greatest(n_fwd, 1)::DOUBLE", mean,
        "mean_fwd", "mean_bwd", "n_fwd", "n_fwd * mean_fwd", "n_bwd", "n_bwd * mean_bwd",
        "win_fwd", "win_bwd", "greatest(n_fwd - 2, 0)", "20", "flow_duration * 0.1::DOUBLE",
        "flow_duration * 0.2::DOUBLE",
    ]
    return [f"{Q.rd(e, 4)} AS {n}" for n, e in zip(K.FEATURE_COLUMNS, values, strict=True)]


@query(f"""{Q.ALL_FLOWS},
drawn AS (SELECT flow_key, {', '.join(f'{e} AS {n}' for n, e in _DRAWN.items())} FROM flows)
SELECT flow_key, {', '.join(_derived_sql())} FROM drawn""")
def derive_flow_metrics(spark, d):
    c = F.col
    drawn = V.flows(spark, d).select(
        "flow_key", "flow_duration", c("total_fwd_packets").cast("int").alias("n_fwd"),
        c("total_backward_packets").cast("int").alias("n_bwd"),
        (c("flow_bytes_s") / 70.1234).alias("mean_fwd"),
        (c("fwd_packet_length_mean") / 3.12345).alias("mean_bwd"), F.lit(1).alias("syn"),
        c("protocol").alias("ack"), c("rst_flag_count").alias("rst"),
        c("psh_flag_count").alias("psh"), F.lit(8192).alias("win_fwd"),
        F.lit(0).alias("win_bwd"), c("fin_flag_count").alias("fin"),
    )
    derived = derive.derive_flow_metrics(drawn, ["flow_key"])
    return derived.select(
        "flow_key",
        *[F.round(c(n).cast("double"), 4).alias(n) for n in K.FEATURE_COLUMNS],
    )


def _drawn_sql(name: str, low: int, high: int) -> str:
    return f"CAST(('0x' || substr(md5(flow_key || '|42|{name}'), 1, 8))::BIGINT % {high - low + 1} + {low} AS INTEGER)"


_OVERRIDDEN = {
    "destination_ip": "'192.168.1.5'", "protocol": "6", "flow_duration": "850000.0::DOUBLE",
    "total_fwd_packets": "350.0::DOUBLE", "total_backward_packets": "2.0::DOUBLE",
    "flow_bytes_s": "250000.0::DOUBLE", "rst_flag_count": "45",
    "fwd_packet_length_mean": "1380.0::DOUBLE", "label": "'UNKNOWN_ANOMALY'",
    "source_ip": f"'10.240.' || {_drawn_sql('ip1', 1, 254)} || '.' || {_drawn_sql('ip2', 1, 254)}",
    "source_port": _drawn_sql("source", 49152, 65535), "destination_port": _drawn_sql("destination", 8000, 9000),
}


@query(f"""{Q.ALL_FLOWS}
SELECT {', '.join(Q.FLOW_COLUMNS)}, '2024-01-01 00:00:00' AS timestamp FROM flows
UNION ALL SELECT {', '.join(f'{_OVERRIDDEN.get(c, c)} AS {c}' for c in Q.FLOW_COLUMNS)}, '2024-03-05 06:07:08' AS timestamp
FROM (SELECT * FROM flows ORDER BY flow_key LIMIT 1)""")
def inject_override(spark, d):
    rows = V.flows(spark, d).withColumn("timestamp", F.lit("2024-01-01 00:00:00"))
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    return derive.inject_novel(rows, rows.orderBy("flow_key").limit(1), key="flow_key", at=at)


@query(f"""{Q.ALL_FLOWS} SELECT flow_key, flow_id, '2024-03-05 06:07:08' AS timestamp FROM flows""")
def stamp_now(spark, d):
    """Rows stamped with a time; here a given one instead of the clock's."""
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    return derive.stamp_now(V.flows(spark, d).select("flow_key", "flow_id"), at=at)


# --- splits and samples ------------------------------------------------------------------------

_RANKED = f"""ranked AS (
  SELECT flow_key, label, rank() OVER (PARTITION BY label ORDER BY {Q.hash_of('flow_key')}) AS r,
    count(*) OVER (PARTITION BY label) AS size FROM flows),
sized AS (SELECT *, CAST(ceil(round(size * 0.3::DOUBLE, 6)) AS BIGINT) AS held FROM ranked)"""


@query(f"""{Q.ALL_FLOWS}, {_RANKED}
SELECT flow_key, label, CASE WHEN r <= size - held THEN 'train'
  WHEN r <= size - CAST(ceil(round(held * 0.5::DOUBLE, 6)) AS BIGINT) THEN 'validation'
  ELSE 'test' END AS split FROM sized""")
def stratified_split(spark, d):
    return splitting.split(
        V.flows(spark, d).select("flow_key", "label"), "label", ["flow_key"], seed=SEED
    )


@query(f"""{Q.ALL_FLOWS},
lone AS (SELECT flow_key, {Q.hash_of('flow_key')} AS h,
  CASE WHEN flow_key = (SELECT min(flow_key) FROM flows) THEN 'Lone' ELSE label END AS label FROM flows),
first AS (SELECT *, rank() OVER (ORDER BY h) AS r, count(*) OVER () AS size FROM lone),
rest AS (SELECT *, count(*) OVER (PARTITION BY label) AS own FROM first
  WHERE r > size - CAST(ceil(round(size * 0.3::DOUBLE, 6)) AS BIGINT)),
strata AS (SELECT flow_key, label, h, CASE WHEN (SELECT min(own) FROM rest) >= 2 THEN label ELSE '' END AS stratum FROM rest),
second AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY h) AS q, count(*) OVER (PARTITION BY stratum) AS held FROM strata)
SELECT flow_key, first.label, CASE WHEN q IS NULL THEN 'train'
  WHEN q <= held - CAST(ceil(round(held * 0.5::DOUBLE, 6)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
FROM first LEFT JOIN second USING (flow_key)""")
def split_lone_class(spark, d):
    """A class of one row cannot be held out by share: all rows are one stratum then."""
    rows = V.flows(spark, d).select("flow_key", "label")
    lone = rows.agg(F.min("flow_key")).head()[0]
    return splitting.split(
        rows.withColumn("label", F.when(F.col("flow_key") == lone, "Lone").otherwise(F.col("label"))), "label", ["flow_key"], seed=SEED)


@query(f"""{Q.ALL_FLOWS}
SELECT flow_key, y FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY {Q.hash_of('flow_key')}) AS r
  FROM (SELECT flow_key, CAST(label <> 'BENIGN' AS INTEGER) AS y FROM flows)) WHERE r <= 200""")
def balanced_sample(spark, d):
    rows = V.flows(spark, d).select(
        "flow_key", (F.col("label") != "BENIGN").cast("int").alias("y")
    )
    return splitting.balanced_sample(rows, "y", ["flow_key"], 400, SEED)


_POSITIONS = f"""placed AS (
  SELECT flow_key, label, row_number() OVER (ORDER BY {Q.hash_of('flow_key')}) - 1 AS position
  FROM flows)"""


@query(f"{Q.ALL_FLOWS}, {_POSITIONS} SELECT flow_key, position FROM placed")
def seeded_shuffle(spark, d):
    return splitting.shuffled(V.flows(spark, d).select("flow_key"), ["flow_key"], SEED)


@query(f"""{Q.ALL_FLOWS} SELECT flow_key, label FROM flows
ORDER BY {Q.hash_of('flow_key')} LIMIT 300""")
def evaluation_sample(spark, d):
    return splitting.first_rows(
        V.flows(spark, d).select("flow_key", "label"), [row_hash("flow_key", seed=SEED)], 300
    )


REPLAY_SQL = f"""{Q.ALL_FLOWS}, {_POSITIONS}
SELECT event_id AS tick, flow_key, label FROM events
JOIN placed ON position = event_id % (SELECT count(*) FROM flows)"""


@query(REPLAY_SQL)
def replay_batch(spark, d):
    rows = replay.numbered(V.flows(spark, d).select("flow_key", "label"), ["flow_key"], SEED)
    ticks = V.table(spark, d, "events").select(F.col("event_id").alias("tick"))
    return replay.replay(rows, ticks, V.flows(spark, d).count()).select(
        "tick", "flow_key", "label"
    )


# --- sources and sinks -------------------------------------------------------------------------


@query(f"""{Q.ALL_FLOWS}
SELECT label, protocol, count(*) AS n, {Q.rd('sum(flow_bytes_s)', 2)} AS bytes,
  count(*) FILTER (WHERE l_partkey % 97 = 0) AS infinite FROM flows GROUP BY label, protocol""")
def csv_roundtrip(spark, d):
    """Rows written as CSV (with infinite cells) and read back with found types."""
    path = scratch_path(spark, "csv")
    lines = V.table(spark, d, "lineitem")
    rows = lines.select(*V.flow_columns(), F.col("l_partkey"))
    tables.write_csv(
        rows.withColumn(
            "flow_duration",
            F.when(F.col("l_partkey") % 97 == 0, float("inf")).otherwise(F.col("flow_duration")),
        ), path,
    )
    back = tables.read_csv(spark, path)
    return back.groupBy("label", F.col("protocol").cast("int").alias("protocol")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("flow_bytes_s").cast("decimal(18,2)")).cast("double"), 2)
        .alias("bytes"),
        F.count_if(F.col("flow_duration") == float("inf")).alias("infinite"),
    )


_CSV_SCHEMA = "flow_key string, flow_duration double, protocol int, not_there double"


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_partkey % 97 = 0) AS d, count(*) FILTER (l_suppkey % 41 = 0) AS p,
  count(*) FILTER (l_partkey % 89 = 0 AND l_partkey % 97 <> 0) AS e FROM lineitem)
SELECT 'flow_key' AS "column", 0 AS nulls, 0 AS unreadable FROM c UNION ALL SELECT 'flow_duration', d + e, d FROM c
UNION ALL SELECT 'protocol', p, p FROM c UNION ALL SELECT 'not_there', n, 0 FROM c""")
def csv_schema(spark, d):
    """Rows written as CSV with unreadable and empty cells, read back with a schema that has one more column."""
    path, schema = scratch_path(spark, "csv"), T.StructType.fromDDL(_CSV_SCHEMA)
    part = F.col("l_partkey")
    rows = V.table(spark, d, "lineitem").select(*V.flow_columns(), part, "l_suppkey").select(
        "flow_key", F.when(part % 97 == 0, "n/a").when(part % 89 == 0, None).otherwise(F.col("flow_duration").cast("string"))
        .alias("flow_duration"),
        F.when(F.col("l_suppkey") % 41 == 0, "tcp").otherwise(F.col("protocol").cast("string")).alias("protocol"))
    tables.write_csv(rows, path)
    return tables.unreadable_cells(tables.read_csv(spark, path, schema, "rescued"), schema)


@query(None)
def synthetic_flows(spark, d):
    return V.synthetic(spark, d)
