"""SQL text of the test-table views, for the side-by-side check of the queries."""

from __future__ import annotations

from wirelens import constants as K
from wirelens.sources import views as V


def rd(expr: str, places: int) -> str:
    """Round half away from zero on the decimal text of a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{places + 6})), {places}) AS DOUBLE)"


def fixed(expr: str, places: int) -> str:
    return f"printf('%.{places}f', {rd(expr, places)})"


def grouped(expr: str, places: int) -> str:
    return f"printf('%,.{places}f', {rd(expr, places)})"


def signed(expr: str, places: int) -> str:
    return f"format('{{:+.{places}f}}', {rd(expr, places)})"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


PACKETS = """packets AS (
  SELECT '10.0.0.' || user_id AS src_ip, '192.168.1.' || (user_id % 5) AS dst_ip,
    CAST(1024 + user_id AS INTEGER) AS src_port,
    CAST(CASE user_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 443 ELSE 53 END AS INTEGER) AS dst_port,
    CAST(CASE WHEN user_id % 3 = 2 THEN 17 ELSE 6 END AS INTEGER) AS protocol,
    epoch_us(ts) AS at_us, CAST(floor(value) AS INTEGER) + 40 AS length,
    event_id % 3 <> 0 AS is_forward, event_type
  FROM events)"""

SESSIONS = f"""lagged AS (
  SELECT *, src_ip || '-' || dst_ip || '-' || src_port || '-' || dst_port || '-' || protocol
      AS flow_id,
    lag(at_us) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY at_us)
      AS prev
  FROM packets),
marked AS (
  SELECT *, prev IS NULL OR at_us - prev > {V.SESSION_GAP_US} AS opens FROM lagged),
sessions AS (
  SELECT *, max(CASE WHEN opens THEN at_us END) OVER (PARTITION BY flow_id ORDER BY at_us
      ROWS UNBOUNDED PRECEDING) AS session_us,
    CASE WHEN NOT opens THEN at_us - prev END AS iat_us
  FROM marked)"""

FLOWS = """flows AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CAST(l_quantity AS INTEGER), CAST(round(l_extendedprice * 100) AS BIGINT),
      l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS flow_key,
    '10.0.0.' || (l_suppkey % 250) || '-192.168.1.' || (l_partkey % 250) || '-'
      || (l_orderkey % 60000 + 1024) || '-'
      || CASE l_linenumber % 3 WHEN 0 THEN '80-6' WHEN 1 THEN '443-6' ELSE '53-17' END
      AS flow_id,
    '10.0.0.' || (l_suppkey % 250) AS source_ip,
    CAST(l_orderkey % 60000 + 1024 AS INTEGER) AS source_port,
    '192.168.1.' || (l_partkey % 250) AS destination_ip,
    CAST(CASE l_linenumber % 3 WHEN 0 THEN 80 WHEN 1 THEN 443 ELSE 53 END AS INTEGER)
      AS destination_port,
    CAST(CASE l_linenumber % 3 WHEN 2 THEN 17 ELSE 6 END AS INTEGER) AS protocol,
    l_quantity * 1000.0::DOUBLE AS flow_duration,
    l_quantity AS total_fwd_packets,
    CAST(l_linenumber AS DOUBLE) AS total_backward_packets,
    l_extendedprice AS flow_bytes_s,
    abs(l_discount) AS down_up_ratio,
    abs(l_tax) * 1000.0::DOUBLE AS fwd_packet_length_mean,
    0.0::DOUBLE AS bwd_psh_flags,
    l_quantity * l_quantity * l_quantity / 100.0::DOUBLE AS average_packet_size,
    CAST(CASE WHEN l_partkey % 50 = 0 THEN 20 ELSE 0 END AS INTEGER) AS rst_flag_count,
    CAST(CASE WHEN l_suppkey % 25 = 0 THEN 40 ELSE 3 END AS INTEGER) AS psh_flag_count,
    CAST(CASE WHEN l_orderkey % 30 = 0 THEN 2 ELSE 20 END AS INTEGER) AS fwd_header_length,
    CAST(CASE WHEN l_orderkey % 40 = 1 THEN 0 ELSE 1 END AS INTEGER) AS fin_flag_count,
    CASE WHEN l_returnflag = 'N' THEN 'BENIGN'
      WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'DDoS'
      WHEN l_returnflag = 'A' THEN 'PortScan'
      WHEN l_linestatus = 'F' THEN 'BruteForce' ELSE 'Botnet' END AS label,
    l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax
  FROM lineitem)"""

FLOW_COLUMNS = ["flow_key", *V.METADATA, *V.FEATURES, "label"]

_CHANGED = {
    "flow_duration": "CASE WHEN l_partkey % 97 = 0 THEN 'inf'::DOUBLE "
                     "WHEN l_suppkey % 41 = 0 THEN -flow_duration ELSE flow_duration END",
    "flow_bytes_s": "CASE WHEN l_partkey % 89 = 0 THEN 'nan'::DOUBLE ELSE flow_bytes_s END",
}
_DIRTY_LIST = ", ".join(
    f"{_CHANGED[c]} AS {c}" if c in _CHANGED else c for c in FLOW_COLUMNS
)
_NULLIFIED = ", ".join(
    f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END AS {c}" if c in _CHANGED else c
    for c in FLOW_COLUMNS
)

DIRTY = f"""dirty0 AS (SELECT {_DIRTY_LIST}, l_orderkey FROM flows),
dirty AS (
  SELECT {', '.join(FLOW_COLUMNS)} FROM dirty0
  UNION ALL SELECT {', '.join(FLOW_COLUMNS)} FROM dirty0 WHERE l_orderkey % 50 = 0),
finite AS (SELECT {_NULLIFIED} FROM dirty),
positive AS (SELECT * FROM finite WHERE NOT coalesce(flow_duration < 0, false)),
screened AS (SELECT DISTINCT * FROM positive)"""

_REST = "(1.0::DOUBLE - l_quantity / 50.0::DOUBLE)"
_PROBABILITIES = ", ".join(
    ["l_quantity / 50.0::DOUBLE"]
    + [f"CASE WHEN 1 + l_linenumber % 4 = {i} THEN {_REST} * 0.7::DOUBLE "
       f"ELSE {_REST} * 0.1::DOUBLE END" for i in range(1, 5)]
)
_CLASS_LIST = "[" + ", ".join(text(c) for c in V.CLASSES) + "]"

SCORES = f"""scored0 AS (
  SELECT *, abs(l_discount) * 10.0::DOUBLE AS if_score, abs(l_tax) * 0.5::DOUBLE AS ae_error,
    {V.AE_THRESHOLD}::DOUBLE AS ae_threshold, [{_PROBABILITIES}] AS probabilities,
    CASE WHEN (l_suppkey % 100) / 100.0::DOUBLE >= 0.5 THEN 'ANOMALY' ELSE 'BENIGN' END
      AS q_label,
    greatest((l_suppkey % 100) / 100.0::DOUBLE, 1.0::DOUBLE - (l_suppkey % 100) / 100.0::DOUBLE)
      AS q_confidence
  FROM flows),
scores AS (
  SELECT *, CAST(list_position(probabilities, list_max(probabilities)) - 1 AS INTEGER)
      AS rf_index,
    list_max(probabilities) AS rf_confidence,
    {_CLASS_LIST}[list_position(probabilities, list_max(probabilities))] AS rf_class,
    {rd('probabilities[1]', 4)} AS p_benign
  FROM scored0)"""


def _tier(expr: str, tiers) -> str:
    arms = " ".join(f"WHEN {expr} < {upper} THEN '{name}'" for upper, name in tiers)
    return f"CASE {arms} ELSE 'CRITICAL' END"


def severity_unit(expr: str) -> str:
    return _tier(expr, [(0.30, "NORMAL"), (0.60, "LOW"), (0.80, "MEDIUM"), (0.90, "HIGH")])


def severity_risk(expr: str) -> str:
    return _tier(expr, [(20.0, "SAFE"), (40.0, "LOW"), (60.0, "MEDIUM"), (80.0, "HIGH")])


def clip(expr: str, low, high) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {expr}))"


_NORMAL = clip("(0.6::DOUBLE * composite + 0.4::DOUBLE * attack) * 50.0::DOUBLE", 2.0, 35.0)
_KNOWN = clip(
    "45.0::DOUBLE + (0.35::DOUBLE * composite + 0.35::DOUBLE * attack"
    " + 0.30::DOUBLE * rf_confidence) * 55.0::DOUBLE", 60.0, 98.0)
_NOVEL = clip(
    "55.0::DOUBLE + (0.5::DOUBLE * composite + 0.5::DOUBLE * (1.0::DOUBLE - rf_confidence))"
    " * 40.0::DOUBLE", 70.0, 95.0)


def _pick(normal: str, known: str, novel: str) -> str:
    return (f"CASE WHEN NOT anomalous THEN {normal} WHEN is_known THEN {known} ELSE {novel} END")


FUSED = f"""fused0 AS (
  SELECT *, if_score >= 0.5 AS if_flag, ae_error > ae_threshold AS ae_flag,
    {clip('1.0::DOUBLE / (1.0::DOUBLE + exp(-2.5::DOUBLE * (ae_error / greatest(ae_threshold, '
          '1e-6::DOUBLE) - 0.85::DOUBLE)))', 0.0, 1.0)} AS ae_score,
    1.0::DOUBLE - p_benign AS attack
  FROM scores),
fused1 AS (
  SELECT *, 0.5::DOUBLE * if_score + 0.5::DOUBLE * ae_score AS composite,
    upper(rf_class) <> 'BENIGN' AND rf_confidence >= 0.6::DOUBLE AS is_known FROM fused0),
fused2 AS (
  SELECT *, (if_flag AND ae_flag) OR composite >= 0.55::DOUBLE OR attack >= 0.65::DOUBLE
    AS anomalous FROM fused1),
fused3 AS (SELECT *, {_pick(_NORMAL, _KNOWN, _NOVEL)} AS final_risk FROM fused2),
fused AS (
  SELECT *, {_pick(text(K.STATUS_NORMAL), text(K.STATUS_KNOWN), text(K.STATUS_NOVEL))} AS status,
    {rd('final_risk', 1)} AS risk_score, {severity_risk('final_risk')} AS severity,
    {_pick("'BENIGN'", "'Possible ' || rf_class", text(K.CATEGORY_NOVEL))} AS attack_category,
    anomalous AND NOT is_known AS is_novel_anomaly,
    {rd('rf_confidence', 3)} AS confidence,
    {_pick(text(K.NOTES_NORMAL),
           "'Network flow signature closely matches known ' || rf_class || "
           "' attack telemetry.'", text(K.NOTES_NOVEL))} AS analyst_notes,
    {_pick(text(K.RECOMMEND_NORMAL),
           "'Verify source ' || source_ip || ' and inspect destination service on port ' || "
           "destination_port || '.'", text(K.RECOMMEND_NOVEL))} AS recommendation,
    CASE WHEN final_risk < 30 THEN {text(K.HEADLINE_QUIET)}
      ELSE 'Threat detection flagged with Risk Score ' || {fixed('final_risk', 0)}
        || '/100 based on the following corroborating factors:' END AS headline
  FROM fused3)"""

TIERED = f"""tiered AS (
  SELECT flow_key, flow_id, source_ip, destination_ip, destination_port,
    CASE WHEN if_score < 0.45 THEN 'NORMAL' ELSE status END AS status,
    CASE WHEN if_score < 0.45 THEN {rd('if_score * 45.0::DOUBLE', 1)} ELSE risk_score END
      AS risk_score,
    CASE WHEN if_score < 0.45 THEN 'SAFE' ELSE severity END AS severity,
    CASE WHEN if_score < 0.45 THEN 'BENIGN' ELSE attack_category END AS attack_category,
    if_score >= 0.45 AND is_novel_anomaly AS is_novel_anomaly,
    CASE WHEN if_score < 0.45 THEN 0.98::DOUBLE ELSE confidence END AS confidence,
    CASE WHEN if_score < 0.45 THEN {text(K.NOTES_SCREENED)} ELSE analyst_notes END
      AS analyst_notes,
    CASE WHEN if_score < 0.45 THEN 'TIER_1_FAST_SCREENING' ELSE 'TIER_2_FULL_EVALUATION' END
      AS tier_used,
    {rd('if_score', 3)} AS if_anomaly_score,
    CASE WHEN if_score < 0.45 THEN 'BENIGN' ELSE rf_class END AS rf_class,
    CASE WHEN if_score < 0.45 THEN {text(K.BYPASSED)} ELSE {fixed('ae_error', 5)} END
      AS ae_result,
    CASE WHEN if_score < 0.45 THEN {text(K.BYPASSED)} ELSE q_label END AS kernel_result,
    CASE WHEN if_score < 0.45 THEN {text(K.HEADLINE_SCREENED)} ELSE headline END AS headline
  FROM fused)"""

ALL_FLOWS = with_(FLOWS)
ALL_DIRTY = with_(FLOWS, DIRTY)
ALL_SCORES = with_(FLOWS, SCORES)
ALL_FUSED = with_(FLOWS, SCORES, FUSED)
ALL_TIERED = with_(FLOWS, SCORES, FUSED, TIERED)
ALL_SESSIONS = with_(PACKETS, SESSIONS)


def hash_of(key: str, seed: int = 42) -> str:
    return f"md5({key} || '|{seed}')"
