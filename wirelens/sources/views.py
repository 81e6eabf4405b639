"""Views of the test tables in the shapes the operators read (packets, flows, dirty flows, scores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.functions import scores as S
from wirelens.operators.flows import MICROS, port_protocol
from wirelens.sources.synthetic import generate_flows
from wirelens.workspace import spread

SESSION_GAP_US = 6 * 3600 * MICROS
# slices of two days keep some 4 packets of a user together in the test table
SESSION_SLICE_US = 48 * 3600 * MICROS
# and buckets of the stream some 40
SESSION_BUCKET_US = 20 * 24 * 3600 * MICROS

FLAG_BY_EVENT = {
    "signup": "SYN", "view": "ACK", "click": "PSH", "error": "RST", "purchase": "FIN",
}
FEATURES = [
    "flow_duration", "total_fwd_packets", "total_backward_packets", "flow_bytes_s",
    "down_up_ratio", "fwd_packet_length_mean", "bwd_psh_flags", "average_packet_size",
    "rst_flag_count", "psh_flag_count", "fwd_header_length", "fin_flag_count",
]
# without the column that is a multiple of another one: equal scores have no rank
DISTINCT_FEATURES = [f for f in FEATURES if f != "total_fwd_packets"]
METADATA = ["flow_id", "source_ip", "source_port", "destination_ip", "destination_port",
            "protocol"]
CLASSES = ["BENIGN", "Botnet", "BruteForce", "DDoS", "PortScan"]
AE_THRESHOLD = 0.0126


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf_dir)
    )


def packets_from(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    flag = None
    for event, name in FLAG_BY_EVENT.items():
        test = F.col("event_type") == event
        flag = F.when(test, name) if flag is None else flag.when(test, name)
    port = F.when(user % 3 == 0, 80).when(user % 3 == 1, 443).otherwise(53)
    return events.select(
        F.concat(F.lit("10.0.0."), user.cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.1."), (user % 5).cast("string")).alias("dst_ip"),
        (user + 1024).cast("int").alias("src_port"),
        port.alias("dst_port"),
        port_protocol(port).alias("protocol"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.floor("value") + 40).cast("int").alias("length"),
        (F.col("event_id") % 3 != 0).alias("is_forward"),
        F.create_map(flag, F.lit(1)).alias("flags"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(table(spark, sf_dir, "events"))


def flow_key() -> Column:
    return F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in
          ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        "l_returnflag", "l_linestatus",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


def class_label() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when(flag == "N", "BENIGN")
        .when((flag == "A") & (status == "F"), "DDoS")
        .when(flag == "A", "PortScan")
        .when(status == "F", "BruteForce")
        .otherwise("Botnet")
    )


def flow_columns() -> list[Column]:
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    source = F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 250).cast("string"))
    target = F.concat(F.lit("192.168.1."), (F.col("l_partkey") % 250).cast("string"))
    source_port = (order % 60000 + 1024).cast("int")
    port = F.when(line % 3 == 0, 80).when(line % 3 == 1, 443).otherwise(53)
    protocol = port_protocol(port)
    return [
        flow_key().alias("flow_key"),
        F.concat_ws(
            "-", source, target, source_port.cast("string"), port.cast("string"),
            protocol.cast("string"),
        ).alias("flow_id"),
        source.alias("source_ip"), source_port.alias("source_port"),
        target.alias("destination_ip"), port.alias("destination_port"),
        protocol.alias("protocol"),
        (F.col("l_quantity") * 1000.0).alias("flow_duration"),
        F.col("l_quantity").alias("total_fwd_packets"),
        line.cast("double").alias("total_backward_packets"),
        F.col("l_extendedprice").alias("flow_bytes_s"),
        F.abs("l_discount").alias("down_up_ratio"),
        (F.abs("l_tax") * 1000.0).alias("fwd_packet_length_mean"),
        F.lit(0.0).alias("bwd_psh_flags"),
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") / 100.0).alias(
            "average_packet_size"
        ),
        F.when(F.col("l_partkey") % 50 == 0, 20).otherwise(0).alias("rst_flag_count"),
        F.when(F.col("l_suppkey") % 25 == 0, 40).otherwise(3).alias("psh_flag_count"),
        F.when(order % 30 == 0, 2).otherwise(20).alias("fwd_header_length"),
        F.when(order % 40 == 1, 0).otherwise(1).alias("fin_flag_count"),
        class_label().alias("label"),
    ]


def flows_from(lines: DataFrame) -> DataFrame:
    return lines.select(*flow_columns())


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from(spread(table(spark, sf_dir, "lineitem")))


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with infinite, missing and negative cells and with copied rows."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines.select(*flow_columns(), "l_orderkey", "l_partkey", "l_suppkey").withColumns({
        "flow_duration": F.when(part % 97 == 0, float("inf"))
        .when(supplier % 41 == 0, -F.col("flow_duration"))
        .otherwise(F.col("flow_duration")),
        "flow_bytes_s": F.when(part % 89 == 0, float("nan")).otherwise(F.col("flow_bytes_s")),
    })
    copies = rows.where(F.col("l_orderkey") % 50 == 0)
    return rows.unionByName(copies).drop("l_orderkey", "l_partkey", "l_suppkey")


def scores_from(lines: DataFrame) -> DataFrame:
    """Flows with model scores set by fixed arithmetic, so any engine can repeat them; class,
    confidence and probability map are ready for fusion."""
    benign = F.col("l_quantity") / 50.0
    rest = F.lit(1.0) - benign
    chosen = F.lit(1) + F.col("l_linenumber") % 4
    probabilities = F.array(
        benign,
        *[F.when(chosen == i, rest * 0.7).otherwise(rest * 0.1) for i in range(1, 5)],
    )
    anomaly = (F.col("l_suppkey") % 100).cast("double") / 100.0
    rows = lines.select(
        *flow_columns(),
        (F.abs("l_discount") * 10.0).alias("if_score"),
        (F.abs("l_tax") * 0.5).alias("ae_error"),
        F.lit(AE_THRESHOLD).alias("ae_threshold"),
        probabilities.alias("probabilities"),
        F.when(anomaly >= 0.5, "ANOMALY").otherwise("BENIGN").alias("q_label"),
        F.greatest(anomaly, F.lit(1.0) - anomaly).alias("q_confidence"),
    )
    return rows.withColumns({
        "rf_index": S.top_class(F.col("probabilities")),
        "rf_confidence": F.array_max("probabilities"),
        "class_probabilities": S.probability_map(F.col("probabilities"), CLASSES),
    }).withColumn("rf_class", S.class_name(F.col("rf_index"), CLASSES))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_from(spread(table(spark, sf_dir, "lineitem")))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four angles in [0, pi] per vector, from the sums of its four quarters of 16 coordinates (at most 4
    for a unit vector), and a binary label."""
    def total(quarter: int):
        parts = [F.get("embedding", F.lit(16 * quarter + i)).cast("double") for i in range(16)]
        out = parts[0]
        for part in parts[1:]:
            out = out + part
        return out

    x = [(total(q) / 4.0 + 1.0) * F.lit(K.PI) / 2.0 for q in range(K.N_ANGLES)]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(*x).alias("x_angles"), (F.col("label") >= 5).cast("int").alias("y")
    )


def synthetic(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """One generated flow per event of the table."""
    ids = spread(table(spark, sf_dir, "events").select("event_id"))
    return generate_flows(ids, "event_id", **options)
