"""Column roles, projections and label encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens import constants as K
from wirelens.operators.state import small


@dataclass(frozen=True)
class Roles:
    label: str
    metadata: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)


def detect_roles(df: DataFrame) -> Roles:
    """Column roles from the schema alone; no job runs."""
    names = [f.name.strip() for f in df.schema.fields]
    label = next((c for c in K.LABEL_CANDIDATES if c in names), names[-1])
    known = set(K.METADATA_CANDIDATES)
    metadata = [n for n in names if n in known]
    numeric = (T.NumericType, T.BooleanType)
    features = [
        f.name.strip()
        for f in df.schema.fields
        if f.name.strip() not in known and f.name.strip() != label
        and isinstance(f.dataType, numeric)
    ]
    return Roles(label, metadata, features)


def roles_table(df: DataFrame) -> DataFrame:
    """One row per column: its position, name and role."""
    roles = detect_roles(df)
    rows = []
    for i, name in enumerate(n.strip() for n in df.columns):
        role = (
            "metadata" if name in roles.metadata
            else "label" if name == roles.label
            else "feature" if name in roles.features
            else "ignored"
        )
        rows.append((i, name, role))
    return df.sparkSession.createDataFrame(rows, "position int, column string, role string")


def to_display(df: DataFrame) -> DataFrame:
    return df.toDF(*[K.DISPLAY_BY_COLUMN.get(n, n) for n in df.columns])


def from_display(df: DataFrame) -> DataFrame:
    return df.toDF(*[K.snake(n) for n in df.columns])


def metadata_projection(df: DataFrame, metadata: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in metadata if c in df.columns])


def feature_projection(
    df: DataFrame, features: list[str], keep: list[str] = (), dtype: str = "float"
) -> DataFrame:
    """Fixed order; a column the table lacks is 0.0."""
    return df.select(
        *keep,
        *[
            (F.col(f"`{c}`") if c in df.columns else F.lit(0.0)).cast(dtype).alias(c)
            for c in features
        ],
    )


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if c not in df.columns]


def telemetry_subset(df: DataFrame, fields: list[str] = K.TELEMETRY_FIELDS) -> DataFrame:
    wanted = [c for c in fields if c in df.columns]
    wanted += [K.snake(c) for c in fields if c not in df.columns and K.snake(c) in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def parse_records(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON text holding one object or an array of objects -> one row per object."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    text = F.trim(F.col(column))
    one = F.array(F.from_json(text, schema))
    many = F.from_json(text, T.ArrayType(schema))
    rest = [c for c in df.columns if c != column]
    records = F.when(text.startswith("["), many).otherwise(one)
    # the outer form keeps the text from being parsed a second time for a size filter
    return df.select(*rest, F.explode_outer(records).alias("_record")).where(
        F.col("_record").isNotNull()
    ).select(*rest, "_record.*")


def label_text(column: str) -> Column:
    return F.trim(F.col(f"`{column}`").cast("string"))


def class_dictionary(df: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """State table (idx, name, is_benign): classes in code-point order. A column with more than `most`
    different values is no label column and fails, before its values are gathered."""
    names = df.select(label_text(label).alias("name")).where(F.col("name").isNotNull()).distinct()
    sorted_names = names.limit(most + 1).agg(F.array_sort(F.collect_list("name")).alias("names")).select(
        F.when(F.size("names") <= most, F.col("names")).otherwise(
            F.raise_error(F.lit(f"{label}: more than {most} classes"))).alias("names"))
    benign = F.coalesce(
        *[F.when(F.array_contains("names", n), F.lit(n)) for n in K.BENIGN_NAMES],
        F.get("names", F.lit(0)),
    )
    return sorted_names.select(
        benign.alias("_benign"), F.posexplode("names").alias("idx", "name")
    ).select("idx", "name", (F.col("name") == F.col("_benign")).alias("is_benign"))


def class_names(dictionary: DataFrame) -> list[str]:
    """The fitted classes on the driver: one short string per class."""
    return [r["name"] for r in dictionary.orderBy("idx").select("name").collect()]


def encode_labels(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Adds y_multi, y_binary, is_unseen. Unseen labels count as the benign class."""
    benign = dictionary.where("is_benign").agg(F.min("idx").alias("idx")).scalar()
    known = small(dictionary.select(F.col("name").alias("_name"), F.col("idx").alias("_idx")))
    out = df.withColumn("_text", label_text(label)).join(
        known, F.col("_text") == F.col("_name"), "left"
    )
    return (
        out.withColumn("_benign", benign)
        .withColumn("is_unseen", F.col("_idx").isNull())
        .withColumn("y_multi", F.coalesce("_idx", "_benign").cast("int"))
        .withColumn("y_binary", (F.col("y_multi") != F.col("_benign")).cast("int"))
        .drop("_text", "_name", "_idx", "_benign")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label_text(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = class_counts(df, label)
    everything = Window.partitionBy()  # one row per class
    return counts.select(
        "class", "n",
        (F.sum("n").over(everything) / (F.count("class").over(everything) * F.col("n")))
        .alias("weight"),
    )


def unseen_classes(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    return df.select(label_text(label).alias("name")).distinct().exceptAll(
        dictionary.select("name")
    )


def without_class(df: DataFrame, label: str, held_out: str) -> DataFrame:
    return df.where(~label_text(label).eqNullSafe(F.lit(held_out)))


def only_class(df: DataFrame, label: str, held_out: str) -> DataFrame:
    return df.where(label_text(label) == held_out)


def benign_or_all(df: DataFrame, flag: str = "y_binary") -> DataFrame:
    """Benign rows; all rows where the table has none."""
    has_benign = df.agg(F.coalesce(F.min(flag) == 0, F.lit(False)).alias("b")).scalar()
    return df.where((F.col(flag) == 0) | ~has_benign)
