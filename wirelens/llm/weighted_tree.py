"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child draws -ln(u) / weight, u a hash of key and child; the smallest draw wins. A
changed weight only moves keys into or out of the subtree it belongs to. `topology` adds shards beyond
the regular ones as regions of their own, so that one more shard takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wirelens.workspace import materialize

from .common import let_sql


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, regular: int = 40, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Regions of `racks` x `per_rack` shards up to `regular` shards; each further shard is a region."""
    per_region = racks * per_rack
    tree = [Leaf(i // per_region, i % per_region // per_rack, i) for i in range(min(shards, regular))]
    first = -(-regular // per_region)
    return tree + [Leaf(first + i - regular, 0, i) for i in range(regular, shards)]


def _tree_sql(tree: list[Leaf]) -> str:
    """The tree as a constant: regions of racks of shards, each with name, number and weight."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    if not regions:
        raise ValueError("a tree needs a shard of positive weight")

    def node(name: str, number: int, weight: float, below: list[str]) -> str:
        more = f", 'below', array({', '.join(below)})" if below else ""
        return f"named_struct('name', '{name}', 'number', {number}, 'weight', {weight!r}D{more})"

    def rack(r: int, k: int) -> str:
        shards = regions[r][k]
        return node(f"/{r}/{k}", k, float(sum(shards.values())),
                    [node(f"/{r}/{k}/{s}", s, float(w), []) for s, w in sorted(shards.items())])

    return "array(" + ", ".join(
        node(f"/{r}", r, float(sum(sum(v.values()) for v in racks.values())), [rack(r, k) for k in sorted(racks)])
        for r, racks in sorted(regions.items())) + ")"


def _draw_sql(key: str, children: str, result: str) -> str:
    """The field `result` of the child with the smallest draw; equal draws go to the lower number."""
    unit = f"(cast(conv(substr(md5(concat({key}, c.name)), 1, 13), 16, 10) AS double) + 0.5D) / 4503599627370496D"
    return f"array_min(transform({children}, c -> struct(-ln({unit}) / c.weight AS draw, c.number AS number, c AS c))).c.{result}"


def shard_sql(key: str, tree: list[Leaf]) -> str:
    """SQL for the shard of a text key: weighted draws at three levels. Weights of 0 get nothing."""
    rack = let_sql("racks", _draw_sql(key, _tree_sql(tree), "below"), _draw_sql(key, "racks", "below"))
    return let_sql("shards", rack, _draw_sql(key, "shards", "number"))


def key_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
           rows_per_task: int = 200_000) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard.

    The key alone decides shard and grown_shard (of one more shard); a null key counts as the empty
    text; repeated keys share a shard. Size is the text's UTF-8 bytes plus 16 (null text: 16, with the
    crc32 of the empty text; very long texts are read whole). Slots number a shard's rows without a gap in the order of
    the key's hash, then key, size and crc32. They are counted in two steps: rows per shard and hash prefix,
    whose length follows from the row count, then within each prefix, so no task holds a whole shard. The rows of a
    key that has more than `rows_per_task` of them (or no key at all) come behind the others of its prefix, numbered
    task by task. An empty table gives no rows; other columns are ignored.
    """
    key = key_text(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias(id_col), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"), F.md5(key.cast("binary")).alias("_hash"),
    )
    placed = sized.selectExpr(
        "*", f"cast({shard_sql('_key', topology(shards))} AS int) AS shard",
        f"cast({shard_sql('_key', topology(shards + 1))} AS int) AS grown_shard",
    )
    placed = materialize(placed.drop("_key").withColumn("_task", F.spark_partition_id()), "placed")
    digits, room = 1, 16 * shards * rows_per_task
    total = placed.count()
    while room < total:
        digits, room = digits + 1, room * 16
    # few keys by arithmetic: each holds more than a task's rows, and more than a ten thousandth of all
    hot = placed.groupBy("_hash").count().where(F.col("count") > max(rows_per_task, total // 10_000)).select("_hash", F.lit(True).alias("_hot"))
    placed = placed.join(F.broadcast(materialize(hot, "hot_keys")), "_hash", "left")
    behind = F.when(F.col("_hot"), F.col("_task") + 1).otherwise(0)
    placed = placed.withColumn("_part", F.struct(F.substring("_hash", 1, digits).alias("prefix"), behind.alias("behind")))
    groups = placed.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy("_hash", id_col, "size", "text_crc32")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_part"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
        "grown_shard",
    )
