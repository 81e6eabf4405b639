"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.workspace import materialize

#: The separators of words, as a class body for Java, RE2 and Python patterns.
BLANKS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, UPPER.lower())


def let_sql(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` in `body`: an expression that a lambda refers to
    would otherwise be evaluated for every element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece take about `limit` bytes (one row at least)."""
    for batch in batches:
        texts, start, n = batch.column(column), 0, batch.num_rows
        if not n:
            continue
        if texts.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        size = 0
        for i, more in enumerate(sizes):
            if size and size + more > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(more)
        yield batch.slice(start)


def bitmaps(rows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Rows (of, key) -> per value of `of` 2 ** bits packed bits, set at the first bits of the keys. The driver gets pieces
    of 4 KB, 2 ** bits / 8 bytes a value at most."""
    slot = F.expr(f"shiftrightunsigned(key, {64 - bits}) + 1")  # numbers from 1 fill the buckets from 1
    found = rows.select("of", slot.alias("slot")).groupBy("of", F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        held = out.setdefault(r.of, np.zeros(max(4096, 1 << (bits - 3)), np.uint8))
        held[4096 * (r.bucket - 1):4096 * r.bucket] = np.frombuffer(bytes(r.bits), np.uint8)
    return {of: held[:max(1, 1 << bits - 3)] for of, held in out.items()}


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Rows (key) -> 2 ** bits packed bits, see `bitmaps`."""
    return bitmaps(rows.select(F.lit(0).alias("of"), "key"), bits).get(0, np.zeros(1 << (bits - 3), np.uint8))


def in_bitmap(packed: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of unsigned keys are set."""
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, most: int = 10_000, spread: list[str] | None = None
           ) -> DataFrame:
    """Left join with a written table of one row per key: the left columns and `found`, a struct of the right ones.

    `weight` counts, per key, the left rows that hold it (or a share of them alike for all). Keys with more than
    1 / most of the sum are fewer than `most`, so they are broadcast; the others are joined by key, where rows
    that need no more lookup get keys of their own, from a hash of `spread` (all left columns if None).
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).head()[0]
    fields = F.struct(*[c for c in right.columns if c != key])
    hot = right.where(F.col(weight) * most > total).select(F.col(key), fields.alias("hot_"))
    cold = right.where(F.col(weight) * most <= total).select(F.col(key).alias("key_"), F.lit(True).alias("cold_key_"), fields.alias("cold_"))
    kind = left.schema[key].dataType
    own = F.xxhash64(*(spread or left.columns)).cast(kind)
    asked = left.join(F.broadcast(hot), key, "left").withColumn("cold_key_", F.col("hot_").isNull() & F.col(key).isNotNull())
    asked = asked.withColumn("key_", F.when(F.col("cold_key_"), F.col(key)).otherwise(own))
    return asked.join(cold, ["key_", "cold_key_"], "left").select(*left.columns, F.coalesce("hot_", "cold_").alias("found"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Every round gives each tree the smallest root seen across its edges, then follows roots of roots.
    Messages are combined before they are shuffled and joins may be split by adaptive execution, so
    a node with very many edges is no single task. Each round is written to the shared folder.
    Rows with a null end are left out; an empty table gives no rows.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    pairs = materialize(pairs.distinct(), "edges")
    roots = (
        pairs.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    )
    roots = materialize(roots, "roots")
    for _ in range(rounds):
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = pairs.join(left, "a").join(right, "b").where("ra <> rb").select(
            F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("lower")
        )
        across = materialize(across.distinct(), "across")
        if not across.head(1):
            return roots
        # every root takes the smallest root beside it, then chains of roots are followed
        hop = across.groupBy("root").agg(F.min("lower").alias("lower"))
        hop = _follow(materialize(hop, "hops"))
        roots = materialize(
            roots.join(hop, "root", "left")
            .select("node", F.coalesce("lower", "root").alias("root")), "roots",
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _follow(hop: DataFrame) -> DataFrame:
    """Rows (root, lower) with lower < root: replace lower by the end of its chain."""
    while True:
        far = hop.select(F.col("root").alias("lower"), F.col("lower").alias("far"))
        if not hop.join(far, "lower", "left_semi").head(1):
            return hop
        hop = materialize(
            hop.join(far, "lower", "left").select("root", F.coalesce("far", "lower").alias("lower")), "hops"
        )
