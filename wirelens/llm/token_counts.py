"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the token counts of frequent pre-tokens, at most `table_size` entries
chosen by their occurrences in all texts. What it lacks is encoded by the library, batch by batch, into a cache
of the worker. Only the tasks' summaries of frequent pre-tokens are shuffled, and they have no bearing on the counts.

A pre-token here is a run of blanks with the word that follows it. Byte-level patterns never join
a character that is no blank to a blank behind it, so a text's count is the sum over its pre-tokens. Texts
with other white space (no-break spaces, separators) are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PIECES = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _lengths(path: str, texts: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


class WorkerCache(dict):
    """Counts of pre-tokens already encoded by this worker; emptied when it holds `room` entries. Pre-tokens of more than
    `longest` characters (texts without blanks are one) are encoded each time they occur, so the cache is bounded."""

    room = 400_000
    longest = 64


_CACHES: dict[str, WorkerCache] = {}


def count_batch(texts: list[str], frequent: dict[str, int], path: str) -> list[int]:
    """The token counts of texts, in order."""
    cache = _CACHES.setdefault(path, WorkerCache())
    split = [None if OTHER_BLANKS.search(t) else PIECES.findall(t) for t in texts]
    missing = set().union(*(p for p in split if p)) - frequent.keys() - cache.keys()
    long = [p for p in missing if len(p) > cache.longest]
    missing.difference_update(long)
    if len(cache) + len(missing) > cache.room:
        cache.clear()
        missing = {p for p in set().union(*(p for p in split if p)) - frequent.keys() if len(p) <= cache.longest}
    asked = list(missing)
    cache.update(zip(asked, _lengths(path, asked), strict=True))
    once = dict(zip(long, _lengths(path, long), strict=True))
    whole = iter(_lengths(path, [t for t, p in zip(texts, split, strict=True) if p is None]))

    def of(piece: str) -> int:
        n = known(piece)
        if n is None:
            n = cache.get(piece)
        return once[piece] if n is None else n

    known = frequent.get
    return [next(whole) if p is None else sum(map(of, p)) for p in split]


def frequent_pieces(docs: DataFrame, text_col: str, path: str, table_size: int = 65_536, longest: int = 32) -> dict[str, int]:
    """Token counts of the `table_size` most frequent pre-tokens of all texts, the first tier of the lookup.

    Every task keeps a summary of bounded size: when it holds four times the table, rare pre-tokens are
    let go (every count is lowered by the one that the table's last entry has). What a pre-token loses
    by this is at most its task's share of 1 / (3 * table_size); counts of tokens do not depend on it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in slices(batches, 0, 2 << 20):
            for text in batch.column(0).to_pylist():
                if not OTHER_BLANKS.search(text):
                    found.update(PIECES.findall(text))
            if len(found) > 4 * table_size:
                low = sorted(found.values(), reverse=True)[table_size]
                found = Counter({p: n - low for p, n in found.items() if n > low})
        best = [(p, n) for p, n in found.most_common(table_size) if n > 1 and len(p) <= longest]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in best], pa.string()),
                                          "n": pa.array([n for _, n in best], pa.int64())})

    counted = docs.select(text.alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "piece").limit(table_size).collect()
    pieces = [r.piece for r in rows]
    return dict(zip(pieces, _lengths(path, pieces), strict=True))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, table_size: int = 65_536) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `path` is a byte-level tokenizer file, present on every worker. Null and empty texts count 0;
    repeated rows and equal texts are counted alike; very long texts are taken whole; an empty table
    gives no rows; other columns are ignored. Special tokens written inside a text count as the library's
    default has it. No shuffle but that of the tasks'
    summaries of frequent pre-tokens.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, text_col, path, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in slices(batches):
            texts = batch.column(1)
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(count_batch(texts.to_pylist(), table, path), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens, pa.compute.greater(n_tokens, limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
