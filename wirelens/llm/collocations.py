"""Phrase collocation mining by dynamic itemset counting.

The corpus is dealt to shards that are scanned in a cycle. Words are counted from the first scan on. A longer
phrase becomes active at the first scan by whose start both its shorter ends (all words but the last, all but the
first) have reached the threshold, is counted in every scan of the cycle that follows, and is complete after it.
Scans interleave phrases of all lengths, and the mining ends when every active phrase has completed its cycle.

A word pair is also counted only if its slot in a hash table of all pairs, summed up beforehand, can reach the
threshold; most pairs of a corpus are rare, and this keeps them out of every shuffle.

Tasks know activity from one table of fixed size per phrase length: the scan at which any phrase of a hash slot
reached the threshold. Phrases that share a slot may activate others early, which costs counting but changes no
result: counts are kept by a 128-bit key of language and words and compared with the threshold at the end. Counted
phrases carry the keys of their two shorter ends, words also their text, and the texts of the few phrases that
reach the threshold are spelled from them, length by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wirelens.workspace import materialize, scratch_path

from . import slot_counts
from .common import bitmap, bitmaps, in_bitmap, lookup, slices, text_of

PIECE = 4 << 20
NEVER = 255
#: What bytes are: part of a word, blank, or the end of a piece.
_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    least: int = 100  # occurrences of a candidate
    longest: int = 5  # words
    cover: int = 100  # a candidate goes if a longer one has this percentage of its occurrences
    top: int = 2000  # reported phrases per language
    shards: int = 3
    slot_bits: int = 23  # of the activity table per phrase length
    pair_bits: tuple[int, int] = (20, 28)  # least and most of the table of pairs; about 8 words a slot between them
    room: int = 1_000_000  # distinct phrases that a task counts before it passes them on


#: Two 64-bit numbers per place in a word and byte; the hash of a word is their sum (tabulation hashing).
_TABLES = [np.array([xxhash.xxh3_64_intdigest(i.to_bytes(2, "little"), seed=seed) for i in range(1 << 14)], np.uint64) for seed in (2, 3)]
_STEP_A, _STEP_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a block of texts (`flat`), their language and piece, and the keys of phrases."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
        raw = _LOWER[np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]]
        at = at - at[0]
        kind = _KIND[raw]
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[at[:-1]] = True
        word = kind == _WORD
        start = word & fresh[:-1]
        start[1:] |= word[1:] & ~word[:-1]
        start = np.flatnonzero(start)
        end = word & fresh[1:]
        end[:-1] |= word[:-1] & ~word[1:]
        if len(word):
            end[-1] |= word[-1]
        end = np.flatnonzero(end) + 1
        breaks = np.flatnonzero((kind == _BREAK) | fresh[:-1])
        self.piece = np.searchsorted(breaks, start, "right")
        size = end - start
        offsets = np.append(0, np.cumsum(size))
        data = raw[word]
        self.flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy()[np.searchsorted(at, start, "right") - 1]
        of_lang = b"".join(xxhash.xxh3_128_digest(x or "", seed=1) for x in self.langs.to_pylist())
        of_lang = np.frombuffer(of_lang, np.uint64).reshape(-1, 2)
        self.lang_hashes = [of_lang[self.lang, i] for i in (0, 1)]
        place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), size)
        cell = ((place & 63) << 8) + data
        self.hashes = []
        for table in _TABLES:
            values = table[cell]
            if len(place) and place.max() > 63:  # very long words use the table again, times an odd number
                values = values * (2 * (place >> 6) + 1).astype(np.uint64)
            self.hashes.append(np.add.reduceat(values, offsets[:-1]) if len(start) else values)

    def keys(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length from 1, two 64-bit halves of the key of the phrase at every word (as long as the words go on)."""
        found, a, b = [], *self.lang_hashes
        for length in range(1, longest + 1):
            n = max(0, len(self.flat) - length + 1)
            a = _scrambled(a[:n] * _STEP_A + self.hashes[0][length - 1:length - 1 + n])
            b = _scrambled(b[:n] * _STEP_B + self.hashes[1][length - 1:length - 1 + n])
            found.append((a, b))
        return found

    def inside(self, length: int) -> np.ndarray:
        """Where phrases of a length begin that stay within a piece."""
        if length > len(self.piece):
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:len(self.piece) - length + 1] == self.piece[length - 1:])

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        parts = [self.flat.take(pa.array(at + k)) for k in range(length)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]


def _scrambled(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Activity:
    """What a task knows of a scan: per length the scan at which a slot reached the threshold, and the slots of pairs that
    may reach it (packed bits)."""

    scan: int
    stamps: list[np.ndarray | None]
    pairs: np.ndarray
    pair_bits: int


def active(block: Words, keys: list[tuple[np.ndarray, np.ndarray]], length: int, known: Activity, s: Settings
           ) -> tuple[np.ndarray, np.ndarray]:
    """(first words, births) of the phrases of a length that this scan counts."""
    scan, stamps = known.scan, known.stamps
    if length == 1:
        return np.arange(len(block.flat) if scan < s.shards else 0), np.zeros(len(block.flat), np.int32)
    reached = stamps[length - 2]
    if reached is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    at = block.inside(length)
    if length == 2:
        at = at[in_bitmap(known.pairs, keys[1][0][at], known.pair_bits)]
    ends = reached[_slots(keys[length - 2][0], s.slot_bits)]
    born = np.maximum(ends[at], ends[at + 1]).astype(np.int32)
    use = (born <= scan) & (scan < born + s.shards)
    return at[use], born[use]


_IDENTITY = ["a", "b", "kind", "head", "tail", "lang", "word"]
_COUNTED = "a long, b long, kind int, head long, tail long, lang string, word string, n long"


class _Sums:
    """Counts of phrases by key, merged until `room` is full: rows of _COUNTED with kind = birth * 8 + length. Words come
    with their language and text, longer phrases with the keys of their ends."""

    def __init__(self, room: int, words: bool):
        self.room, self.words, self.held, self.size = room, words, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, kind: np.ndarray, head, tail) -> Iterator[pa.RecordBatch]:
        """`head` and `tail` are keys, for words Arrow arrays of languages and texts."""
        _, at, n = np.unique(a, return_index=True, return_counts=True)
        ends = [x.take(pa.array(at)) if self.words else x[at] for x in (head, tail)]
        self.held.append((a[at], b[at], kind[at], *ends, n))
        self.size += len(at)
        if self.size > self.room:
            self.merge()
            if 2 * self.size > self.room:
                yield from self.flush()

    def merge(self) -> None:
        a, b, kind, head, tail, n = zip(*self.held, strict=True)
        a, b, kind, n = (np.concatenate(c) for c in (a, b, kind, n))
        _, at, of = np.unique(a, return_index=True, return_inverse=True)
        if self.words:
            ends = [pa.chunked_array(x).combine_chunks().take(pa.array(at)) for x in (head, tail)]
        else:
            ends = [np.concatenate(x)[at] for x in (head, tail)]
        self.held = [(a[at], b[at], kind[at], *ends, np.bincount(of, weights=n).astype(np.int64))]
        self.size = len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            a, b, kind, head, tail, n = self.held[0]
            none, zero = pa.nulls(len(a), pa.string()), pa.array(np.zeros(len(a), np.int64))
            if self.words:
                ends = [zero, zero, head.cast(pa.string()), tail.cast(pa.string())]
            else:
                ends = [pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)), none, none]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(kind), *ends, pa.array(n)],
                names=[c.split()[0] for c in _COUNTED.split(", ")])
        self.held, self.size = [], 0


def likely_pairs(texts: DataFrame, bits: int, s: Settings) -> np.ndarray:
    """Packed bits of the slots whose pairs occur `least` times or more together."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        block = Words(batch.column(0), batch.column(1))
        return block.keys(2)[1][0][block.inside(2)]

    return slot_counts.likely(texts, keys, bits, s.least, s.room, PIECE)


def _promising(counts: DataFrame, s: Settings) -> DataFrame:
    """The rows of counted phrases that may have `least` occurrences in their cycle: in one of its scans such a phrase has
    at least `least` / `shards`. Most rows fall away before they are shuffled."""
    some = counts.where(F.col("n") >= -(-s.least // s.shards)).select(F.col("a").alias("key"))
    known = counts.sparkSession.sparkContext.broadcast(bitmap(some, s.slot_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(known.value, keys, s.slot_bits)))

    return counts.mapInArrow(run, counts.schema)


def _slots_reached(counts: DataFrame, s: Settings) -> list[np.ndarray | None]:
    """Per length below the longest, a table that marks the slots of phrases that have reached the threshold.

    The bitmaps come in pieces of 4 KB: at most 2 ** slot_bits / 8 bytes a length, whatever the counts hold."""
    reached = _promising(counts.select("a", "b", "kind", "n"), s).groupBy("a", "b", "kind").agg(F.sum("n").alias("n"))
    reached = reached.where(F.col("n") >= s.least).select((F.col("kind") % 8).alias("of"), F.col("a").alias("key"))
    marked = bitmaps(reached, s.slot_bits)
    return [np.unpackbits(marked[size], bitorder="little").astype(bool) if size in marked else None for size in range(1, s.longest)]


def phrase_counts(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text"
                  ) -> tuple[DataFrame, DataFrame]:
    """(rows (len, lang, phrase, a) of all phrases with at least `least` occurrences, rows (lang, n) of all words)."""
    s, spark = settings, docs.sparkSession
    path = scratch_path(spark, "shards")
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(s.shards)).cast("int").alias("shard")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    seen = Observation()
    docs.select(lang, text_of(text_col).alias("text"), shard).observe(
        seen, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).write.partitionBy("shard").parquet(path)
    bits = int(np.clip(np.ceil(np.log2(seen.get["bytes"] / 48 + 1)), *s.pair_bits))  # 6 bytes a word, 8 words a slot
    shards = spark.read.schema("lang string, text string, shard int").parquet(path)
    stamps = [np.full(1 << s.slot_bits, NEVER, np.uint8) for _ in range(s.longest - 1)]
    scans: list[DataFrame] = []
    pairs = likely_pairs(shards.select("lang", "text"), bits, s)
    while True:
        scan = len(scans)
        if scan >= NEVER:
            raise RuntimeError("more scans than cycles of all lengths take")  # longest * shards of them suffice
        known = spark.sparkContext.broadcast(Activity(scan, [x if (x < NEVER).any() else None for x in stamps], pairs, bits))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            words, phrases = _Sums(s.room, True), _Sums(s.room, False)
            for batch in slices(batches, 1, PIECE):
                block = Words(batch.column(0), batch.column(1))
                keys = block.keys(s.longest)
                for length in range(1, s.longest + 1):
                    at, births = active(block, keys, length, known.value, s)
                    if not len(at):
                        continue
                    own = [k[at] for k in keys[length - 1]] + [births * 8 + length]
                    if length == 1:
                        yield from words.add(*own, block.langs.take(pa.array(block.lang)), block.flat)
                    else:
                        ends = keys[length - 2][0]
                        yield from phrases.add(*own, ends[at], ends[at + 1])
            yield from words.flush()
            yield from phrases.flush()

        found = shards.where(F.col("shard") == scan % s.shards).select("lang", "text").mapInArrow(run, _COUNTED)
        scans.append(materialize(found.groupBy(*_IDENTITY).agg(F.sum("n").alias("n")), "scan"))
        known.destroy()
        # phrases whose cycle is not over before this scan; the others were compared when they completed
        recent = _union(scans[-s.shards:]).where(F.col("kind") >= 8 * (scan - s.shards + 1))
        for stamp, marked in zip(stamps, _slots_reached(recent, s), strict=True):
            if marked is not None:
                stamp[marked & (stamp == NEVER)] = scan + 1
        last = max((int(x[x < NEVER].max(initial=0)) for x in stamps), default=0)
        if scan + 1 >= s.shards and last <= scan + 1 - s.shards:
            break
    whole = _union(scans)
    totals = whole.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = _promising(whole, s).groupBy(*_IDENTITY).agg(F.sum("n").alias("n")).where(F.col("n") >= s.least)
    counts = materialize(counts.withColumn("len", F.col("kind") % 8), "counts")
    return materialize(_spelled(counts, s), "phrases"), materialize(totals, "totals")


def _spelled(counts: DataFrame, s: Settings) -> DataFrame:
    """Counted phrases -> (len, lang, phrase, a): a phrase is its head and the last word of its tail. Every end of a
    phrase with `least` occurrences has as many and is among the counts."""
    shorter = counts.where("len = 1").select("a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n")
    found = [shorter.select(F.lit(1).alias("len"), "lang", "phrase", F.col("n").alias("a"))]
    for length in range(2, s.longest + 1):
        own = counts.where(F.col("len") == length).select("a", "head", "tail", "n")
        for end, columns in (("head", ["lang", "phrase"]), ("tail", ["last"])):
            asked = own.groupBy(end).agg(F.count("*").alias("asked"))
            ends = shorter.select(F.col("a").alias(end), *columns).join(asked, end)
            own = lookup(own, materialize(ends, "ends"), end, "asked").select(*own.columns, *[f"found.{c}" for c in columns])
        shorter = materialize(own.select("a", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n"), "spelled")
        found.append(shorter.select(F.lit(length).alias("len"), "lang", "phrase", F.col("n").alias("a")))
    return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


#: A single word may be an end of very many phrases; its row is repeated for this many salts.
_SALTS = 16


def _ends(counts: DataFrame, part: str, value: str) -> DataFrame:
    salts = F.when(F.col("len") == 1, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(value), F.explode(salts).alias(f"{part}_salt"))


def _salt(words: Column) -> Column:
    return F.when(words == 1, F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int")).otherwise(0)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (len, lang, phrase, a, n) with their lowest-scoring cut: score, l, r. Products are decimals of
    38 digits, so scores are exact while 1000 * a and n stay below 10 ** 19."""
    cut = counts.where("len >= 2").withColumn("words", F.split("phrase", " ", -1)).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cut = cut.select(
        "len", "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("rest"),
        _salt(F.col("k")).alias("head_salt"), _salt(F.col("len") - F.col("k")).alias("rest_salt"))
    met = (
        cut.join(_ends(counts, "head", "l"), ["lang", "head", "head_salt"])
        .join(_ends(counts, "rest", "r"), ["lang", "rest", "rest_salt"]).join(totals, "lang")
    )
    score = F.expr("(cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(18, 0))) div "
                   "(cast(l AS decimal(19, 0)) * cast(r AS decimal(18, 0)))")
    best = met.groupBy("len", "lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("len", "lang", "phrase", "a", "n", "best.score", "best.l", "best.r")


def covered(counts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, longer): the occurrences of the most frequent longer candidate around a phrase."""
    parts = F.expr("""flatten(transform(sequence(2, len - 1), size -> transform(sequence(1, len - size + 1),
        first -> array_join(slice(words, first, size), ' '))))""")
    inner = counts.where("len >= 3").withColumn("words", F.split("phrase", " ", -1))
    return inner.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first `top` phrases of every language by score, then occurrences, then phrase: lang, rank, phrase, a, l, r, n, score.

    Null languages are `und`, null texts empty; repeated rows count each; ties of score and occurrences go by the
    bytes of the phrase; a table without candidates gives no rows; other columns are ignored. Texts of any length
    are counted whole, one Arrow batch or one text at a time.
    """
    counts, totals = phrase_counts(docs, settings, lang_col, text_col)
    judged = scored(counts, totals).join(covered(counts), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < settings.cover * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most phrases: the best of 64 parts first
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = judged.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= settings.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.where(F.col("rank") <= settings.top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
