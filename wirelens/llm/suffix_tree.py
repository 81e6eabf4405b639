"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are the last one to `depth` words (the start of a text counts as one). Every context with at least
`least_context` occurrences, a number that does not change with the corpus, is a candidate; it is retained if
its next-word distribution differs from that of its suffix (divergence test) or a longer retained context ends
in it. Next words seen `least_next` times or more behind a candidate are explicit; absolute discounting gives the rest of
the mass to the suffix, down to the smoothed word distribution. A word is scored in the longest retained suffix
of its history. As every suffix of a retained context is retained, its score is a sum: the word alone, what every
retained suffix leaves to a shorter one, and what is gained in each where the word is explicit.

Pairs and triples of words are counted in tables of slots first, so that the many rare ones are never shuffled.
Words, contexts and next words are Spark tables, keyed by 64-bit hashes of their words (two of them collide
with a chance of about n * n / 2 ** 65; word counts are kept by the word itself). Tasks hold the most frequent
states, up to a fixed number, and bitmaps of fixed size that say which others may exist. What these decide is added
up in place; every other part of the sum is one lookup by its key, and only those found are added up per text. A lookup
outside the shared states asks for a rare key, so no key of that join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.workspace import materialize

from . import slot_counts
from .common import bitmap, in_bitmap, lookup, slices

END = "\n"  # the token behind a text's last word; no word holds a line end
START = "\r"  # the context in front of a text's first word
PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    depth: int = 3  # words in the longest context
    least_context: int = 20  # occurrences of a context that may be retained
    least_next: int = 8  # occurrences of a next word that is held explicitly
    least_divergence: float = 0.02  # nats
    discount: float = 0.5
    added: float = 0.1  # to every word count
    bits: int = 26  # of a bitmap: 8 MB
    slot_bits: tuple[int, int] = (20, 26)  # least and most of the tables of pairs and triples, else one slot a token
    shared_words: int = 1 << 19
    shared_contexts: int = 1 << 19
    shared_next: int = 1 << 20
    room: int = 200_000  # distinct keys that a task counts before it passes them on


# ---- hashes -----------------------------------------------------------------------------------------

#: A 64-bit number per place in a word and byte; the key of a word is their sum (tabulation hashing).
_TABLE = np.array([xxhash.xxh3_64_intdigest(i.to_bytes(2, "little"), seed=5) for i in range(1 << 14)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one 8-byte number, by its public definition."""
    h = seed + _P5 + np.uint64(8)
    h = _turn(h ^ (_turn(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def chained(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a word behind a context: Spark's xxhash64(context, word)."""
    return _hash_long(word, _hash_long(left, np.full(1, _SEED, np.uint64)))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The keys of words that stand one behind the other in a buffer of bytes; none is empty."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
    values = _TABLE[((place & 63) << 8) + data]
    if place.max(initial=0) > 63:  # very long words use the table again, times an odd number
        values = values * (2 * (place >> 6) + 1).astype(np.uint64)
    return np.add.reduceat(values, offsets[:-1])


def word_key(word: str) -> int:
    """The key of one word as Spark's signed number."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_keys(data, np.array([0, len(data)])).view(np.int64)[0])


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their number at every token, first token of every text): lower-cased words, then END."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    offsets = split.offsets.to_numpy()
    starts = before[offsets - offsets[0]]  # in words
    coded = flat.filter(pa.array(some)).dictionary_encode()
    n = len(texts)
    codes = np.empty(int(starts[-1]) + n, np.int64)
    ends = starts[1:] + np.arange(n)
    word = np.ones(len(codes), bool)
    word[ends] = False
    codes[word] = coded.indices.to_numpy()
    codes[ends] = len(coded.dictionary)
    return pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)]), codes, np.append(0, ends[:-1] + 1)[:n]


@dataclass
class Block:
    """Keys of a block of tokens, words and the end of every text: `word`, and per context length (from 1) `context` and
    `following` = context + word. A context of k words exists from the k-th token of a text on (`place` counts from 0, the
    start is a word)."""

    first: np.ndarray
    place: np.ndarray
    word: np.ndarray
    context: list[np.ndarray]
    following: list[np.ndarray]


def block(texts: pa.Array, depth: int) -> Block:
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    raw = _LOWER[np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]]
    at = at - at[0]
    inside = ~_BLANK[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    start, end = inside & fresh[:-1], inside & fresh[1:]
    start[1:] |= inside[1:] & ~inside[:-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    keys = word_keys(raw[inside], np.append(0, np.cumsum(end - start)))
    before = np.searchsorted(start, at)  # words in front of every text
    n = len(texts)
    ends = before[1:] + np.arange(n)
    word = np.full(len(keys) + n, np.uint64(word_key(END) % (1 << 64)))
    real = np.ones(len(word), bool)
    real[ends] = False
    word[real] = keys
    first = before[:-1] + np.arange(n)
    place = np.arange(len(word)) - np.repeat(first, ends - first + 1)
    context, following = [], []
    last = word
    for k in range(depth):
        here = np.empty_like(word)
        here[1:] = last[:-1]
        if k == 0:
            here[first] = np.uint64(word_key(START) % (1 << 64))
        context.append(here)
        last = chained(here, word)
        following.append(last)
    return Block(first, place, word, context, following)


# ---- counts -----------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, key, n): every token of every text of the one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 4 * PIECE):
            distinct, codes, _ = tokens(batch.column(0))
            n = np.bincount(codes, minlength=len(distinct))
            words = distinct.cast(pa.large_binary())
            at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
            data = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]]
            yield pa.RecordBatch.from_arrays(
                [distinct.cast(pa.string()), pa.array(word_keys(data, at - at[0]).view(np.int64)), pa.array(n)], names=["word", "key", "n"])

    return texts.mapInArrow(run, "word string, key long, n long").where("n > 0").groupBy("word", "key").agg(F.sum("n").alias("n"))


class _Sums:
    """Counts of pairs (context, word), merged by their key until `room` is full."""

    def __init__(self, room: int):
        self.room, self.held, self.size = room, [], 0

    def add(self, key: np.ndarray, context: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, at, n = np.unique(key, return_index=True, return_counts=True)
        self.held.append((key, context[at], word[at], n))
        self.size += len(key)
        if self.size > self.room:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            key, context, word, n = (np.concatenate(c) for c in zip(*self.held, strict=True))
            _, at, of = np.unique(key, return_index=True, return_inverse=True)
            sums = np.bincount(of, weights=n).astype(np.int64)
            context, word = context[at], word[at]
            order = np.argsort(context)  # equal contexts together compress better in the shuffle
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[order].view(np.int64)), pa.array(word[order].view(np.int64)), pa.array(sums[order])],
                names=["ctx", "word", "n"])
        self.held, self.size = [], 0


def next_counts(texts: DataFrame, length: int, contexts: np.ndarray, explicit: np.ndarray, slot_bits: int, s: Settings) -> DataFrame:
    """Rows (ctx, word, n >= least_next) behind contexts of this length; the bitmaps hold the candidate contexts
    and what is explicit one word shorter (nothing else can be explicit here)."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast((contexts, explicit))

    def candidates(batch: pa.RecordBatch) -> tuple[Block, np.ndarray]:
        contexts, explicit = known.value
        b = block(batch.column(0), length)
        shorter = b.following[length - 2] if length > 1 else b.word
        at = np.flatnonzero(b.place >= length - 1)
        at = at[in_bitmap(contexts, b.context[length - 1][at], s.bits)]
        return b, at[in_bitmap(explicit, shorter[at], s.bits)]

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        b, at = candidates(batch)
        return b.following[length - 1][at]

    frequent = None
    if length < 3:  # longer ones are few
        frequent = spark.sparkContext.broadcast(slot_counts.likely(texts, keys, slot_bits, s.least_next, s.room, PIECE, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(s.room)
        for batch in slices(batches, 0, PIECE):
            b, at = candidates(batch)
            if frequent is not None:
                at = at[in_bitmap(frequent.value, b.following[length - 1][at], slot_bits)]
            yield from sums.add(b.following[length - 1][at], b.context[length - 1][at], b.word[at])
            pa.default_memory_pool().release_unused()
        yield from sums.flush()

    counted = texts.mapInArrow(run, "ctx long, word long, n long")
    return counted.groupBy("ctx", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_next)


# ---- the tree ---------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Tables words (word, key, n), contexts (key, n, suffix, length, log_rest), following (key, n, ctx, word, log_p) and gains
    (key, n, gain): of the next words of retained contexts, log_p above what the context leaves to its suffix for them."""

    settings: Settings
    total: int
    distinct: int
    words: DataFrame
    contexts: DataFrame
    following: DataFrame
    gains: DataFrame

    @property
    def denominator(self) -> float:
        return self.total + self.settings.added * (self.distinct + 1)

    @property
    def unseen(self) -> float:
        return float(np.log10(self.settings.added / self.denominator))


def _diverging(rows: DataFrame, s: Settings) -> DataFrame:
    """Of fitted rows (ctx, n, n_ctx, parent): the contexts whose next words differ from those of their suffix."""
    share = F.col("n") / F.col("n_ctx")
    sums = rows.groupBy("ctx", "n_ctx").agg(
        F.count("*").alias("entries"), F.sum(share).alias("mass"), F.sum("parent").alias("parents"),
        F.sum(share * F.ln(share / F.col("parent"))).alias("gain"))
    rest = F.greatest(1 - F.col("mass"), F.lit(1e-12))
    gain = F.col("gain") + rest * F.ln(rest / F.greatest(1 - F.col("parents"), F.lit(1e-12)))
    # likelihood ratio beyond its mean plus three deviations under "no difference"
    return sums.withColumn("gain", gain).where(
        (F.col("gain") >= s.least_divergence)
        & (2 * F.col("n_ctx") * F.col("gain") >= F.col("entries") + 3 * F.sqrt(2 * F.col("entries")))).select("ctx")


def fit(texts: DataFrame, settings: Settings = Settings()) -> Tree:
    """The tree of a table with one text column. One pass counts words, one more each length of contexts."""
    s = settings
    words = materialize(word_counts(texts), "words")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"),
                      F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("texts")).head()
    tree = Tree(s, whole.total, whole.distinct, words, words, words, words)
    # probabilities one word shorter, by key; first those of words alone
    shorter = words.where(F.col("n") >= s.least_next).select("key", "n", ((F.col("n") + s.added) / tree.denominator).alias("p"))
    candidates = words.where((F.col("n") >= s.least_context) & (F.col("word") != END)).select(
        F.col("key").alias("ctx"), F.lit(0).cast("long").alias("suffix"), F.col("n").alias("n_ctx"))
    if whole.texts >= s.least_context:
        start = texts.sparkSession.createDataFrame([(word_key(START), 0, whole.texts)], "ctx long, suffix long, n_ctx long")
        candidates = candidates.unionByName(start)
    contexts, fitted, diverging = [], [], []
    slot_bits = int(np.clip(np.ceil(np.log2(tree.total + 1)), *s.slot_bits))
    for length in range(1, s.depth + 1):
        seen = bitmap(candidates.select(F.col("ctx").alias("key")), s.bits)
        explicit = bitmap(shorter.select("key"), s.bits)
        raw = materialize(next_counts(texts, length, seen, explicit, slot_bits, s), f"next-{length}")
        sums = raw.groupBy("ctx").agg(F.count("*").alias("entries"), F.sum("n").alias("explicit"))
        left = 1 - (F.col("explicit") - s.discount * F.col("entries")) / F.col("n_ctx")
        info = materialize(candidates.join(sums, "ctx").withColumn("rest", F.greatest(left, F.lit(1e-12))), f"contexts-{length}")
        rows = lookup(raw, info, "ctx", "entries").select("ctx", "word", "n", "found.*").where("n_ctx IS NOT NULL")
        below = F.col("word") if length == 1 else F.xxhash64("suffix", "word")
        rows = rows.withColumn("below", below).join(
            shorter.select(F.col("key").alias("below"), F.col("p").alias("parent")), "below")
        p = (F.col("n") - s.discount) / F.col("n_ctx") + F.col("rest") * F.col("parent")
        gain = F.log10(p) - F.log10("rest") - F.log10("parent")
        rows = materialize(rows.select(
            F.xxhash64("ctx", "word").alias("key"), "ctx", "word", "n", "n_ctx", "below", "parent", p.alias("p"), gain.alias("gain")),
            f"fitted-{length}")
        contexts.append(info)
        fitted.append(rows)
        diverging.append(materialize(_diverging(rows, s), f"diverging-{length}"))
        shorter = rows.select("key", "n", "p")
        # the context that ends in this word; its suffix is the same without the first word
        candidates = rows.where((F.col("n") >= s.least_context) & (F.col("word") != word_key(END))).select(
            F.col("key").alias("ctx"), F.col("below").alias("suffix"), F.col("n").alias("n_ctx"))
    kept: list[DataFrame] = []
    for length in range(s.depth, 0, -1):
        wanted = diverging[length - 1]
        if kept:  # every suffix of a retained context is retained
            wanted = wanted.unionByName(kept[-1].select(F.col("suffix").alias("ctx"))).distinct()
        kept.append(materialize(contexts[length - 1].join(wanted, "ctx", "left_semi"), f"kept-{length}"))
    tree.contexts = reduce(DataFrame.unionByName, [
        k.select(F.col("ctx").alias("key"), F.col("n_ctx").alias("n"), "suffix", F.lit(s.depth - i).alias("length"),
                 F.log10("rest").alias("log_rest")) for i, k in enumerate(kept)])
    tree.following = reduce(DataFrame.unionByName, [r.select("key", "n", "ctx", "word", F.log10("p").alias("log_p")) for r in fitted])
    tree.gains = materialize(reduce(DataFrame.unionByName, [
        lookup(r.select("ctx", "key", "n", "gain"), k.select("ctx", "entries"), "ctx", "entries").where("found IS NOT NULL")
        .select("key", "n", "gain") for r, k in zip(fitted, reversed(kept), strict=True)]), "gains")
    return tree


# ---- scores -----------------------------------------------------------------------------------------


class Shared:
    """The most frequent rows of a table (key, n, value): sorted keys, found through their first bits; `others` are the rest."""

    def __init__(self, rows: DataFrame, value: str, room: int):
        bucket = F.floor(F.log2("n") * 8).cast("int")
        sizes = sorted(((r.bucket, r["count"]) for r in rows.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
        least, held = None, 0
        for b, size in sizes:  # whole steps of frequency, as many as the room takes
            held += size
            if held > room:
                break
            least = b
        chosen = rows.where(bucket >= least) if least is not None else rows.limit(0)
        self.others = rows.where(bucket < least) if least is not None else rows
        found = chosen.select("key", F.col(value).alias("value")).toArrow()
        keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], found.column("value").to_numpy().astype(np.float64)[order]
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys, nan where a key is not shared."""
        out = np.full(len(wanted), np.nan)
        part = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[part], self.first[part + 1]
        todo = np.flatnonzero(at < stop)
        for step in range(self.longest):
            place = at[todo] + step
            hit = self.keys[place] == wanted[todo]
            out[todo[hit]] = self.values[place[hit]]
            todo = todo[~hit & (place + 1 < stop[todo])]
        return out


def _double_bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Rows (key) -> packed bits with two bits set for a key, by its first and its next `bits` bits."""
    return bitmap(rows.select(F.explode(F.array("key", F.shiftleft("key", bits))).alias("key")), bits)


def _in_double_bitmap(packed: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = in_bitmap(packed, keys, bits)
    out[out] = in_bitmap(packed, keys[out] << np.uint64(bits), bits)
    return out


@dataclass
class Shortcut:
    """What every task holds; all of it of bounded size."""

    words: Shared
    contexts: Shared
    gains: Shared
    some_contexts: np.ndarray
    some_gains: np.ndarray


#: What a key is looked up as: a word alone, a context, a next word behind its context.
_WORD, _CONTEXT, _NEXT = 0, 1, 2


def shortcut(tree: Tree) -> tuple[Shortcut, DataFrame]:
    """What tasks hold, and rows (kind, key, value) of all that they do not; words are valued above an unseen one."""
    s = tree.settings
    root = tree.words.select("key", "n", F.log10((F.col("n") + s.added) / tree.denominator).alias("log_root"))
    words, contexts, gains = (Shared(root, "log_root", s.shared_words), Shared(tree.contexts, "log_rest", s.shared_contexts),
                              Shared(tree.gains, "gain", s.shared_next))
    others = reduce(DataFrame.unionByName, [
        shared.others.select(F.lit(kind).cast("byte").alias("kind"), "key", value.alias("value")) for kind, shared, value in (
            (_WORD, words, F.col("log_root") - F.lit(tree.unseen)), (_CONTEXT, contexts, F.col("log_rest")), (_NEXT, gains, F.col("gain")))])
    for shared in (words, contexts, gains):
        del shared.others  # tasks get the rest
    return Shortcut(words, contexts, gains, _double_bitmap(tree.contexts, s.bits), _double_bitmap(tree.gains, s.bits)), others


@dataclass
class Walk:
    """Per token: log10 of the word alone (`root`, nan where it is not shared) and what is known of all contexts above it;
    and the tokens (`at`), kinds and keys of what is to be looked up."""

    root: np.ndarray
    above: np.ndarray
    at: np.ndarray
    kind: np.ndarray
    key: np.ndarray


def walk(b: Block, known: Shortcut, s: Settings) -> Walk:
    root = known.words.find(b.word)
    above = np.zeros(len(b.word))
    rare = np.flatnonzero(np.isnan(root))
    asked = [(rare, _WORD, b.word[rare])]
    for length in range(1, s.depth + 1):
        context, following = b.context[length - 1], b.following[length - 1]
        at = np.flatnonzero(b.place >= length - 1)
        at = at[_in_double_bitmap(known.some_contexts, context[at], s.bits)]
        explicit = at[_in_double_bitmap(known.some_gains, following[at], s.bits)]
        for where, kind, shared, keys in ((at, _CONTEXT, known.contexts, context), (explicit, _NEXT, known.gains, following)):
            found = shared.find(keys[where])
            open_ = np.isnan(found)
            above[where] += np.where(open_, 0.0, found)
            asked.append((where[open_], kind, keys[where[open_]]))
    return Walk(root, above, np.concatenate([a for a, _, _ in asked]), np.repeat([k for _, k, _ in asked], [len(a) for a, _, _ in asked]),
                np.concatenate([k for _, _, k in asked]))


_ASKED = pa.struct([("kind", pa.int8()), ("key", pa.int64()), ("times", pa.int64())])


def _asked(of: np.ndarray, n: int, w: Walk) -> pa.Array:
    """Per text, the distinct lookups and how many of its tokens need each."""
    text = of[w.at]
    order = np.lexsort((w.key, w.kind, text))
    text, kind, key = text[order], w.kind[order], w.key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(text)))
    rows = pa.StructArray.from_arrays(
        [pa.array(kind[first].astype(np.int8)), pa.array(key[first].view(np.int64)), pa.array(times.astype(np.int64))], names=[f.name for f in _ASKED])
    offsets = np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rows).cast(pa.list_(_ASKED))


def score(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, base_score, score (log10).

    Null and empty texts are scored as the end token alone; repeated rows are scored each; words of equal counts
    are treated alike; an empty table gives no rows, an empty training table makes every token unseen; other
    columns are ignored. Texts of any length are scored whole: a task works on 2 MB of texts, or one text, at a time.
    """
    s, spark, unseen = tree.settings, docs.sparkSession, tree.unseen
    shared, others = shortcut(tree)
    held = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, PIECE):
            b, n = block(batch.column(1), s.depth), batch.num_rows
            w = walk(b, known, s)
            length = np.diff(np.append(b.first, len(b.word)))
            told = ~np.isnan(w.root)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), batch.column(0), pa.array(length),
                pa.array(np.add.reduceat(told.astype(np.int64), b.first)),
                pa.array(np.add.reduceat(np.where(told, w.root, unseen), b.first)), pa.array(np.add.reduceat(w.above, b.first)),
                _asked(np.repeat(np.arange(n), length), n, w),
            ], names=["row", "id", "n_tokens", "n_known", "base_score", "above", "asked"])
            row += n
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scored = materialize(docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, (
        f"row long, id {kind}, n_tokens long, n_known long, base_score double, above double, "
        "asked array<struct<kind: tinyint, key: long, times: long>>")), "scored")
    # key and row side by side: what differs from row to row of the shuffle stays together
    asked = scored.select("row", F.inline("asked")).select("kind", "times", "key", "row")
    found = asked.join(others, ["kind", "key"])
    alone, value = F.col("kind") == _WORD, F.col("times") * F.col("value")
    more = found.groupBy("row").agg(
        F.sum(F.when(alone, value)).alias("more_base"), F.sum(F.when(~alone, value)).alias("more_above"),
        F.sum(F.when(alone, F.col("times"))).alias("more_known"))
    zero = F.lit(0.0)
    base = F.col("base_score") + F.coalesce("more_base", zero)
    return scored.drop("asked").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        base.alias("base_score"), (base + F.col("above") + F.coalesce("more_above", zero)).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: a tenth by the crc32 of its id's text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Train on the rows that are not held out and score all rows; see `score`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tree = fit(docs.where(~held_out(id_col)).select(text.alias("text")), settings)
    return score(docs, tree, id_col, text_col).withColumns(
        {"held_out": held_out(id_col), "train_tokens": F.lit(tree.total).cast("long")})
